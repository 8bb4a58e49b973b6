"""The driver's tables in the roles the operators expect."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.operators.tokens import lemma_by_rule, pos_by_rule, pos_of_tokens
from stylograph.session import checkpoint_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (what stands in the texts, what is put in its place), in this order.
CONTRACTIONS = (
    (" the ", " don't "), (" le ", " it’s "), (" of ", " we've "), (" and ", " I’ll "), (" de ", " I'm "), (" la ", " they’re "), (" die ", " he'd "),
    (" in ", " didn’t "),
)
PAGE_MARKS = (("<p>", " “"), ("</p>", "” … "), ("<li>", " — "), ("</li>", " -- "), ("<title>", " – "), ("</title>", " ... "))


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a work."""
    scan = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("work_id"), "text")
    return spread(scan, "work_id")


def page_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's source is a work, with marks for tags: curly quotes, both dashes, both ellipses."""
    text = replaced(F.col("html"), PAGE_MARKS)
    scan = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("work_id"), text.alias("text"))
    return spread(scan, "work_id")


def contracted_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts hold no apostrophe; common words are replaced by contractions with every clitic."""
    return works(spark, sf_dir).withColumn("text", replaced(F.col("text"), CONTRACTIONS))


def spaced_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts hold no blank line; every line end becomes one."""
    return works(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


#: Markup around a document's text, chosen by its number: each rule of the cleaning meets its case.
MARKUP_SAMPLES = (
    ("first\r\nsecond\rthird\n", "\r\n"), ("---\ntitle: x\n---\n", ""), ("# Heading\n  ### Sub #\n#none\n", "\n###### last one"),
    ("a\n * * *\n", "\n***\n"), ("a\n----\n", "\n ---\nb"), ("a\n___\n", "\n____ \nb"), ("> said\n >said again\n", "\n> end"),
    ("![a picture](p.png) x ", " ![](q.png)"), ("see [the page](http://x/y) and ", " [b](c)"), ("**bold\ntext** ", " **b**"),
    ("__bold\ntext__ ", " __b__"), ("*it* * ", " *last*"), ("_it_ _ ", " _last_"), ("`code\nmore` ", " `c`"), ("a\n\n\n\nb ", "\n\n\nc"),
    (" \n\t lead ", " trail \t\n "),
)


def marked_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with markup before and after their texts."""
    pairs = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(after).alias("after")) for before, after in MARKUP_SAMPLES))
    sample = F.get(pairs, (F.col("doc_id") % len(MARKUP_SAMPLES)).cast("int"))
    scan = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("work_id"), F.concat(sample["before"], "text", sample["after"]).alias("text")
    )
    return spread(scan, "work_id")


#: Markup that is opened in one document and closed in a later one, by number: before and after the text.
OPEN_SAMPLES = (
    ("", " [words of"), ("a link](an address, ", " long) **bold"), ("words** ", " ![a picture"), ("of it](pic", "ture.png) `code\n"), ("more` \n# A heading of ", " "),
    ("many words\n", " *one line"), ("of words* “", " never [closed"), ("brackets] (here)” ", "\n\n\n"), ("\n---\n", " __under"), ("lined__ ", " end."),
)


def source_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a work, a document one of its pieces; markup runs from piece to piece, and no blank line parts them."""
    pairs = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(after).alias("after")) for before, after in OPEN_SAMPLES))
    sample = F.get(pairs, (F.col("doc_id") % len(OPEN_SAMPLES)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("work_id"), F.col("doc_id").alias("piece_no"), F.concat(sample["before"], "text", sample["after"]).alias("text")
    )


def spaced_source_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``source_pieces``, with blank lines for line ends and no markup; a paragraph may run from one piece to the next."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("work_id"), F.col("doc_id").alias("piece_no"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with markup, a file each, and the conversations, a folder of chapters each: path, text."""
    single = marked_works(spark, sf_dir).select(F.concat(F.lit("works/"), "work_id", F.lit(".md")).alias("path"), "text")
    folders = chapters(spark, sf_dir).select(F.concat(F.lit("talks/"), "work_id", F.lit("/"), "name").alias("path"), "text")
    return single.unionByName(folders)


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("n"))
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("n")).distinct()
    return documents.select(F.concat(F.lit("d"), "n").alias("work_id"), F.concat(F.lit("works/"), "n", F.lit(".md")).alias("path")).unionByName(
        talks.select(F.concat(F.lit("c"), "n").alias("work_id"), F.concat(F.lit("talks/"), "n").alias("path"))
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a work, a turn a chapter file; the numbers pass 9, where their order is not that of their names."""
    name = F.concat(F.lit("Chapter-"), (F.col("turn") * 4).cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("work_id"), name.alias("name"), "text"
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works' catalogue: a source is an author, src0 is "self"."""
    work_id = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        work_id.alias("work_id"),
        F.concat(F.lit("Document, no. "), work_id).alias("title"),
        F.col("source").alias("author"),
        F.lit("test").alias("tradition"),
        F.lit("now").alias("era"),
        (F.col("source") == "src0").alias("is_self"),
        F.concat(F.lit("corpus/"), work_id, F.lit(".md")).alias("path"),
    )


def lexical_labels(token) -> dict[str, Column]:
    """Part of speech and lemma by ending. ``token`` is a token struct, or maps names to columns."""
    return {
        "pos": pos_by_rule(token["lower"], token["is_alpha"], token["is_punct"]),
        "lemma": lemma_by_rule(token["lower"], token["is_alpha"]),
    }


#: Words of these lengths stand for heads of subordinate clauses.
SUBORDINATE_LENGTHS = {11: "advcl", 12: "ccomp", 13: "xcomp", 14: "acl", 15: "relcl", 16: "csubj"}


def tree_labels(token) -> dict[str, Column]:
    """Declared labels in place of a parser's: a head by arithmetic on the position. Made up, but the
    same in both engines."""
    position = token["sent_tok_no"]
    dep = F.when(position == 1, "ROOT")
    for length, label in SUBORDINATE_LENGTHS.items():
        dep = dep.when(F.length(token["text"]) == length, label)
    dep = dep.when(token["pos"] == "VERB", "conj")
    head = F.when(position == 1, 1).when(position % 5 == 0, position - 1).otherwise(F.floor((position + 1) / 2))
    return {"dep": dep.otherwise("dep"), "head_no": head.cast("int")}


RULE_LABELS = (lexical_labels, tree_labels)


def rule_labels(types: pa.Table, code: np.ndarray, position: np.ndarray) -> tuple[tuple[list, np.ndarray], tuple[list, np.ndarray], np.ndarray]:
    """``RULE_LABELS`` of a batch of tokens (``token_batches.Labels``)."""
    names, pos = pos_of_tokens(types)
    deps = ["dep", "ROOT", "conj", *SUBORDINATE_LENGTHS.values()]
    size = pc.utf8_length(types["text"]).to_numpy()
    lengths = [size == length for length in SUBORDINATE_LENGTHS]
    dep = np.select([*lengths, pos == names.index("VERB")], [*(deps.index(label) for label in SUBORDINATE_LENGTHS.values()), deps.index("conj")], 0)
    head = np.where(position == 1, 1, np.where(position % 5 == 0, position - 1, (position + 1) // 2))
    return (names, pos[code]), (deps, np.where(position == 1, deps.index("ROOT"), dep[code])), head


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
