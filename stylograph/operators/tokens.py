"""The token table: its schema, the native tokenizer, and the seam for a tagger or parser.

Flat form, one row per token:
    tok_no is 1-based within the work, sent_no within the work, sent_tok_no and head_no within the
    sentence; a root's head is itself. Lexical columns (lemma, pos, tag, is_stop) and tree columns
    (dep, head_no) are null until something supplies them.
Packed form, one row per sentence: ``tokens`` is the array of the sentence's token structs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograph.functions.lexicons import STOP_WORDS
from stylograph.functions.prose import sentences, token_texts
from stylograph.operators import long_texts
from stylograph.operators.cleaning import clean_markdown
from stylograph.operators.pieces import IN_ROW_CHARS, MAX_CHUNK_CHARS, chunks
from stylograph.operators.surface import split_by_length
from stylograph.session import checkpointed, lookup

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("work_id", T.StringType()),
        T.StructField("sent_no", T.IntegerType()),
        T.StructField("tok_no", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lower", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("dep", T.StringType()),
        T.StructField("sent_tok_no", T.IntegerType()),
        T.StructField("head_no", T.IntegerType()),
        T.StructField("is_alpha", T.BooleanType()),
        T.StructField("is_punct", T.BooleanType()),
        T.StructField("is_stop", T.BooleanType()),
    ]
)
# What an annotator returns per chunk: the same columns, numbered within the chunk, and how many tokens and sentences the chunks before
# it in its row's text have.
CARRIED = ("tok_offset", "sent_offset")
CHUNK_TOKEN_SCHEMA = T.StructType(
    [TOKEN_SCHEMA["work_id"], T.StructField("chunk_no", T.IntegerType())] + TOKEN_SCHEMA.fields[1:]
    + [T.StructField(c, T.LongType()) for c in CARRIED]
)
SENTENCE_FIELDS = [f.name for f in TOKEN_SCHEMA.fields if f.name not in ("work_id", "sent_no", "tok_no")]

# Chunks numbered together when offsets are summed.
CHUNKS_PER_BLOCK = 4096


def sentence_rows(works: DataFrame, clean: bool = True, in_row_chars: int = IN_ROW_CHARS) -> DataFrame:
    """One row per sentence of ``works(work_id, text)``: work_id, sent_no, text.

    Sentences stay where their work was read; works above ``in_row_chars`` are cut at sentence ends and spread.
    """
    prose = clean_markdown(F.col("text")) if clean else F.col("text")
    short, pieces = split_by_length(works, in_row_chars)
    rows = short.select("work_id", F.posexplode(sentences(prose)).alias("position", "text"))
    rows = rows.select("work_id", (F.col("position") + 1).alias("sent_no"), "text")
    if pieces is None:
        return rows
    return rows.unionByName(long_texts.numbered_sentences(long_texts.cleaned_pieces(pieces) if clean else pieces))


def is_word(text: Column) -> Column:
    return text.rlike(r"^\p{L}+$")


def is_mark(text: Column) -> Column:
    return text.rlike(r"^\p{P}+$")


def tokenize(works: DataFrame, clean: bool = True, in_row_chars: int = IN_ROW_CHARS) -> DataFrame:
    """Flat surface tokens of ``works(work_id, text)``. Narrow: each work numbers its own tokens; works above ``in_row_chars``
    are numbered in pieces."""
    short, pieces = split_by_length(works, in_row_chars)
    tokens = _with_surface_columns(_numbered_in_row(short, clean))
    return tokens if pieces is None else tokens.unionByName(tokenize_pieces(pieces, clean))


def tokenize_pieces(pieces: DataFrame, clean: bool = True) -> DataFrame:
    """As ``tokenize``, for works given as ``pieces(work_id, piece_no, text)`` cut at any character."""
    return _with_surface_columns(long_texts.numbered_tokens(long_texts.cleaned_pieces(pieces) if clean else pieces))


def _with_surface_columns(tokens: DataFrame) -> DataFrame:
    text = F.col("text")
    return tokens.select(
        "work_id", "sent_no", "tok_no", "text", F.lower(text).alias("lower"), "sent_tok_no", is_word(text).alias("is_alpha"), is_mark(text).alias("is_punct")
    )


def _numbered_in_row(works: DataFrame, clean: bool) -> DataFrame:
    prose = clean_markdown(F.col("text")) if clean else F.col("text")

    def numbered(sentence: Column, s: Column) -> Column:
        return F.transform(
            token_texts(sentence),
            lambda text, t: F.struct((s + 1).alias("sent_no"), (t + 1).alias("sent_tok_no"), text.alias("text")),
        )

    rows = works.select(
        "work_id", F.posexplode(F.flatten(F.transform(sentences(prose), numbered))).alias("position", "t")
    )
    return rows.select("work_id", "t.sent_no", (F.col("position") + 1).cast("bigint").alias("tok_no"), "t.sent_tok_no", "t.text")


# Suffix rules, first match wins: (ending, least length of the word, part of speech).
POS_ENDINGS = (
    ("ly", 4, "ADV"),
    ("ous", 5, "ADJ"),
    ("ful", 5, "ADJ"),
    ("less", 6, "ADJ"),
    ("ive", 5, "ADJ"),
    ("able", 6, "ADJ"),
    ("ible", 6, "ADJ"),
    ("al", 5, "ADJ"),
    ("ish", 5, "ADJ"),
    ("ing", 5, "VERB"),
    ("ed", 4, "VERB"),
    ("ise", 5, "VERB"),
    ("ize", 5, "VERB"),
)
# (ending, least length, letters cut, replacement)
LEMMA_ENDINGS = (
    ("ies", 5, 3, "y"),
    ("sses", 6, 2, ""),
    ("ing", 6, 3, ""),
    ("ed", 5, 2, ""),
    ("ss", 3, 0, ""),
    ("s", 4, 1, ""),
)


def pos_by_rule(lower: Column, is_alpha: Column, is_punct: Column) -> Column:
    """Part of speech by ending. An approximation: use an annotator for real tags."""
    pos = F.when(is_punct, "PUNCT").when(~is_alpha, F.when(lower.rlike(r"^\p{N}+$"), "NUM").otherwise("X"))
    for ending, least, label in POS_ENDINGS:
        pos = pos.when(lower.endswith(ending) & (F.length(lower) >= least), label)
    return pos.otherwise("NOUN")


def pos_of_tokens(types: pa.Table) -> tuple[list[str], np.ndarray]:
    """``pos_by_rule`` of distinct tokens (``token_batches``): names, and each token's number among them."""
    names = list(dict.fromkeys(["NOUN", "PUNCT", "NUM", "X", *(label for _, _, label in POS_ENDINGS)]))
    flag = lambda name: types[name].to_numpy()
    conditions = [flag("is_punct"), flag("is_number"), ~flag("is_alpha")]
    size = pc.utf8_length(types["lower"]).to_numpy()
    conditions += [pc.ends_with(types["lower"], ending).to_numpy() & (size >= least) for ending, least, _ in POS_ENDINGS]
    labels = ["PUNCT", "NUM", "X", *(label for _, _, label in POS_ENDINGS)]
    return names, np.select(conditions, [names.index(label) for label in labels], 0)


def lemma_by_rule(lower: Column, is_alpha: Column) -> Column:
    """Base form by cutting an inflection. An approximation like ``pos_by_rule``."""
    lemma = F.when(~is_alpha, lower)
    for ending, least, cut, add in LEMMA_ENDINGS:
        base = F.concat(F.substring(lower, F.lit(1), F.length(lower) - cut), F.lit(add))
        lemma = lemma.when(lower.endswith(ending) & (F.length(lower) >= least), base)
    return lemma.otherwise(lower)


def with_lexical_columns(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Add pos, lemma and is_stop: from ``lexicon(lower, pos, lemma, is_stop)`` where it knows the
    word, by rule elsewhere."""
    lower, alpha, punct = F.col("lower"), F.col("is_alpha"), F.col("is_punct")
    rules = {
        "pos": pos_by_rule(lower, alpha, punct),
        "lemma": lemma_by_rule(lower, alpha),
        "is_stop": lower.isin(*STOP_WORDS),
    }
    if lexicon is None:
        return tokens.withColumns(rules)
    known = lexicon.select("lower", *(F.col(c).alias(f"_{c}") for c in rules))
    joined = tokens.join(lookup(known), "lower", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), rule) for c, rule in rules.items()}).drop(
        *(f"_{c}" for c in rules)
    )


def pack_sentences(tokens: DataFrame) -> DataFrame:
    """Flat tokens to one row per sentence: work_id, sent_no, tokens (in order).

    Groups are sentences, so a work of any size is spread over its sentences.
    """
    fields = ["sent_tok_no"] + [c for c in SENTENCE_FIELDS if c in tokens.columns and c != "sent_tok_no"]
    return tokens.groupBy("work_id", "sent_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens"))


def unpack_sentences(packed: DataFrame) -> DataFrame:
    """One row per sentence back to flat tokens (without ``tok_no``)."""
    return packed.select("work_id", "sent_no", F.explode("tokens").alias("t")).select("work_id", "sent_no", "t.*")


def sentence_tokens(
    works: DataFrame, clean: bool = True, labels: Iterable[Callable[[Column], dict[str, Column]]] = ()
) -> DataFrame:
    """Packed sentences straight from ``works(work_id, text)``, without a shuffle.

    Each function of ``labels`` maps a token struct to fields to add; later ones see the fields of
    earlier ones, so nothing is computed twice.
    """

    def numbered(text: Column, t: Column) -> Column:
        return F.struct(
            (t + 1).alias("sent_tok_no"),
            text.alias("text"),
            F.lower(text).alias("lower"),
            is_word(text).alias("is_alpha"),
            is_mark(text).alias("is_punct"),
        )

    def adding(label: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
        def add(token: Column) -> Column:
            for name, value in label(token).items():
                token = token.withField(name, value)
            return token

        return add

    tokens = F.transform(token_texts(F.col("text")), numbered)
    for label in labels:
        tokens = F.transform(tokens, adding(label))
    return sentence_rows(works, clean).select("work_id", "sent_no", tokens.alias("tokens"))


def sentence_token_rows(
    works: DataFrame, clean: bool = True, labels: Iterable[Callable[[Column], dict[str, Column]]] = (), in_row_chars: int = IN_ROW_CHARS
) -> DataFrame:
    """The tokens of ``sentence_tokens`` as rows: work_id, sent_no, the token's columns, and ``at``, its place in the sentence from 0. Rows of a
    sentence stand together and in order, as they come from its text without a shuffle; a sentence without tokens is a row of nulls.

    Labels are computed row by row in compiled code, several times faster than inside an array."""
    texts = sentence_rows(works, clean, in_row_chars).select("work_id", "sent_no", token_texts(F.col("text")).alias("found"))
    rows = texts.select("work_id", "sent_no", F.posexplode_outer("found").alias("at", "text"))
    text = F.col("text")
    rows = rows.withColumns({
        "sent_tok_no": F.col("at") + 1, "lower": F.lower(text), "is_alpha": is_word(text), "is_punct": is_mark(text),
    })
    for label in labels:
        rows = rows.withColumns(label(rows))
    return rows


# --- annotator seam ---------------------------------------------------------------------------

Annotator = Callable[[list[str]], Iterable[pd.DataFrame]]


def annotate(
    works: DataFrame, annotator: Annotator, max_chars: int = MAX_CHUNK_CHARS, batch: int = 8, clean: bool = True
) -> DataFrame:
    """Run a tagger or parser over chunks of ``works(work_id, text)`` on the executors.

    ``annotator(texts)`` yields one token frame per text, with any of the token columns, numbered
    within the text. Only chunk-sized texts reach Python, ``batch`` at a time. The result has
    ``chunk_no`` and chunk-local numbers: land it (it is read twice), then ``restore_order``.
    """
    prose = clean_markdown(F.col("text")) if clean else F.col("text")
    parts = chunks(works.select("work_id", prose.alias("text")), max_chars)
    columns = CHUNK_TOKEN_SCHEMA.names

    def last(parsed: pd.DataFrame, column: str) -> int:
        number = parsed[column].max() if column in parsed and len(parsed) else None
        return 0 if number is None or pd.isna(number) else int(number)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = (0, 0)
        for frame in frames:
            for start in range(0, len(frame), batch):
                rows = frame.iloc[start : start + batch]
                parsed = list(annotator(list(rows["text"])))
                tokens = pd.concat(parsed, ignore_index=True)
                sizes = [len(p) for p in parsed]
                tokens["work_id"] = rows["work_id"].repeat(sizes).to_numpy()
                tokens["chunk_no"] = rows["chunk_no"].repeat(sizes).to_numpy()
                before = []
                for chunk_no, chunk in zip(rows["chunk_no"], parsed):  # the chunks of a row's text come one after the other
                    so_far = so_far if chunk_no else (0, 0)
                    before.append(so_far)
                    so_far = (so_far[0] + last(chunk, "tok_no"), so_far[1] + last(chunk, "sent_no"))
                for n, column in enumerate(CARRIED):
                    tokens[column] = np.repeat(np.array([b[n] for b in before], np.int64), sizes)
                yield tokens.assign(**{c: None for c in columns if c not in tokens})[columns]

    return parts.mapInPandas(run, CHUNK_TOKEN_SCHEMA)


def restore_order(chunk_tokens: DataFrame) -> DataFrame:
    """Chunk-local token and sentence numbers to work-wide ones, in document order.

    Offsets are running sums over chunk totals, first inside blocks of chunks, then over blocks:
    a work of any length is summed in bounded groups, and tokens themselves are never sorted. Tokens that carry their chunk's
    offsets already, as those of ``annotate`` do unless a ``work_id`` comes twice, are not moved: only chunks that carry none or others are joined.
    """
    carried = chunk_tokens.columns if set(CARRIED) <= set(chunk_tokens.columns) else [*chunk_tokens.columns, *CARRIED]
    chunk_tokens = chunk_tokens.select(*(c if c in chunk_tokens.columns else F.lit(None).cast("long").alias(c) for c in carried))
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in CARRIED for f in (F.min, F.max)]
    totals = chunk_tokens.groupBy("work_id", "chunk_no").agg(
        F.max("tok_no").alias("toks"), F.max("sent_no").alias("sents"), *bounds, *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in CARRIED)
    )
    known = [f"{name}_{c}" for c in CARRIED for name in ("min", "max", "no")]
    totals = totals.withColumn("block", F.floor(F.col("chunk_no") / CHUNKS_PER_BLOCK))
    in_block = Window.partitionBy("work_id", "block").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy("work_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    blocks = totals.groupBy("work_id", "block").agg(F.sum("toks").alias("toks"), F.sum("sents").alias("sents"))
    blocks = blocks.select(
        "work_id", "block", before("toks", over_blocks).alias("block_toks"), before("sents", over_blocks).alias("block_sents")
    )
    offsets = totals.select(
        "work_id", "block", "chunk_no", before("toks", in_block).alias("toks"), before("sents", in_block).alias("sents"), *known
    ).join(blocks, ["work_id", "block"])
    offsets = offsets.select(
        "work_id", "chunk_no", (F.col("toks") + F.col("block_toks")).alias("tok_before"), (F.col("sents") + F.col("block_sents")).alias("sent_before"), *known
    )
    right = F.lit(True)
    for c, own in zip(CARRIED, ("tok_before", "sent_before")):
        right &= (F.col(f"no_{c}") == 0) & (F.col(f"min_{c}") == F.col(own)) & (F.col(f"max_{c}") == F.col(own))
    others = checkpointed(offsets.where(~F.coalesce(right, F.lit(False))).select("work_id", "chunk_no", "tok_before", "sent_before"))
    placed = chunk_tokens.where(F.col("work_id").isNotNull() & F.col("chunk_no").isNotNull())
    tok_offset, sent_offset = map(F.col, CARRIED)
    if not others.isEmpty():
        placed = placed.join(lookup(others), ["work_id", "chunk_no"], "left")
        tok_offset, sent_offset = F.coalesce("tok_before", tok_offset), F.coalesce("sent_before", sent_offset)
    return (
        placed.withColumn("tok_no", F.col("tok_no") + tok_offset)
        .withColumn("sent_no", (F.col("sent_no") + sent_offset).cast("int"))
        .select(*TOKEN_SCHEMA.names)
    )
