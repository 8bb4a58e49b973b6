"""Measures over the token table.

Counts that are plain sums are one aggregation by work, combined before the shuffle. Measures of a
sentence are computed inside its packed row. Only what crosses sentences (types, quotes) has its
own aggregation, keyed finer than the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stylograph.functions.arrays import chained_switch, let, token_depths
from stylograph.functions.lexicons import (
    ARCHAIC_WORDS,
    CLITICS,
    CLOSE_QUOTE,
    CONTENT_POS,
    COORDINATE_DEP,
    FUNCTION_WORDS,
    OPEN_QUOTE,
    POSSESSIVE_OR_IS,
    POSSESSIVE_TAG,
    PUNCTUATION_GROUPS,
    ROOT_DEP,
    SENTENCE_KINDS,
    STRAIGHT_QUOTE,
    SUBORDINATE_DEPS,
    VERBAL_POS,
)
from stylograph.operators import long_sentences
from stylograph.operators.measures import ALL, measure, tidy
from stylograph.operators.surface import FUNCTION_WORD_COUNTS, PUNCTUATION_COUNTS, term_richness
from stylograph.operators.tokens import pack_sentences
from stylograph.session import Kept, checkpointed, lookup, release, sql_string, stored

# Tokens swept together for the quote switch.
TOKENS_PER_BLOCK = 65_536
# Blocks chained together before the work is.
BLOCKS_PER_RUN = 4_096
# Longest sentence packed into one row.
PACKED_TOKENS = 20_000
# Tokens whose sentences are measured at once. It changes no result.
TOKENS_AT_ONCE = 100_000
# Shares of the works that a token table is written in, the tokens counted together, and the columns that are. They change no result.
SHARES, TOKENS_PER_SHARE = 16, 5_000_000
COUNTED = ("work_id", "sent_no", "tok_no", "text", "lower", "tag", "pos", "dep", "sent_tok_no", "head_no", "is_alpha", "is_punct")
# Type of the positions heads name.
HEAD = "int"


# --- per sentence -----------------------------------------------------------------------------


def tree_depth(tokens: Column) -> Column:
    """Deepest token's distance to the root, from a packed sentence; null without heads, and where a token reaches no root.

    Heads name positions, which may have gaps."""

    def placed(ts: Column) -> Column:
        heads, positions = F.transform(ts, lambda t: t["head_no"]), F.transform(ts, lambda t: t["sent_tok_no"])
        gapless = (F.element_at(positions, 1) == 1) & (F.element_at(positions, -1) == F.size(positions))
        return F.when(gapless, heads).otherwise(F.transform(heads, lambda h: F.array_position(positions, h).cast(HEAD)))

    def deepest(depths: Column) -> Column:
        return F.when(~F.exists(depths, lambda d: d.isNull()), F.array_max(depths))

    parsed = (F.size(tokens) > 0) & ~F.exists(tokens, lambda t: t["head_no"].isNull())
    return F.when(parsed, let(let(tokens, placed), lambda heads: let(token_depths(heads), deepest)))


def sentence_kind(tokens: Column) -> Column:
    """simple, compound or complex, from a packed sentence; null without dependency labels."""

    def classify(ts: Column) -> Column:
        def coordinated(t: Column) -> Column:
            at_root = F.exists(ts, lambda h: (h["sent_tok_no"] == t["head_no"]) & (h["dep"] == ROOT_DEP))
            return (t["dep"] == COORDINATE_DEP) & t["pos"].isin(*VERBAL_POS) & at_root

        return (
            F.when(F.exists(ts, lambda t: t["dep"].isNull()), F.lit(None).cast("string"))
            .when(F.exists(ts, lambda t: t["dep"].isin(*SUBORDINATE_DEPS)), "complex")
            .when(F.exists(ts, lambda t: F.coalesce(coordinated(t), F.lit(False))), "compound")
            .otherwise("simple")
        )

    return let(tokens, classify)


def sentence_facts(packed: DataFrame) -> DataFrame:
    """Per sentence: words, adjectives, adverbs, depth and kind."""

    def number(condition) -> Column:
        return F.size(F.filter("tokens", condition)).cast("bigint")

    return packed.select(
        "work_id",
        "sent_no",
        number(lambda t: t["is_alpha"]).alias("words"),
        number(lambda t: t["pos"] == "ADJ").alias("adjectives"),
        number(lambda t: t["pos"] == "ADV").alias("adverbs"),
        tree_depth(F.col("tokens")).alias("depth"),
        sentence_kind(F.col("tokens")).alias("kind"),
    )


# What is known of a token for its sentence's facts, as bits of a number.
TOKEN_BITS = {
    "word": "is_alpha", "adjective": "pos = 'ADJ'", "adverb": "pos = 'ADV'", "unlabelled": "dep IS NULL",
    "subordinate": f"dep IN ({', '.join(map(sql_string, SUBORDINATE_DEPS))})",
    "coordinated": f"dep = {sql_string(COORDINATE_DEP)} AND pos IN ({', '.join(map(sql_string, VERBAL_POS))})",
    "root": f"dep = {sql_string(ROOT_DEP)}",
}
FACTS = "work_id string, sent_no int, words bigint, adjectives bigint, adverbs bigint, depth int, kind string"


def parents(sentence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, position: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Index of the token that each token's head names, the number of tokens where there is none. Positions may have gaps."""
    n, none = len(position), len(position)
    ends = starts + sizes - 1
    gapless = ((position[starts] == 1) & (position[ends] == sizes))[sentence]
    size = sizes[sentence]
    direct = np.where((head >= 1) & (head <= size), starts[sentence] + head - 1, none)
    if gapless.all():
        return direct
    step = max(int(np.abs(position).max(initial=0)), int(np.abs(head).max(initial=0))) + 1
    keys, wanted = sentence * (2 * step) + position, sentence * (2 * step) + head
    order = np.argsort(keys, kind="stable")
    found = np.searchsorted(keys, wanted, sorter=order)
    at = order[np.minimum(found, n - 1)]
    return np.where(gapless, direct, np.where((found < n) & (keys[at] == wanted), at, none))


def depths(parent: np.ndarray, longest: int) -> np.ndarray:
    """Hops from every token to its root, which is its own parent; -1 where none is reached. Pointer doubling over all sentences at once."""
    n = len(parent)
    kind = np.int32 if n < 2**30 else np.int64
    own = np.append(parent, n).astype(kind)
    up, depth = own, (own != np.arange(n + 1)).astype(kind)
    for _ in range(max(longest, 2).bit_length()):
        further = depth + depth[up]
        if np.array_equal(further, depth):
            break
        depth, up = np.minimum(further, n + 1), up[up]
    rooted = (up < n) & (own[np.minimum(up, n)] == up)
    return np.where(rooted, depth, -1)[:n]


def facts_of(sentence: np.ndarray, position: np.ndarray, head: np.ma.MaskedArray, bits: np.ndarray) -> dict[str, np.ndarray]:
    """words, adjectives, adverbs, depth (-1: none) and kind (0: none, else the number of one of ``SENTENCE_KINDS``) of sentences, whose
    tokens are numbered 0, 1, ... by ``sentence``, in order, every sentence with a token at least."""
    sizes = np.bincount(sentence)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bit = {name: 1 << n for n, name in enumerate(TOKEN_BITS)}
    count = lambda name: np.add.reduceat((bits & bit[name] != 0).astype(np.int64), starts)
    any_of = np.bitwise_or.reduceat(bits, starts)
    missing, head = np.ma.getmaskarray(head), head.filled(0)
    headed = ~np.logical_or.reduceat(missing, starts) if missing.any() else np.ones(len(starts), bool)
    parent = parents(sentence, starts, sizes, position, head)
    depth = depths(parent, int(sizes.max()))
    depth = np.where(headed & (np.minimum.reduceat(depth, starts) >= 0), np.maximum.reduceat(depth, starts), -1)
    # A root may be any token at the position that the head names.
    step = max(int(np.abs(position).max()), int(np.abs(head).max())) + 1
    verbs = np.flatnonzero((bits & bit["coordinated"] != 0) & ~missing)
    roots = np.flatnonzero(bits & bit["root"])
    led = np.isin(sentence[verbs] * (2 * step) + head[verbs], sentence[roots] * (2 * step) + position[roots])
    compound = np.bincount(sentence[verbs[led]], minlength=len(starts)) > 0
    kind = np.where(any_of & bit["unlabelled"], 0, np.where(any_of & bit["subordinate"], 3, np.where(compound, 2, 1)))
    return {"words": count("word"), "adjectives": count("adjective"), "adverbs": count("adverb"), "depth": depth, "kind": kind}


def sentence_facts_of_rows(rows: DataFrame) -> DataFrame:
    """``sentence_facts`` of tokens that stand together and in order (``tokens.sentence_token_rows``): each task measures the
    sentences of a batch of tokens at once, as numbers; a sentence that goes on in the next batch waits for it."""
    bits = reduce(Column.__add__, (F.when(F.expr(sql), 1 << n).otherwise(0) for n, sql in enumerate(TOKEN_BITS.values())))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    lean = rows.select(
        F.when(first, F.col("work_id").cast("string")).alias("work_id"), F.when(first, F.col("sent_no").cast("int")).alias("sent_no"),
        F.coalesce("at", F.lit(-1)).alias("at"), F.col("sent_tok_no").cast("int").alias("position"), F.col("head_no").cast("int").alias("head"), bits.cast("int").alias("bits"),
    )
    schema = T._parse_datatype_string(FACTS)
    arrow = to_arrow_schema(schema)

    def measured(batch: pa.Table) -> pa.RecordBatch:
        at = batch["at"].to_numpy()
        starts = np.flatnonzero(at <= 0)
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        number = lambda c: batch[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = batch["head"].is_null().to_numpy() if batch["head"].null_count else np.ma.nomask
        facts = facts_of(sentence, number("position"), np.ma.array(number("head"), mask=missing), number("bits"))
        empty = at[starts] < 0
        kinds = pa.array([None, *SENTENCE_KINDS])
        columns = [batch["work_id"].take(starts).combine_chunks(), batch["sent_no"].take(starts).combine_chunks()]
        columns += [pa.array(np.where(empty, 0, facts[c]), pa.int64()) for c in ("words", "adjectives", "adverbs")]
        columns.append(pa.array(facts["depth"], pa.int32(), mask=(facts["depth"] < 0) | empty))
        columns.append(kinds.take(pa.array(np.where(empty, 1, facts["kind"]))))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOKENS_AT_ONCE:
                continue
            whole = pa.Table.from_batches(held)
            last = int(np.flatnonzero(whole["at"].to_numpy() <= 0)[-1])  # the sentence that may go on
            if last:
                yield measured(whole.slice(0, last))
            held = whole.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            yield measured(pa.Table.from_batches(held))

    return lean.mapInArrow(run, schema)


def token_sentence_facts(tokens: DataFrame, packed_tokens: int = PACKED_TOKENS) -> DataFrame:
    """``sentence_facts`` of a flat token table. Sentences up to ``packed_tokens`` are packed into rows;
    longer ones, should there be any, are measured token by token."""
    tokens = tokens.select("work_id", "sent_no", "sent_tok_no", "is_alpha", "pos", "dep", "head_no")
    sizes = tokens.groupBy("work_id", "sent_no").agg(F.count("*").alias("size"))
    long = checkpointed(sizes.where(F.col("size") > packed_tokens))
    longest = long.agg(F.max("size")).first()[0]
    if longest is None:
        return sentence_facts(pack_sentences(tokens))
    keys = lookup(long.select("work_id", "sent_no"))
    short = tokens.join(keys, ["work_id", "sent_no"], "left_anti")
    rest = tokens.join(keys, ["work_id", "sent_no"], "left_semi")
    return sentence_facts(pack_sentences(short)).unionByName(long_sentences.sentence_facts(rest, longest))


def sentence_counts(facts: DataFrame) -> DataFrame:
    """Everything sentences sum to, per work, in one aggregation.

    The counts of trees are null where a sentence of the work was not parsed.
    """
    sums = facts.groupBy("work_id").agg(
        F.count("*").alias("n_sentences"),
        F.expr("sum(words * words) AS sum_sq_sentence_words"),
        F.sum("adjectives").alias("n_adjectives"),
        F.sum("adverbs").alias("n_adverbs"),
        F.expr("CAST(sum(depth) AS BIGINT) AS sum_depth"),
        *(F.expr(f"count_if(kind = {sql_string(kind)}) AS n_{kind}") for kind in SENTENCE_KINDS),
        F.expr("bool_and(depth IS NOT NULL AND kind IS NOT NULL) AS parsed"),
    )
    trees = ("sum_depth", *(f"n_{kind}" for kind in SENTENCE_KINDS))
    return sums.selectExpr(
        "work_id", "n_sentences", "sum_sq_sentence_words", "n_adjectives", "n_adverbs",
        "if(parsed, n_sentences, NULL) AS n_parsed_sentences",
        *(f"if(parsed, {c}, NULL) AS {c}" for c in trees),
    )


# --- per work ---------------------------------------------------------------------------------


def is_contraction() -> Column:
    clitic = F.lower(F.replace(F.col("text"), F.lit("’"), F.lit("'")))
    counts_as_is = (clitic == POSSESSIVE_OR_IS) & (F.coalesce(F.col("tag"), F.lit("")) != POSSESSIVE_TAG)
    return clitic.isin(*CLITICS) | counts_as_is


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("work_id").agg(F.count_if("is_alpha").alias("n_words"))


def speech_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("work_id").agg(
        F.count_if("is_alpha").alias("n_words"),
        F.count_if(F.col("pos") == "ADJ").alias("n_adjectives"),
        F.count_if(F.col("pos") == "ADV").alias("n_adverbs"),
    )


def summed_counts(tokens: DataFrame) -> DataFrame:
    """Every count that is a plain sum over tokens, in one aggregation."""
    function_words = (
        f"count_if(is_alpha AND lower = {sql_string(w)}) AS {name}" for w, name in zip(FUNCTION_WORDS, FUNCTION_WORD_COUNTS)
    )
    punctuation = (
        f"count_if(is_punct AND text IN ({', '.join(map(sql_string, marks))})) AS {name}"
        for marks, name in zip(PUNCTUATION_GROUPS.values(), PUNCTUATION_COUNTS)
    )
    return tokens.groupBy("work_id").agg(
        F.count_if("is_alpha").alias("n_words"),
        F.expr("coalesce(sum(length(text)) FILTER (WHERE is_alpha), 0L) AS n_letters"),
        F.count_if(F.col("is_alpha") & F.col("lower").isin(*ARCHAIC_WORDS)).alias("n_archaic"),
        F.count_if(is_contraction()).alias("n_clitics"),
        *map(F.expr, function_words),
        *map(F.expr, punctuation),
    )


def type_frequencies(tokens: DataFrame) -> DataFrame:
    """Occurrences of every lower-cased word per work: work_id, term, n."""
    return tokens.where("is_alpha").groupBy("work_id", F.col("lower").alias("term")).agg(F.count("*").alias("n"))


def quoted_words(tokens: DataFrame) -> DataFrame:
    """Words inside double quotes per work; the switch runs on through the whole work.

    A block of tokens is swept for both states it may start in, then blocks are chained. No group
    is larger than a block.
    """
    text, word = F.col("text"), F.col("is_alpha")
    swept = tokens.where(word | text.isin(OPEN_QUOTE, CLOSE_QUOTE, STRAIGHT_QUOTE)).select(
        "work_id", "tok_no", "text", "is_alpha", F.floor(F.col("tok_no") / TOKENS_PER_BLOCK).alias("at")
    )
    so_far = Window.partitionBy("work_id", "at").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("flips", F.count_if(text == STRAIGHT_QUOTE).over(so_far))
    setting = F.when(
        text.isin(OPEN_QUOTE, CLOSE_QUOTE), F.struct((text == OPEN_QUOTE).cast("int").alias("state"), F.col("flips"))
    )
    swept = swept.withColumn("set", F.last(setting, ignorenulls=True).over(so_far))

    def inside(entered: int) -> Column:
        since = F.col("flips") - F.coalesce(F.col("set.flips"), F.lit(0))
        return (F.coalesce(F.col("set.state"), F.lit(entered)) + since) % 2 == 1

    blocks = swept.groupBy("work_id", "at").agg(
        F.struct(
            F.count_if(word & inside(0)).alias("in0"),
            F.count_if(word & inside(1)).alias("in1"),
            F.max_by(inside(0), "tok_no").alias("out0"),
            F.max_by(inside(1), "tok_no").alias("out1"),
        ).alias("switch")
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "switch"))), lambda p: p["switch"])
    runs = blocks.groupBy("work_id", F.floor(F.col("at") / BLOCKS_PER_RUN).alias("run")).agg(chained_switch(in_order).alias("switch"))
    runs = runs.withColumnRenamed("run", "at")
    return runs.groupBy("work_id").agg(chained_switch(in_order)["in0"].alias("n_quoted"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Content lemmas per work: work_id, term, term_count. Proper nouns and stop words do not count."""
    content = F.col("is_alpha") & ~F.col("is_stop") & F.col("pos").isin(*CONTENT_POS)
    return (
        tokens.where(content)
        .groupBy("work_id", F.lower("lemma").alias("term"))
        .agg(F.count("*").alias("term_count"))
    )


def token_counts(
    tokens: DataFrame, works: DataFrame | None = None, packed: DataFrame | None = None, share_tokens: int = TOKENS_PER_SHARE
) -> DataFrame:
    """All counts per work of a flat token table.

    ``works`` keeps works without tokens; ``packed`` saves the packing where sentences are at hand. What is shuffled for sentences, quotes and
    types is many times the table. So the columns that are counted are written in ``SHARES`` shares of the works, once, and the shares of about
    ``share_tokens`` are counted one after the other: what was shuffled for one is gone before the next.
    """
    if packed is not None:
        counts = _joined_counts(tokens, sentence_facts(packed))
    else:
        kept = Kept(tokens.sparkSession)
        share = F.pmod(F.xxhash64("work_id"), F.lit(SHARES)).cast("int")
        landed = kept.keep(tokens.select(*COUNTED, share.alias("share")), "share")
        turns = max(1, min(SHARES, -(-landed.count() // share_tokens)))
        parts = [_counted(landed.where(F.col("share").isin(*range(n, SHARES, turns))).drop("share")) for n in range(turns)]
        kept.forget()
        counts = reduce(DataFrame.unionByName, parts)
    return with_zeros(counts if works is None else works.select("work_id").join(counts, "work_id", "left"))


def _joined_counts(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    parts = [
        summed_counts(tokens),
        term_richness(type_frequencies(tokens)),
        sentence_counts(facts),
        quoted_words(tokens),
    ]
    return reduce(lambda left, right: left.join(right, "work_id", "left"), parts, tokens.select("work_id").distinct())


def _counted(tokens: DataFrame) -> DataFrame:
    """The counts written, and what was shuffled for them gone."""
    counts = stored(_joined_counts(tokens, token_sentence_facts(tokens)))
    release(tokens.sparkSession)
    return counts


def with_zeros(counts: DataFrame) -> DataFrame:
    """Counts of works that have nothing to count; those of trees stay null for unparsed sentences."""
    tree_columns = {"sum_depth", "n_parsed_sentences"} | {f"n_{kind}" for kind in SENTENCE_KINDS}
    unparsed = "coalesce(n_sentences, 0) > 0 AND n_parsed_sentences IS NULL"
    return counts.selectExpr(
        "work_id",
        *(
            f"CASE WHEN {unparsed} THEN NULL ELSE coalesce({c}, 0L) END AS {c}" if c in tree_columns else f"coalesce({c}, 0L) AS {c}"
            for c in counts.columns
            if c != "work_id"
        ),
    )


def measured(counts: DataFrame) -> DataFrame:
    """Tidy rows (work_id, metric, value) of every measure; works without a parse have no tree rows."""
    return tidy(measure(counts, ALL), ALL)
