"""Measures that need only the text: counted inside the row, merged by integer sums.

A work is one row, so everything a measure needs is already in one place. The counts below are
array expressions over that row: no token is exploded or shuffled, and a corpus of ordinary works
is one map-only pass. A work too long to be held as word arrays is cut into pieces at token ends; their
counts are integers, a composable quote switch and the sizes of sentences that touch a cut, so merging them is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.functions.arrays import chained_switch, let, long_sum, quote_switch, term_counts
from stylograph.functions.lexicons import ARCHAIC_WORDS, FUNCTION_WORDS, PUNCTUATION_GROUPS
from stylograph.functions.prose import CLITIC, MARK, WORD, has_apostrophe, sentences, word_texts
from stylograph.operators import long_texts
from stylograph.operators.cleaning import clean_markdown
from stylograph.operators.pieces import IN_ROW_CHARS
from stylograph.session import checkpointed, scattered

# Pieces composed per task when a longer work is merged.
PIECES_PER_BLOCK = 4096

FUNCTION_WORD_COUNTS = tuple(f"n_funcword_{word}" for word in FUNCTION_WORDS)
PUNCTUATION_COUNTS = tuple(f"n_punct_{group}" for group in PUNCTUATION_GROUPS)
SCALAR_COUNTS = ("n_words", "n_letters", "n_sentences", "sum_sq_sentence_words", "n_archaic", "n_clitics")
ADDITIVE_COUNTS = SCALAR_COUNTS + FUNCTION_WORD_COUNTS + PUNCTUATION_COUNTS
RICHNESS_COUNTS = ("n_types", "n_hapax", "sum_sq_types")


def _function_words(terms: Column) -> Column:
    """Array of one count per function word, in the list's order."""
    tracked = F.map_from_entries(F.filter(terms, lambda t: t["term"].isin(*FUNCTION_WORDS)))
    words = F.split(F.lit(" ".join(FUNCTION_WORDS)), " ")
    return let(tracked, lambda found: F.transform(words, lambda w: F.coalesce(F.try_element_at(found, w), F.lit(0).cast("bigint"))))


def _punctuation(text: Column) -> Column:
    """Array of one count per punctuation group, in the table's order."""
    groups = F.array(*(F.split(F.lit(" ".join(marks)), " ") for marks in PUNCTUATION_GROUPS.values()))

    def counted(found: Column) -> Column:
        return F.transform(groups, lambda marks: long_sum(marks, lambda m: F.size(found) - F.size(F.array_remove(found, m))))

    return let(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), counted)


def text_counts(text: Column) -> Column:
    """All counts of a text as one struct."""

    def of_sentences(raw: Column, body: Column, by_sentence: Column) -> Column:
        words = F.flatten(by_sentence)
        clitics = F.when(has_apostrophe(raw), F.regexp_count(raw, F.lit(CLITIC))).otherwise(0)
        archaic = lambda terms: F.filter(terms, lambda t: t["term"].isin(*ARCHAIC_WORDS))
        return let(
            term_counts(_lower(words)),
            lambda terms: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("n_letters"),
                F.size(by_sentence).cast("bigint").alias("n_sentences"),
                long_sum(by_sentence, lambda s: F.size(s).cast("bigint") * F.size(s)).alias("sum_sq_sentence_words"),
                long_sum(archaic(terms), lambda t: t["n"]).alias("n_archaic"),
                clitics.cast("bigint").alias("n_clitics"),
                _function_words(terms).alias("function_words"),
                _punctuation(raw).alias("punctuation"),
                terms.alias("terms"),
                quote_switch(body, F.size(words).cast("bigint")).alias("switch"),
            ),
        )

    def of_text(raw: Column) -> Column:
        return let(
            _without_clitics(raw),
            lambda b: let(F.transform(sentences(b), word_texts), lambda by_sentence: of_sentences(raw, b, by_sentence)),
        )

    return let(text, of_text)


def _without_clitics(text: Column) -> Column:
    # A clitic is no word. An apostrophe in its place leaves sentence ends where they were.
    return F.when(has_apostrophe(text), F.regexp_replace(text, CLITIC, "'")).otherwise(text)


def _lower(words: Column) -> Column:
    # Lower-cased as one string, not word by word.
    return F.array_remove(F.split(F.lower(F.array_join(words, " ")), " "), "")


def piece_counts(pieces: DataFrame, counts: Column) -> DataFrame:
    """Counts of every row's text beside the columns other than ``text``: the additive counts,
    ``terms`` (array of lower-cased word and count) and ``switch`` (see ``quote_switch``)."""
    rest = [c for c in pieces.columns if c != "text"]
    return pieces.select(*rest, counts.alias("c")).selectExpr(
        *rest,
        *(f"c.{name} AS {name}" for name in SCALAR_COUNTS),
        *(f"c.function_words[{i}] AS {name}" for i, name in enumerate(FUNCTION_WORD_COUNTS)),
        *(f"c.punctuation[{i}] AS {name}" for i, name in enumerate(PUNCTUATION_COUNTS)),
        "c.terms AS terms",
        "c.switch AS switch",
    )


def surface_counts(works: DataFrame, in_row_chars: int = IN_ROW_CHARS, clean: bool = True) -> DataFrame:
    """All counts per ``work_id`` of ``works(work_id, text)``, one row per work.

    Works up to ``in_row_chars`` are finished inside their row; longer ones, if there are any, are cut into pieces (see
    ``long_texts``). The length is taken before cleaning, which only shortens, so the filter stays at the scan.
    """
    short, pieces = split_by_length(works, in_row_chars)
    text = clean_markdown(F.col("text")) if clean else F.col("text")
    in_row = piece_counts(short.withColumn("text", text), text_counts(F.col("text"))).selectExpr(
        "work_id",
        *ADDITIVE_COUNTS,
        "CAST(size(terms) AS BIGINT) AS n_types",
        "CAST(size(filter(terms, t -> t.n = 1)) AS BIGINT) AS n_hapax",
        "aggregate(terms, 0L, (s, t) -> s + t.n * t.n) AS sum_sq_types",
        "switch.in0 AS n_quoted",
    )
    return in_row if pieces is None else in_row.unionByName(surface_counts_of_pieces(pieces, clean))


def split_by_length(works: DataFrame, in_row_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Works of up to ``in_row_chars``, and the pieces of longer ones, or nothing if there are none."""
    works = works.select("work_id", "text")
    size = F.length("text")
    long = works.where(size > in_row_chars)
    return works.where(size <= in_row_chars), None if long.isEmpty() else long_texts.in_pieces(long, max(1, min(in_row_chars, long_texts.PIECE_CHARS)))


def surface_counts_of_pieces(pieces: DataFrame, clean: bool = True) -> DataFrame:
    """As ``surface_counts``, for works given as ``pieces(work_id, piece_no, text)`` cut at any character: counted where they
    lie, merged by integer sums, the quote switch, and the sentences that touch a cut."""
    pieces = long_texts.cleaned_pieces(pieces) if clean else pieces
    pieces = scattered(long_texts.moved_cuts(pieces, long_texts.AFTER_TOKEN), "work_id", "piece_no")
    sizes = let(F.col("text"), lambda text: long_texts.part_sizes(_without_clitics(text), WORD))
    # Read several times by the merge, counted once.
    return merged_counts(checkpointed(piece_counts(pieces.withColumn("sizes", sizes), text_counts(F.col("text")))))


def sentence_lengths(works: DataFrame, in_row_chars: int = IN_ROW_CHARS, clean: bool = True) -> DataFrame:
    """Sparse histogram of sentence lengths in words: work_id, length, n. Counted in the row, as type frequencies are."""
    short, pieces = split_by_length(works, in_row_chars)
    prose = clean_markdown(F.col("text")) if clean else F.col("text")
    sizes = let(prose, lambda text: F.transform(sentences(_without_clitics(text)), lambda s: F.regexp_count(s, F.lit(WORD)).cast("long")))
    rows = short.select("work_id", F.explode(term_counts(sizes)).alias("t")).select("work_id", F.col("t.term").alias("length"), "t.n")
    if pieces is None:
        return rows
    split = long_texts.numbered_sentences(long_texts.cleaned_pieces(pieces) if clean else pieces)
    length = F.regexp_count(_without_clitics(F.col("text")), F.lit(WORD)).cast("long")
    return rows.unionByName(split.groupBy("work_id", length.alias("length")).agg(F.count("*").alias("n")))


def word_counts(works: DataFrame, clean: bool = True) -> DataFrame:
    """Words per work of ``works(work_id, text)``, one row per work."""
    prose = clean_markdown(F.col("text")) if clean else F.col("text")
    words = let(prose, lambda text: F.regexp_count(_without_clitics(text), F.lit(WORD)))
    return works.select("work_id", words.cast("bigint").alias("n_words"))


def type_frequencies(works: DataFrame, in_row_chars: int = IN_ROW_CHARS, clean: bool = True) -> DataFrame:
    """Occurrences of every lower-cased word: work_id, term, n. Counted in the row; only pieces of
    works above ``in_row_chars`` are added up across rows."""
    short, pieces = split_by_length(works, in_row_chars)
    in_row = _exploded_terms(short.withColumn("text", clean_markdown(F.col("text"))) if clean else short)
    return in_row if pieces is None else in_row.unionByName(type_frequencies_of_pieces(pieces, clean))


def _exploded_terms(texts: DataFrame) -> DataFrame:
    terms = let(F.col("text"), lambda text: term_counts(_lower(word_texts(_without_clitics(text)))))
    return texts.select("work_id", F.explode(terms).alias("t")).select("work_id", "t.term", "t.n")


def type_frequencies_of_pieces(pieces: DataFrame, clean: bool = True) -> DataFrame:
    """As ``type_frequencies``, for works given as pieces cut at any character."""
    pieces = long_texts.cleaned_pieces(pieces) if clean else pieces
    pieces = scattered(long_texts.moved_cuts(pieces, long_texts.AFTER_TOKEN), "work_id", "piece_no")
    return _exploded_terms(pieces).groupBy("work_id", "term").agg(F.sum("n").alias("n"))


def merged_counts(pieces: DataFrame) -> DataFrame:
    """Counts per work from counted pieces ``(work_id, piece_no, ..., terms, switch)``; with ``sizes`` (see
    ``long_texts.part_sizes``) a sentence may lie in several pieces, without it sentences end with their piece.

    First per (work, block of consecutive pieces), then per work: a work holding most of the corpus
    is spread over its blocks, and what reaches its last task is one row per block.
    """
    block = F.floor(F.col("piece_no") / PIECES_PER_BLOCK)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "switch"))), lambda p: p["switch"])

    def level(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            *(F.expr(f"sum({c}) AS {c}") for c in ADDITIVE_COUNTS),
            chained_switch(in_order).alias("switch"),
        )

    placed = pieces.select("work_id", block.alias("block"), F.col("piece_no").alias("at"), "switch", *ADDITIVE_COUNTS)
    counts = level(level(placed, "work_id", "block").withColumnRenamed("block", "at"), "work_id")
    richness = term_richness(
        pieces.select("work_id", F.explode("terms").alias("t")).select("work_id", "t.term", "t.n")
    )
    if "sizes" in pieces.columns:
        sums = long_texts.sentence_sums(pieces.select("work_id", "piece_no", "sizes"))
        counts = counts.drop("n_sentences", "sum_sq_sentence_words").join(sums, "work_id")
    return counts.join(richness, "work_id", "left").selectExpr(
        "work_id", *ADDITIVE_COUNTS, *(f"coalesce({c}, 0L) AS {c}" for c in RICHNESS_COUNTS), "switch.in0 AS n_quoted"
    )


def term_richness(term_counts: DataFrame) -> DataFrame:
    """Types, hapaxes and sum of squared frequencies per work from partial counts ``(work_id, term, n)``."""
    return (
        term_counts.groupBy("work_id", "term")
        .agg(F.sum("n").alias("n"))
        .groupBy("work_id")
        .agg(
            F.count("*").alias("n_types"),
            F.count_if(F.col("n") == 1).alias("n_hapax"),
            F.sum(F.col("n") * F.col("n")).alias("sum_sq_types"),
        )
    )
