"""From counts to measures. Every measure of an empty work is 0.0, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.functions.lexicons import (
    FUNCTION_WORD_SERIES,
    FUNCTION_WORDS,
    PUNCTUATION_GROUPS,
    PUNCTUATION_SERIES,
    SENTENCE_KINDS,
    SENTENCE_SERIES,
)


def ratio(part: str, whole: str) -> str:
    """part / whole; 0 of nothing; null only where the whole was not counted."""
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) WHEN {whole} = 0 THEN 0.0D END"


# 10^4 (S2 - N) / N^2: repetition raises it, whatever the length.
YULES_K = """
CASE WHEN n_words > 0
     THEN 10000.0D * (CAST(sum_sq_types AS DOUBLE) - n_words) / (CAST(n_words AS DOUBLE) * n_words) ELSE 0.0D END"""

# 100 ln N / (1 - V1/V); 0 where every type occurs once.
HONORE_R = """
CASE WHEN n_hapax < n_types
     THEN 100.0D * ln(CAST(n_words AS DOUBLE)) / (1.0D - CAST(n_hapax AS DOUBLE) / CAST(n_types AS DOUBLE)) ELSE 0.0D END"""

# Population deviation from exact integer sums: sqrt(n * sum(x^2) - sum(x)^2) / n.
SENTENCE_LENGTH_STDEV = """
CASE WHEN n_sentences > 1
     THEN sqrt(CAST(CAST(n_sentences AS DECIMAL(19, 0)) * CAST(sum_sq_sentence_words AS DECIMAL(19, 0))
                    - CAST(n_words AS DECIMAL(19, 0)) * CAST(n_words AS DECIMAL(19, 0)) AS DOUBLE)) / n_sentences
     ELSE 0.0D END"""

# Registry: a measure is a name and an expression over the counts. An entry more is a series more.
LEXICAL = {
    "mean_word_length": ratio("n_letters", "n_words"),
    "yules_k": YULES_K,
    "archaic_word_rate": ratio("n_archaic", "n_words"),
    "honore_r": HONORE_R,
    **{series: ratio(f"n_funcword_{word}", "n_words") for series, word in zip(FUNCTION_WORD_SERIES, FUNCTION_WORDS)},
}
RHYTHM = {
    "mean_sentence_length": ratio("n_words", "n_sentences"),
    "sentence_length_stdev": SENTENCE_LENGTH_STDEV,
}
TREES = {
    "mean_parse_tree_depth": ratio("sum_depth", "n_parsed_sentences"),
    **{series: ratio(f"n_{kind}", "n_parsed_sentences") for series, kind in zip(SENTENCE_SERIES, SENTENCE_KINDS)},
}
MECHANICAL = {
    **{series: ratio(f"n_punct_{group}", "n_words") for series, group in zip(PUNCTUATION_SERIES, PUNCTUATION_GROUPS)},
    "contraction_rate": ratio("n_clitics", "n_words"),
}
STRUCTURAL = {"dialogue_narration_ratio": ratio("n_quoted", "n_words")}
SPEECH = {
    "adjective_density": ratio("n_adjectives", "n_words"),
    "adverb_density": ratio("n_adverbs", "n_words"),
}
SURFACE = {**LEXICAL, **RHYTHM, **MECHANICAL, **STRUCTURAL}
ALL = {**LEXICAL, **RHYTHM, **TREES, **MECHANICAL, **STRUCTURAL, **SPEECH}


def measure(counts: DataFrame, measures: dict[str, str], *keep: str) -> DataFrame:
    """One wide row per work: ``work_id``, the kept columns and one double per measure."""
    return counts.selectExpr("work_id", *keep, *(f"{sql} AS {name}" for name, sql in measures.items()))


def tidy(wide: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Rows (work_id, metric, value), one per work and measured series. A narrow expansion, no shuffle."""
    return wide.unpivot("work_id", list(measures), "metric", "value").where(F.col("value").isNotNull())
