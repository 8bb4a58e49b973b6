"""The star schema: dimensions, normalized measurements, facts and the wide mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.functions.keys import surrogate_key
from stylograph.functions.lexicons import CONCEPT_OF_PREFIX
from stylograph.operators.reshape import column_values, pivot_max
from stylograph.operators.zscore import score, series_spread
from stylograph.session import checkpointed, lookup, stored

# Word counts below which a work is of the shorter kind.
PROSE_BANDS = (("short-story", 10_000), ("novella", 40_000))
LONGEST_BAND = "novel"



# --- dimensions -------------------------------------------------------------------------------


def dim_author(authors: DataFrame) -> DataFrame:
    """One row per author and set of attributes. Conflicting attributes give one key twice, which
    the uniqueness check reports."""
    return authors.select(
        surrogate_key("author").alias("author_key"), F.col("author").alias("name"), "tradition", "era", "is_self"
    ).distinct()


def dim_metric(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        surrogate_key("metric_name").alias("metric_key"),
        "metric_name",
        "display_name",
        "category",
        "unit",
        "higher_means",
        "description",
        "formula",
        "is_multivalue",
        "additivity",
    )


def prose_type(word_count: Column, bands=PROSE_BANDS, longest: str = LONGEST_BAND) -> Column:
    """Size band; an unknown count falls through to the longest."""
    band = F
    for name, below in bands:
        band = band.when(word_count < below, name)
    return band.otherwise(longest)


def dim_work(authors: DataFrame, stg_works: DataFrame, bands=PROSE_BANDS) -> DataFrame:
    """One row per catalogued work; a work that was not measured stays, without a word count."""
    return authors.join(stg_works.select("work_id", "word_count"), "work_id", "left").select(
        surrogate_key("work_id").alias("work_key"),
        surrogate_key("author").alias("author_key"),
        "work_id",
        "title",
        "word_count",
        prose_type(F.col("word_count"), bands).alias("prose_type"),
    )


# --- measurements -----------------------------------------------------------------------------


def concept(series: Column) -> Column:
    """The metric a series belongs to: its family's, or itself."""
    named = F
    for prefix, name in CONCEPT_OF_PREFIX.items():
        named = named.when(series.like(prefix + "%"), name)
    return named.otherwise(series)


def int_measurements_normalized(stg_measurements: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """Every measurement with its metric's key and its standard score within its series.

    Key and spread are properties of a series, so they are looked up from one small table. A series
    of no known metric keeps its rows with a null key, for the not-null check to find.
    """
    rows = stg_measurements.select("work_id", "metric_name", "value")
    metrics = dim_metric.select("metric_key", F.col("metric_name").alias("concept"))
    series = checkpointed(series_spread(rows, "value", "metric_name"))
    series = series.withColumn("concept", concept(F.col("metric_name"))).join(lookup(metrics), "concept", "left")
    series = series.select(F.col("metric_name").alias("_series"), "metric_key", "mean", "spread")
    return rows.join(lookup(series), F.col("metric_name").eqNullSafe(F.col("_series")), "left").select(
        "work_id", "metric_key", "metric_name", "value", score("value").alias("zscore")
    )


def fact_style_measurement(normalized: DataFrame, dim_work: DataFrame) -> DataFrame:
    """One row per catalogued work and series, with the keys of its dimensions."""
    return normalized.join(dim_work.select("work_id", "work_key", "author_key"), "work_id").select(
        surrogate_key("work_id", "metric_name").alias("measurement_key"),
        "work_key",
        "author_key",
        "metric_key",
        "metric_name",
        "value",
        "zscore",
    )


def mart_work_fingerprint(
    fact: DataFrame, dim_work: DataFrame, dim_author: DataFrame, series: list[str] | None = None
) -> DataFrame:
    """One row per work, one column of standard scores per series (sorted by name).

    Pivoted before the joins, so what is shuffled is one row per work instead of one per series.
    """
    series = column_values(fact, "metric_name") if series is None else sorted(series)
    wide = pivot_max(fact, ["work_key", "author_key"], "metric_name", "zscore", series)
    works = dim_work.select("work_key", "work_id", "title").repartition("work_key").distinct()
    authors = dim_author.select("author_key", F.col("name").alias("author")).distinct()
    return (
        wide.join(works, "work_key")
        .join(lookup(authors), "author_key")
        .select("work_key", "work_id", "title", "author_key", "author", *(F.col(f"`{s}`") for s in series))
    )


# --- vocabulary overlap -----------------------------------------------------------------------


def author_vocabulary(stg_vocab: DataFrame, dim_work: DataFrame, dim_author: DataFrame) -> DataFrame:
    """Distinct terms of every author, pooled over works."""
    works = dim_work.select("work_id", "author_key")
    authors = dim_author.select("author_key", "is_self").distinct()
    return (
        stg_vocab.select("work_id", "term")
        .join(works, "work_id")
        .select("author_key", "term")
        .distinct()
        .join(lookup(authors), "author_key")
    )


def int_vocab_jaccard(stg_vocab: DataFrame, dim_work: DataFrame, dim_author: DataFrame) -> DataFrame:
    """Overlap of every other author's vocabulary with the self author's: shared / combined terms.

    Others without shared terms get 0; others without any vocabulary have no row.
    """
    vocabulary = stored(author_vocabulary(stg_vocab, dim_work, dim_author))
    mine = vocabulary.where("is_self")
    my_size = mine.count()
    shared = mine.groupBy("term").agg(F.count("*").alias("mine"))
    joined = vocabulary.where(~F.col("is_self")).join(lookup(shared), "term", "left")
    sizes = joined.groupBy("author_key").agg(
        F.lit(my_size).cast("bigint").alias("my_vocab_size"),
        F.count("*").alias("their_vocab_size"),
        F.coalesce(F.sum("mine"), F.lit(0)).cast("bigint").alias("shared_terms"),
    )
    combined = F.col("my_vocab_size") + F.col("their_vocab_size") - F.col("shared_terms")
    return sizes.withColumn(
        "jaccard", F.col("shared_terms").cast("double") / F.nullif(combined, F.lit(0)).cast("double")
    )


# Salts of a term that very many authors use, and how many that is.
TERM_SALTS, FREQUENT_AUTHORS = 64, 10_000


def vocab_cosine(stg_vocab: DataFrame, dim_work: DataFrame, dim_author: DataFrame) -> DataFrame:
    """Likeness of every other author's vocabulary to the self authors', weighted: author_key, shared_terms, cosine.

    A term weighs how often an author uses it times ln(works / works that hold it), so a term that every work holds weighs
    nothing. Weights live in one row per term; the rows of a term that very many authors use are dealt over salts, and the term's
    row is repeated for each, so no term is a task's whole work. An author without any weight has a null cosine."""
    placed = stored(
        stg_vocab.select("work_id", "term", "term_count")
        .join(dim_work.select("work_id", "author_key"), "work_id")
        .groupBy("author_key", "work_id", "term").agg(F.sum("term_count").alias("n"))
    )
    n_works = placed.select("work_id").distinct().count()
    authors = dim_author.select("author_key", "is_self").distinct()
    pooled = stored(
        placed.groupBy("author_key", "term").agg(F.sum("n").alias("n"), F.count("*").alias("works")).join(lookup(authors), "author_key")
    )
    terms = pooled.groupBy("term").agg(
        F.log(F.lit(float(n_works)) / F.sum("works")).alias("idf"), F.coalesce(F.sum(F.when(F.col("is_self"), F.col("n"))), F.lit(0)).alias("mine"),
        (F.count("*") > FREQUENT_AUTHORS).alias("frequent"),
    )
    terms = stored(terms.select("term", "idf", (F.col("mine") * F.col("idf")).alias("my_weight"), "frequent"))
    my_norm = terms.agg(F.sqrt(F.sum(F.col("my_weight") * F.col("my_weight")))).first()[0]
    every = F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))
    salted = terms.withColumn("salt", F.explode(F.when(F.col("frequent"), every).otherwise(F.array(F.lit(0)))))
    frequent = lookup(terms.where("frequent").select("term", F.lit(True).alias("spread")))
    others = pooled.where(~F.col("is_self")).join(frequent, "term", "left")
    others = others.withColumn("salt", F.when(F.col("spread"), F.pmod(F.xxhash64("author_key"), F.lit(TERM_SALTS)).cast("int")).otherwise(0))
    weighed = others.join(salted, ["term", "salt"]).select(
        "author_key", (F.col("n") * F.col("idf")).alias("weight"), "my_weight", (F.col("my_weight") != 0).alias("shared")
    )
    sums = weighed.groupBy("author_key").agg(
        F.count_if(F.col("shared") & (F.col("weight") != 0)).alias("shared_terms"),
        F.sum(F.col("weight") * F.col("my_weight")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    norms = F.nullif(F.col("norm") * F.lit(my_norm).cast("double"), F.lit(0.0))
    return sums.select("author_key", "shared_terms", (F.col("dot") / norms).alias("cosine"))


def fact_vocab_overlap(jaccard: DataFrame, dim_author: DataFrame) -> DataFrame:
    """Author pairs (self, other): one for each self author, of whom there are few beside the rows they are paired with."""
    selves = lookup(dim_author.where("is_self").select(F.col("author_key").alias("author_key_a")).distinct())
    return jaccard.crossJoin(selves).select(
        "author_key_a",
        F.col("author_key").alias("author_key_b"),
        "my_vocab_size",
        "their_vocab_size",
        "shared_terms",
        "jaccard",
    ).select(surrogate_key("author_key_a", "author_key_b").alias("overlap_key"), "*")
