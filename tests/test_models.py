"""Star schema, scores, overlap, checks and reports on small tables."""

import pytest
from pyspark.sql import functions as F

from stylograph.operators import checks, reshape
from stylograph.operators.zscore import zscore
from stylograph.plans import models, reports, staging
from stylograph.sources import schemas, seeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def authors(spark):
    return spark.createDataFrame(
        [
            ("w1", "One", "me", "t", "now", True, "a"),
            ("w2", "Two, too", "you", "t", "then", False, "b"),
            ("w3", "Three", "you", "t", "then", False, "c"),
            ("w4", "Four", "them", "u", "then", False, "d"),
            ("w5", "Five", "silent", "u", "then", False, "e"),
        ],
        schemas.AUTHORS,
    )


def stg(spark, *counts):
    return spark.createDataFrame(list(counts), "work_id string, word_count long")


def test_prose_bands_and_spine(spark, authors):
    got = models.dim_work(authors, stg(spark, ("w1", 9_999), ("w2", 10_000), ("w3", 40_000), ("w4", 39_999)))
    assert rows(got.select("work_id", "prose_type", "word_count")) == [
        ("w1", "short-story", 9_999), ("w2", "novella", 10_000), ("w3", "novel", 40_000), ("w4", "novella", 39_999), ("w5", "novel", None),
    ]


def test_keys_keep_columns_apart(spark):
    df = spark.createDataFrame([("a-b", "c"), ("a", "b-c"), (None, "x"), ("", "x")], "a string, b string")
    assert df.select(models.surrogate_key("a", "b")).distinct().count() == 4


def test_conflicting_author_splits(spark, authors):
    conflicting = authors.union(authors.where("work_id = 'w2'").withColumn("era", F.lit("later")))
    dim = models.dim_author(conflicting)
    assert dim.count() == 5
    assert [r["n_rows"] for r in checks.unique(dim, "author_key").collect()] == [2]
    assert checks.unique(models.dim_author(authors), "author_key").count() == 0


def test_zscore(spark):
    df = spark.createDataFrame(
        [("m", 1.0), ("m", 3.0), ("flat", 0.1), ("flat", 0.1), ("flat", 0.1), (None, 5.0), (None, 7.0)], "metric string, value double"
    )
    assert rows(zscore(df, "value", "metric").select("metric", "zscore")) == sorted(
        [("m", -1.0), ("m", 1.0), ("flat", None), ("flat", None), ("flat", None), (None, -1.0), (None, 1.0)], key=repr
    )


def measurements(spark):
    values = [(w, m, float(v)) for w, v in (("w1", 1), ("w2", 2), ("w3", 3), ("gone", 6)) for m in ("punct_dash", "yules_k")]
    return spark.createDataFrame(values + [("w1", "novelty", 1.0)], "work_id string, metric_name string, value double")


def test_normalized_keeps_unmapped_series(spark):
    normalized = models.int_measurements_normalized(measurements(spark), models.dim_metric(seeds.seed_metrics(spark)))
    assert normalized.count() == 9
    assert rows(checks.not_null(normalized, "metric_key").select("metric_name")) == [("novelty",)]
    keys = dict(rows(normalized.select("metric_name", "metric_key").distinct()))
    assert keys["punct_dash"] == normalized.select(models.surrogate_key(F.lit("punctuation_frequency"))).first()[0]
    stats = normalized.where("metric_name = 'yules_k'").agg(F.avg("zscore"), F.stddev_pop("zscore")).first()
    assert stats[0] == pytest.approx(0) and stats[1] == pytest.approx(1)


def test_fact_and_mart(spark, authors):
    normalized = models.int_measurements_normalized(measurements(spark), models.dim_metric(seeds.seed_metrics(spark)))
    dim_work, dim_author = models.dim_work(authors, stg(spark)), models.dim_author(authors)
    fact = models.fact_style_measurement(normalized, dim_work)
    assert fact.count() == 7  # the uncatalogued work is dropped
    mart = models.mart_work_fingerprint(fact, dim_work, dim_author)
    assert mart.columns == ["work_key", "work_id", "title", "author_key", "author", "novelty", "punct_dash", "yules_k"]
    got = {r["work_id"]: r for r in mart.collect()}
    assert set(got) == {"w1", "w2", "w3"}
    assert got["w2"]["novelty"] is None and got["w2"]["author"] == "you"
    assert got["w3"]["yules_k"] == 0.0
    assert rows(reports.authors(mart)) == [("me",), ("you",)]
    assert rows(checks.incomplete(fact, "work_key", "metric_key", 2)) == []
    # A mart with the four shown series.
    listing = mart.select("*", *(F.lit(1.0).alias(c) for c in ("mean_word_length", "mean_sentence_length", "adjective_density")))
    assert [r["title"] for r in reports.works(listing, "y%").collect()] == ["Three", "Two, too"]
    metrics = models.dim_metric(seeds.seed_metrics(spark))
    summary = reports.author_metrics(fact, metrics, dim_author, ["yules_k", "jaccard"], "%")
    assert [(r["author"], r["value"]) for r in summary.collect()] == [("me", 1.0), ("you", 2.5)]
    assert reports.author_metrics(fact, metrics, dim_author, [], "%").count() == 0
    assert len(reports.first_page(fact, 3).collect()) == 3


def vocab(spark, **terms):
    return spark.createDataFrame([(w, t, 1) for w, ts in terms.items() for t in ts.split()], "work_id string, term string, term_count long")


def test_jaccard(spark, authors):
    terms = vocab(spark, w1="sorcerer journey glass horizon", w2="sorcerer magic", w3="magic journey tower", w4="nothing shared")
    dim_work, dim_author = models.dim_work(authors, stg(spark)), models.dim_author(authors)
    overlap = models.int_vocab_jaccard(terms, dim_work, dim_author)
    names = dict(rows(dim_author.select("author_key", "name")))
    got = {names[r["author_key"]]: tuple(r)[1:] for r in overlap.collect()}
    assert got == {"you": (4, 4, 2, 2 / 6), "them": (4, 2, 0, 0.0)}  # an author without vocabulary has no row
    fact = models.fact_vocab_overlap(overlap, dim_author)
    assert {names[r["author_key_a"]] for r in fact.collect()} == {"me"}
    assert fact.count() == 2 and checks.unique(fact, "overlap_key").count() == 0
    nobody = dim_author.where("not is_self")
    assert models.fact_vocab_overlap(overlap, nobody).count() == 0


def test_unknown_self_drops_from_both_sides(spark, authors):
    unknown = authors.withColumn("is_self", F.when(F.col("author") != "them", F.col("is_self")))
    dim_work, dim_author = models.dim_work(unknown, stg(spark)), models.dim_author(unknown)
    overlap = models.int_vocab_jaccard(vocab(spark, w1="a b", w2="a", w4="a"), dim_work, dim_author)
    assert overlap.count() == 1


def test_hot_groups(spark, authors):
    """A third of all rows on one author, term or key: same answers, by counting."""
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "w2").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("work_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("term"),
        F.lit(1).cast("bigint").alias("term_count"),
    )
    terms = hot.union(vocab(spark, w1="a b"))
    dim_work, dim_author = models.dim_work(authors, stg(spark)), models.dim_author(authors)
    (row,) = models.int_vocab_jaccard(terms, dim_work, dim_author).collect()
    theirs = hot.where("work_id = 'w2'").select("term").distinct().count()
    assert (row["my_vocab_size"], row["their_vocab_size"], row["shared_terms"]) == (2, theirs, 1)
    assert rows(checks.relationships(hot, "work_id", hot.where("work_id <> 'w2'"), "work_id")) == [("w2", 1000)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), (None, None), (None, -0.1), ("b", 1.0)], "k string, v double")
    assert rows(checks.unique(df, "k")) == [("a", 2)]
    assert checks.not_null(df, "k").count() == 2
    assert rows(checks.accepted_values(df, "k", ["a"])) == [("b", 1)]
    assert rows(checks.accepted_range(df, "v", 0, 1).select("v")) == [(-0.1,), (1.5,)]
    assert rows(checks.incomplete(df.where("k is not null"), "k", "v", 2)) == [("b", 1)]


def test_pivot_from_data(spark):
    df = spark.createDataFrame([(1, "it's", 2.0), (1, "it's", 3.0), (2, "b", 1.0)], "id int, name string, value double")
    got = reshape.pivot_max(df, ["id"], "name", "value")
    assert got.columns == ["id", "b", "it's"]
    assert rows(got) == [(1, None, 3.0), (2, 1.0, None)]
    with pytest.raises(ValueError):
        reshape.column_values(df, "name", limit=1)


def test_staging_casts(spark):
    raw = spark.createDataFrame([("w", "m", "1.5", "2024-01-01 00:00:00")], "work_id string, metric string, value string, loaded_at string")
    assert staging.stg_measurements(raw).dtypes == [
        ("work_id", "string"), ("metric_name", "string"), ("value", "double"), ("loaded_at", "timestamp_ntz"),
    ]
