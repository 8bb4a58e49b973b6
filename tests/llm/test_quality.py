import math
import re
import unicodedata
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from stylograph.llm import quality
from stylograph.llm.queries import ORACLES, QUERIES

from .conftest import DATA, ODD


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    judged = found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert judged > 0.97


def plain_statistics(text):
    chars, words, lines = len(text), [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    kinds = [unicodedata.category(c) for c in text]
    letters = sum(k[0] == "L" for k in kinds)
    spread = lambda part, whole, usual, more: math.asin(math.sqrt(min((part + usual * more) / (whole + more), 1)))
    blanks = sum(c in " \t\n\x0b\f\r" for c in text)
    marks = sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r.," for k, c in zip(kinds, text))
    return [
        math.log((chars + 120) / (len(words) + 20)), spread(letters, chars, 0.8, 120), spread(kinds.count("Lu"), letters, 0.03, 120),
        spread(sum(k[0] == "N" for k in kinds), chars, 0, 120), spread(marks, chars, 0, 120), spread(blanks, chars, 0.17, 120),
        spread(text.count(".") + text.count(","), len(words), 0.15, 20), math.log((len(set(words)) + 20) / (len(words) + 20)),
        spread(sum(a == b for a, b in zip(words, words[1:])), len(words), 0.01, 20), math.log((len(set(lines)) + 1) / (len(lines) + 1)),
    ]


def test_scores_equal_a_plain_discriminant(spark):
    """Statistics in Python, means and covariances by numpy over all labelled rows, densities by inverse and determinant."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    learnt = [i for i in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    odds = {}
    for label in (0, 1):
        x = np.array([rows[i] for i in learnt if labels[i] == label])
        covariance = np.cov(x.T, bias=True)
        shrunk = 0.9 * covariance + 0.1 * np.diag(np.diag(covariance)) + 2.5e-3 * np.eye(x.shape[1])
        inverse, weight = np.linalg.inv(shrunk), math.log(len(x) / len(learnt)) - 0.5 * np.linalg.slogdet(shrunk)[1]
        for i, row in rows.items():
            away = np.array(row) - x.mean(0)
            odds[i] = odds.get(i, 0) + (1 if label else -1) * (weight - 0.5 * away @ inverse @ away)
    found = {r.doc_id: r for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert set(found) == set(rows)
    for i, r in found.items():
        want = 1 / (1 + math.exp(-max(-500, min(500, odds[i]))))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_keep_good_learns_the_same_with_few_and_many_labels(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    want = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.5").collect()}
    for most in (1_000_000, 1):
        monkeypatch.setattr(quality, "BROADCAST_IDS", most)
        assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == want


def test_labels_and_ids_do_not_reach_the_score(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    found = quality.classify(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1  # null and empty texts


def test_without_both_classes_nothing_is_rejected(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, labels).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(odd, labels).collect() and quality.keep_good(odd, labels).columns == odd.columns


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
