"""Published versions, appended loads, groups of works, files by ranges, chunks over rows."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stylograph.operators import checks, long_texts, measures, surface
from stylograph.operators.pieces import GLUE, chunks
from stylograph.plans import models, pooled, warehouse
from stylograph.plans.appending import Appended, mean_and_spread
from stylograph.plans.warehouse import MART_CHECKS, Check
from stylograph.session import stored
from stylograph.sources import landing, works as work_files
from stylograph.sources.releases import Releases

from tests.test_long_texts import cut_anywhere, marked_texts
from tests.test_sources import corpus, manifest  # noqa: F401


def test_readers_see_whole_published_versions_only(spark, tmp_path):
    releases = Releases(spark, str(tmp_path))
    assert releases.current() is None and releases.listed().count() == 0
    first = releases.draft()
    first.write("a", spark.range(3))
    assert releases.current() is None
    assert releases.publish(first, "one") == 1
    second = releases.draft()
    second.write("a", spark.range(5))
    assert releases.current().read("a").count() == 3 and releases.note() == "one"
    bad = spark.createDataFrame([("k", 2)], "kind string, violations long")
    assert not releases.publish_checked(second, bad) and releases.current().read("a").count() == 3
    assert releases.publish_checked(second, bad.withColumn("violations", F.lit(0))) and releases.current().read("a").count() == 5
    assert [r.number for r in releases.listed().orderBy("number").collect()] == [1, 2]


def test_folded_checks_find_what_single_checks_find(spark, tmp_path):
    tables = landing.Tables(spark, str(tmp_path))
    tables.write("t", spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.5), (None, "c", None), (2, None, -1.0), (3, "c", 2.0)], "k long, v string, x double"))
    tables.write("p", spark.createDataFrame([(1,), (1,), (None,), (4,)], "id long"))
    wanted = (
        Check("unique", "t", "k"), Check("not_null", "t", "k"), Check("not_null", "t", "v"), Check("accepted_values", "t", "v", (["a"],)),
        Check("relationships", "t", "k", ("p", "id")), Check("accepted_range", "t", "x", (0, 1)), Check("accepted_range", "t", "x", (None, 1)),
        Check("unique", "p", "id"), Check("incomplete", "t", "k", ("v", 1)), Check("unique", "t", "v"), Check("relationships", "p", "id", ("t", "k")),
    )
    found = {}
    for r in warehouse.run_checks(tables, wanted).collect():
        found.setdefault((r.kind, r.table_name, r.column_name), []).append(r.violations)
    want = {}
    for c in wanted:
        want.setdefault((c.kind, c.table, c.column), []).append(c.violations(tables).count())
    assert found == want
    assert checks.value_counts(tables.read("t"), "k").count() == 3 and len(MART_CHECKS) == 36


def test_a_missing_count_is_an_error(spark, tmp_path):
    counts = spark.createDataFrame([("w", 5)], "work_id string, n_words long")
    vocab = spark.createDataFrame([], "work_id string, term string, term_count long")
    with pytest.raises(Exception, match="n_letters|UNRESOLVED"):
        warehouse.land_counts(landing.Tables(spark, str(tmp_path)), counts, vocab, datetime(2024, 1, 1), measures.SURFACE)


def rows_of(spark, values):
    return spark.createDataFrame(values, "work_id string, metric string, value double")


def test_appended_loads_equal_one_load(spark, tmp_path):
    chosen = random.Random(2)
    works = [f"w{n}" for n in range(12)]
    value = {(w, m): chosen.choice([0.0, 0.1, chosen.random() * 10_000]) for w in works for m in ("a", "b")} | {(w, "flat"): 0.1 for w in works}
    term = {(w, t): chosen.randint(1, 5) for w in works for t in "xyz" if chosen.random() < 0.6}
    authors = spark.createDataFrame([(w, f"au{int(w[1:]) % 3}") for w in works], "work_id string, author string")

    def load(into, some, day, factor=1):
        some = set(some)
        measured = rows_of(spark, [(w, m, v * factor) for (w, m), v in value.items() if w in some])
        vocab = spark.createDataFrame([(w, t, n * factor) for (w, t), n in term.items() if w in some], "work_id string, term string, term_count long")
        return into.load(measured, vocab, authors, datetime(2024, 1, day))

    one, many = (Appended(Releases(spark, str(tmp_path / name))) for name in ("one", "many"))
    assert many.scores().count() == 0 and many.last_load() is None
    assert load(one, works, 1)
    assert load(many, works[:5], 1, 3) and load(many, works[3:8], 2) and not load(many, works[3:8], 2, 7) and load(many, works[:3] + works[8:], 3)
    assert not load(many, works, 2)
    assert many.last_load() == datetime(2024, 1, 3)

    def result(into):
        return {(r.work_id, r.metric): (r.value, r.zscore) for r in into.scores().collect()}, {tuple(r) for r in into.terms().collect()}

    assert result(one) == result(many)
    scores, _ = result(many)
    assert len(scores) == len(value) and all(z is None for (_, m), (_, z) in scores.items() if m == "flat")
    mean = sum(v for (_, m), v in value.items() if m == "a") / 12
    spread = math.sqrt(sum((v - mean) ** 2 for (_, m), v in value.items() if m == "a") / 12)
    for (_, m), (v, z) in scores.items():
        assert m != "a" or math.isclose(z, (v - mean) / spread, rel_tol=1e-6, abs_tol=1e-9)


def test_no_spread_is_null():
    from decimal import Decimal

    assert mean_and_spread(3, Decimal("0.3"), Decimal("0.03")) == (pytest.approx(0.1), None)
    assert mean_and_spread(2, Decimal("4"), Decimal("10")) == (2.0, 1.0)


def test_pooled_measures_are_those_of_the_joined_text(spark):
    texts = [("a", "One word. Two words here.", "x", "en"), ("b", "One more word, one.", "x", None), ("c", "Drei Wörter hier.", "y", "de"), ("d", "", "y", "de")]
    works = spark.createDataFrame([t[:2] for t in texts], "work_id string, text string")
    groups = spark.createDataFrame([(t[0], t[2], t[3]) for t in texts], "work_id string, author string, lang string")
    found = pooled.pooled_measures(
        surface.surface_counts(works), surface.type_frequencies(works), groups, {"work": "work_id", "author": "author", "language": "lang"}, measures.SURFACE
    ).collect()
    members = {("total", ""): texts}
    for t in texts:
        for level, key in (("work", t[0]), ("author", t[2]), ("language", t[3])):
            members.setdefault((level, key), []).append(t)
    assert {(r.level, r.key) for r in found} == set(members)
    joined = spark.createDataFrame([(f"{level}/{key}", "\n\n".join(t[1] for t in ts)) for (level, key), ts in members.items()], "work_id string, text string")
    want = {r.work_id: r.asDict() for r in measures.measure(surface.surface_counts(joined), measures.SURFACE).collect()}
    for r in found:
        assert r.n_works == len(members[r.level, r.key])
        for name in measures.SURFACE:
            assert math.isclose(r[name], want[f"{r.level}/{r.key}"][name], rel_tol=1e-12, abs_tol=1e-12), (r.level, r.key, name)


def test_histogram_and_quantiles(spark):
    chosen = random.Random(4)
    lengths = {g: [chosen.randint(0, 40) for _ in range(n)] for g, n in (("x", 1), ("y", 10), ("z", 333))}
    sparse = spark.createDataFrame([(g, n, v.count(n)) for g, v in lengths.items() for n in set(v)], "author string, length long, n long")
    for r in pooled.exact_quantiles(sparse, "author", {"q10": "0.1", "q50": "0.5", "q100": "1"}).collect():
        values = sorted(lengths[r.author])
        assert r.n_sentences == len(values)
        assert (r.q10, r.q50, r.q100) == tuple(values[-(-len(values) * q // 10) - 1] for q in (1, 5, 10))
    dense = pooled.dense_histogram(sparse, "author", 5).collect()
    for g, values in lengths.items():
        assert sorted((r.bucket, r.n) for r in dense if r.author == g) == [(b, sum(b <= v < b + 5 for v in values)) for b in range(0, max(values) + 1, 5)]
    works = spark.createDataFrame([("w", "One. Two words. " * 50 + "And three words!")], "work_id string, text string")
    whole = {tuple(r) for r in surface.sentence_lengths(works).collect()}
    assert whole == {("w", 1, 50), ("w", 2, 50), ("w", 3, 1)} == {tuple(r) for r in surface.sentence_lengths(works, in_row_chars=100).collect()}


def test_cosine_with_salted_terms(spark, monkeypatch):
    chosen = random.Random(5)
    works = {f"w{n}": f"au{n % 7}" for n in range(21)}
    vocab = [(w, t, chosen.randint(1, 9)) for w in works for t in ("all", "a", "b", "c", "d") if t == "all" or chosen.random() < 0.5]
    vocab = [v for v in vocab if works[v[0]] != "au3" or v[1] == "all"]
    frame = spark.createDataFrame(vocab, "work_id string, term string, term_count long")
    authors = spark.createDataFrame([(w, "t", a, "x", "y", a == "au0", "p") for w, a in works.items()], "work_id string, title string, author string, tradition string, era string, is_self boolean, path string")
    dims = models.dim_work(authors, spark.createDataFrame([], "work_id string, word_count long")), models.dim_author(authors)
    df = {t: len({w for w, u, _ in vocab if u == t}) for _, t, _ in vocab}
    weight = {}
    for w, t, n in vocab:
        weight[works[w], t] = weight.get((works[w], t), 0) + n * math.log(21 / df[t])
    norm = lambda a: math.sqrt(sum(x * x for (b, _), x in weight.items() if b == a))
    for least in (10_000, 1):
        monkeypatch.setattr(models, "FREQUENT_AUTHORS", least)
        found = {r.author_key: r for r in models.vocab_cosine(frame, *dims).collect()}
        assert len(found) == 6
        for key, name in ((r.author_key, r.name) for r in dims[1].collect() if r.name != "au0"):
            dot = sum(x * weight.get(("au0", t), 0) for (a, t), x in weight.items() if a == name)
            if name == "au3":
                assert found[key].cosine is None and found[key].shared_terms == 0
            else:
                assert math.isclose(found[key].cosine, dot / norm(name) / norm("au0"), rel_tol=1e-9)


def joined(pieces):
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"])
    rows = pieces.groupBy("work_id").agg(F.array_join(in_order, "").alias("text"), F.max(F.length("text")).alias("longest"))
    return {r.work_id: (r.text, r.longest) for r in rows.collect()}


def test_works_from_files_in_pieces(spark, corpus, tmp_path):  # noqa: F811
    got = {w: t for w, (t, _) in joined(work_files.read_pieces(spark, corpus, manifest(spark))).items()}
    assert got == {"n": "intro\n\ntwo\n\n\nten", "c": "cats\r\n\nmore"}
    chosen = random.Random(6)
    words = lambda n: "".join(chosen.choice(["word ", "é ", "\n", "\r\n", "\n\n", "漢字"]) for _ in range(n))
    files = {"a/Chapter-1.md": words(3_000), "a/Chapter-2.md": "", "a/Chapter-10.md": words(500) + "\n", "b.md": "x" * 9_000, "c.md": "", "a/other.md": "\n", "d/e.md": "\n\n"}
    root = str(tmp_path / "made up")
    rows = spark.createDataFrame(list(files.items()), "path string, text string").repartition(3)
    assert work_files.write_files(rows, root) == len(files) == work_files.write_files(rows, root)
    places = spark.createDataFrame([("a", "a/"), ("b", "b.md"), ("c", "c.md"), ("d", "d"), ("x", "none")], "work_id string, path string")
    want = {r.work_id: r.text for r in work_files.assemble(work_files.chapters(work_files.read_files(spark, root), places)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2_000)
    try:
        found = joined(work_files.read_pieces(spark, root, places, chars=300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {w: t for w, (t, _) in found.items()} == want
    assert all(longest <= 650 for _, longest in found.values())


@pytest.mark.parametrize("size", [1, 5, 1_000])
def test_files_by_ranges_without_a_list_on_the_driver(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(work_files, "RANGE_BYTES", size)
    root = str(tmp_path / "files")
    files = {"a/Chapter-1.md": "é漢😀x\n\r\n" * 9, "a/Chapter-2.md": "", "a/_no.md": "hidden", "a/Chapter-3.md": "\ufeffend", ".b/c.md": "hidden", "d.md": "x", "d.txt": "no"}
    work_files.write_files(spark.createDataFrame(list(files.items()), "path string, text string"), root)
    places = [("a", "a"), ("a", "d.md"), (None, "d.md"), ("b", ".b"), ("t", "d.txt"), ("up", "a/../d.md"), ("none", None), ("e", "e")]
    pieces = work_files.read_pieces(spark, root, spark.createDataFrame(places, "work_id string, path string"), chars=4)
    assert pieces.inputFiles() == []  # files that Spark's readers list are kept in the driver's memory
    found = {w: t for w, (t, _) in joined(pieces).items()}
    assert found == {"a": "x\n\n" + "é漢😀x\n\r\n" * 9 + "\n\nend", None: "x"}


@pytest.mark.parametrize("max_chars", [1, 12, 80])
def test_chunks_over_rows(spark, max_chars):
    texts = marked_texts(150, max_chars, 80) + ["", "\n\n", "a\n\nb", "aaaa\n\nbbb\n\ncccccccccccccc\n\nd", "one paragraph of words " * 9, "\n\na\n\n", "x\n \n \ny\n\n"]
    whole = spark.createDataFrame([(f"w{n}", t) for n, t in enumerate(texts)], "work_id string, text string")
    pieces = spark.createDataFrame(cut_anywhere(texts, max_chars), "work_id string, piece_no long, text string")
    want = {tuple(r) for r in chunks(whole, max_chars).select("work_id", "chunk_no", "text").collect()}
    got = {tuple(r) for r in long_texts.chunks_of_pieces(pieces, max_chars, GLUE).collect()}
    wrong = {w for w, _, _ in got ^ want}
    assert not wrong, [(texts[int(w[1:])], sorted(x[1:] for x in want if x[0] == w), sorted(x[1:] for x in got if x[0] == w)) for w in sorted(wrong)[:2]]


def test_jumps_by_hand():
    lengths = [4, 3, 14, 1]
    assert long_texts.jumps(lengths, 10, 2) == [2, 2, 3, None]
    assert long_texts.chunk_starts(lengths, None, 10, 2) == [0, 2, 3]
    assert long_texts.chunk_starts(lengths, 5, 10, 2) == [1, 2, 3]
    limits, sizes, total = long_texts.chunk_summary(lengths, 10, 2)
    assert (limits, sizes, total) == ([6, 1, -15], [3, 3, 3], 30)


def test_stored_tables_are_read_by_column(spark):
    table = stored(spark.range(10).selectExpr("id", "repeat('x', 100) AS text", "CAST(NULL AS string) AS tag").repartition(2))
    assert sorted(map(tuple, table.collect())) == [(n, "x" * 100, None) for n in range(10)]
    assert len(table.inputFiles()) == 2  # a checkpoint's rows are read whole
    assert "ReadSchema: struct<id:bigint>" in table.select("id")._jdf.queryExecution().executedPlan().toString()
