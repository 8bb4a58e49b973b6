"""Files, seeds, landing, and the whole run."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stylograph.operators import checks
from stylograph.plans import warehouse
from stylograph.sources import landing, schemas, seeds
from stylograph.sources import works as work_files
from tests.test_measures import labelled_tokens
from stylograph.operators.tokens import with_lexical_columns


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "my corpus"
    (root / "novel" / "drafts").mkdir(parents=True)
    (root / "tales").mkdir()
    for name, text in {
        "novel/Chapter-10.md": "ten", "novel/Chapter-2.md": "two\n", "novel/Intro.md": "intro", "novel/notes.txt": "no",
        "novel/drafts/Chapter-1.md": "draft", "tales/25,000 Cats' 100% + more.md": "cats\r\n\nmore", "tales/unlisted.md": "x",
    }.items():
        (root / name).write_text(text, encoding="utf-8", newline="")
    return str(root)


def manifest(spark):
    return spark.createDataFrame([("n", "novel"), ("c", "tales/25,000 Cats' 100% + more.md"), ("none", "missing.md")], "work_id string, path string")


def test_works_from_files(spark, corpus):
    chapters = work_files.chapters(work_files.read_files(spark, corpus), manifest(spark))
    got = dict(map(tuple, work_files.assemble(chapters).collect()))
    assert got == {"n": "intro\n\ntwo\n\n\nten", "c": "cats\r\n\nmore"}


def test_seeds(spark, tmp_path):
    path = tmp_path / "authors.csv"
    path.write_text(
        'work_id,title,author,tradition,era,is_self,path\n25-lumps,"25,000 ""Lumps""",Me,t,now,true,"a/25,000.md"\nx,X,You,u,then,false,b c\'s.md\n',
        encoding="utf-8",
    )
    rows = seeds.seed_authors(spark, str(path)).orderBy("work_id").collect()
    assert tuple(rows[0]) == ("25-lumps", '25,000 "Lumps"', "Me", "t", "now", True, "a/25,000.md")
    assert rows[1]["is_self"] is False and rows[1]["path"] == "b c's.md"
    assert seeds.manifest(seeds.seed_authors(spark, str(path))).columns == ["work_id", "path"]
    metrics = seeds.seed_metrics(spark)
    assert metrics.count() == 15 and metrics.where("is_multivalue").count() == 3
    assert seeds.seed_metrics(spark, seeds.METRICS_FILE).collect() == metrics.collect()


def test_landing_replaces_and_keeps_schema(spark, tmp_path):
    tables = landing.Tables(spark, str(tmp_path))
    stamp = landing.batch_timestamp(datetime(2024, 5, 6, 7, 8, 9))
    rows = spark.createDataFrame([("w", "m", 1.5)], "work_id string, metric string, value double")
    landing.land_measurements(tables, rows, stamp)
    landed = landing.land_measurements(tables, rows, stamp)
    assert landed.collect() == [("w", "m", 1.5, datetime(2024, 5, 6, 7, 8, 9))]
    empty = landing.land_measurements(tables, rows.limit(0), stamp)
    assert empty.count() == 0
    assert empty.schema.simpleString() == spark.createDataFrame([], schemas.RAW_MEASUREMENTS).schema.simpleString()


def test_whole_run(spark, tmp_path):
    texts = [(f"w{i}", f"{'Thou walked quickly. ' * i}“It’s a {'very ' * i}dangerous cat -- (no),” he said; happily…") for i in range(1, 7)]
    works = spark.createDataFrame(texts + [("empty", "")], "work_id string, text string")
    authors = spark.createDataFrame(
        [(w, w.upper(), f"author{i % 3}", "t", "now", i % 3 == 0, w) for i, (w, _) in enumerate(texts + [("empty", "")])], schemas.AUTHORS
    )
    tokens = labelled_tokens(works)
    tokens = with_lexical_columns(tokens.drop("pos", "lemma")).cache()
    tables = landing.Tables(spark, str(tmp_path / "tables"))
    warehouse.land_tokens(tables, tokens, works, datetime(2024, 1, 1))
    warehouse.build_models(tables, authors, seeds.seed_metrics(spark))
    assert tables.read("fact_style_measurement").count() == 7 * 63
    assert len(tables.read("mart_work_fingerprint").columns) == 5 + 63
    assert tables.read("fact_vocab_overlap").count() == 2
    results = warehouse.run_checks(tables).collect()
    assert len(results) == 36
    assert [tuple(r) for r in results if r["violations"]] == []
    # Surface measures alone leave the tree and part-of-speech concepts out, and the check says so.
    bare = landing.Tables(spark, str(tmp_path / "bare"))
    warehouse.land_texts(bare, works, tokens)
    assert bare.read("raw_measurements").select("metric").distinct().count() == 57
    warehouse.build_models(bare, authors, seeds.seed_metrics(spark))
    gaps = warehouse.run_checks(bare, warehouse.MART_CHECKS[-1:]).collect()
    assert gaps[0]["violations"] == 7
