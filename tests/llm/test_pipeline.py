import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stylograph.llm import near_dedup, passages, quality, tokenize

from .conftest import DATA
from .test_dedup import brute_classes
from .test_passages import brute_passages


def test_pipeline_against_brute_force(spark):
    """On real documents, with labels of both classes, every stage's decisions reach the packed result."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    good = [(r.doc_id, texts[r.doc_id]) for r in judged if r.score >= 0.5]
    assert 0 < len(good) < len(texts)
    edited = brute_passages(good, 50)
    left = [(i, " ".join(words)) for i, (words, gone) in edited.items() if words or not gone]
    assert any(gone for _, gone in edited.values())
    classes = brute_classes(left)
    assert len(set(classes.values())) < len(left)
    packed = corpus_pipeline.run(spark, str(DATA))
    found = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert found == set(classes.values())
    overlaps = packed.alias("a").join(packed.alias("b"), F.expr("a.sequence_id = b.sequence_id AND a.offset < b.offset AND a.offset + a.length > b.offset"))
    assert overlaps.count() == 0


class Captured:
    """A table that keeps the function its rows would go through."""

    schema = StructType().add("id", "long").add("version", "long").add("text", "string")

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


@pytest.mark.parametrize("step", [lambda rows: near_dedup.sketches(rows), lambda rows: passages._stretches(rows, 50)])
def test_steps_that_encode_nothing_drop_what_encoding_left(step, tokenizer_path):
    tokenize.encode(pa.array(["some words"]), tokenizer_path)
    assert tokenize._known.cache_info().currsize
    rows = pa.RecordBatch.from_pydict({"id": [1], "version": [2], "text": ["a few words " * 40]})
    assert sum(batch.num_rows for batch in step(Captured()).function(iter([rows])))
    assert not tokenize._known.cache_info().currsize
