from stylograph.llm import passages
from stylograph.llm.passages import dedup_passages, without
from stylograph.llm.queries import QUERIES

from .conftest import DATA, ODD


def brute_passages(docs, least):
    """Every window of words against all windows before it."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words, gone = (text or "").split(), set()
        for start in range(len(words) - least + 1):
            key = tuple(words[start : start + least])
            if key in seen:
                gone.update(range(start, start + least))
            seen.add(key)
        out[i] = ([w for n, w in enumerate(words) if n not in gone], len(gone))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for least in (1, 8, 50):
        found = {r.doc_id: (r.text.split(), r.words_removed) for r in dedup_passages(docs, least).collect()}
        assert found == brute_passages([tuple(r) for r in docs.collect()], least)


def test_query_removes_a_passage_that_lies_inside_lines(spark, tmp_path):
    passage = " ".join(f"p{n}" for n in range(30)) + "\n" + " ".join(f"p{n}" for n in range(30, 60))
    rows = [(1, f"a b {passage} c"), (2, f"  d e {passage} f  g\nh"), (3, passage.replace("\n", " ").replace("p20 ", "p20\n\n") + " i")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, r.lines_removed) for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("  d e\nf  g\nh", 0), 3: ("i", 2)}


def test_odd_rows(odd, nothing):
    found = dedup_passages(odd)
    assert found.columns == [*odd.columns, "lines_removed", "words_removed"]
    want = [(i, "one two three four five six seven" if i == 9 else t) for i, t in ODD]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert dedup_passages(nothing).count() == 0


def test_without():
    import numpy as np

    cut = lambda text, *runs: without(text, np.array([r[0] for r in runs]), np.array([r[1] for r in runs]))
    assert cut("a b\n\nc d\n\ne", (1, 3)) == ("a\n\ne", 2, 3)
    assert cut("a b c", (1, 1)) == ("a c", 0, 1)
    assert cut("a\x85b\n \nc", (0, 1), (2, 2)) == ("", 3, 3)


def test_query_removes_a_tail_that_the_first_occurrence_lacks(spark, tmp_path):
    """Windows that end in the tail are compared with every earlier place, not with the passage's first alone."""
    passage = "\n".join(" ".join(f"p{line}x{n}" for n in range(20)) for line in range(3))
    tail = " ".join(f"t{n}" for n in range(10))
    rows = [(1, f"{passage}\na"), *((i, f"{passage}\n{tail}\nown{i}") for i in range(2, 6))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, r.lines_removed) for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == {1: (rows[0][1], 0), 2: (f"{tail}\nown2", 3), **{i: (f"own{i}", 4) for i in range(3, 6)}}


def test_fingerprints_of_many_stretches_are_split_over_salts(spark, monkeypatch):
    import random

    draw = random.Random(5)
    shared = [draw.choice("abc") for _ in range(24)]
    rows = []
    for i in range(60):
        start, stop = sorted(draw.sample(range(25), 2))
        rows.append((i, " ".join([draw.choice("abcd") for _ in range(draw.randrange(9))] + shared[start:stop] + [draw.choice("abcd") for _ in range(9)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_passages(rows, 8)
    for stretches in (1_000, 2):
        monkeypatch.setattr(passages, "STRETCHES", stretches)
        assert {r.doc_id: (r.text.split(), r.words_removed) for r in dedup_passages(docs, 8).collect()} == want


def test_extend():
    import numpy as np

    own, other = np.array([9, 1, 2, 3, 4, 8]), np.array([1, 2, 3, 4, 5])
    assert passages.extend(own, 2, other, 1) == (1, 5)
    assert passages.extend(other, 1, own, 2) == (0, 4)
    assert passages.extend(own, 2, own, 2) == (0, 6)


def test_tables_of_the_steps_are_removed(spark, tmp_path, monkeypatch):
    from stylograph.llm import common

    monkeypatch.setattr(common, "checkpoint_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(3)], "doc_id long, text string")
    assert sorted(r.words_removed for r in dedup_passages(docs, 8).collect()) == [0, 8, 8]
    assert [f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()] == ["repeated-passages"]
