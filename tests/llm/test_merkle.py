import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.llm import merkle
from stylograph.llm.queries import op11_merkle_manifest

from .conftest import DATA


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs_of(leaves, fanout=3):
    """Per leaf the (before, after) pairs up to the root, and the root."""
    steps, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(own):
            first = at - at % fanout
            run = level[first : first + fanout]
            steps[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        level = [h(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
        own = [at // fanout for at in own]
    return steps, level[0]


def brute(rows, fanout=3):
    """rows of (id, group, text): sorted list of (id, leaf, subroot, root, steps)."""
    groups = {}
    for i, group, text in rows:
        groups.setdefault(group, []).append((i is not None, i or 0, leaf(i, group, text), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inner = [], {}
    for name in names:
        steps, root = proofs_of([r[2] for r in sorted(groups[name], key=lambda r: r[:3])], fanout)
        subroots.append(root)
        inner[name] = steps
    outer, root = proofs_of(subroots, fanout)
    out = []
    for name, subroot, above in zip(names, subroots, outer):
        for (_, _, digest, i), steps in zip(sorted(groups[name], key=lambda r: r[:3]), inner[name]):
            out.append((i, digest, subroot, root, tuple(steps + above)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_every_node_has_a_place_of_its_own(fanout):
    for levels in range(1, 8 if fanout < 5 else 6):
        places = np.concatenate([merkle.address(levels, depth, np.arange(fanout**depth), fanout) for depth in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.nodes_in(levels, fanout)))
    # the upper half first, then each lower subtree in one piece
    upper, lower = merkle.nodes_in(2, fanout), merkle.nodes_in(2, fanout)
    assert merkle.address(4, 2, np.arange(3), fanout).tolist() == [upper + i * lower for i in range(3)]


@pytest.mark.parametrize("height", [1, 2, 4])
@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_against_brute_force(spark, height, fanout):
    rows = [(i, "hot", f"text {i}") for i in range(100)] + [(i, "ü", "same") for i in (5, 5, 5, 7)] + [(None, None, None), (1, None, ""), (2, "", "a\nb" * 5_000)]
    rows += [(3, "lone", "x"), (None, "hot", "y"), (None, "hot", "y")] + [(9, f"s{i}", "z") for i in range(15)]
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, source string, text string, grp string, place int, leaf string")
    frame = frame.repartition(5)
    made = merkle.build(frame, "doc_id", "source", merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("text")), fanout=fanout, height=height)
    found = merkle.proofs(made).withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    got = sorted(((r.id, r.leaf, r.subroot, made.root, tuple(tuple(s) for s in r.steps)) for r in found), key=repr)
    want = brute(rows, fanout)
    if height > 1:  # repeated rows share their leaves, not their places
        assert got == want
    assert len(got) == len(rows) and {g[3] for g in got} == {want[0][3]} and [g[:3] for g in got] == [w[:3] for w in want]
    assert {r.folded for r in found} == {made.root}


def test_tampering_shows(spark):
    rows = [(i, f"s{i % 4}", f"line {i}\nline") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    changed = F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.col("text"))
    made = merkle.build(frame, "doc_id", "source", merkle.leaf_of(F.col("text")), {"now": merkle.leaf_of(changed)}, height=1)
    for r in merkle.proofs(made).withColumn("folded", merkle.folded(F.col("keep_now"), F.col("steps"))).collect():
        assert (r.folded == made.root) == (r.id % 7 != 0)


def test_nothing_has_no_root(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    made = merkle.build(frame, "doc_id", "source", merkle.leaf_of(F.col("text")))
    assert made.root is None and merkle.proofs(made).count() == 0


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        groups.setdefault(r.source, []).append((r.doc_id, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text.replace("\n", ""))))
    names = sorted(groups, key=str.encode)
    inner = {n: proofs_of([x[1] for x in groups[n]]) for n in names}
    outer, root = proofs_of([inner[n][1] for n in names])
    want = set()
    for name, above in zip(names, outer):
        for (i, own, other), steps in zip(groups[name], inner[name][0]):
            node = own if zlib.crc32(str(i).encode()) % 2 else other
            for before, after in steps + above:
                node = h(before, node, after)
            want.add((i, own, inner[name][1], root, h(*(b + a for b, a in steps + above)), node, node == root))
    assert {tuple(r) for r in op11_merkle_manifest(spark, str(DATA)).collect()} == want
