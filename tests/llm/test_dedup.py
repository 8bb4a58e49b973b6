import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.llm import line_dedup, near_dedup
from stylograph.llm.exact_dedup import exact_duplicates
from stylograph.llm.words import mix

from .conftest import DATA, ODD


def brute_exact(rows):
    content = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[content(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        group = groups[content(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(content(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(odd, weak):
    """Also when digests collide, contents decide."""
    options = {"digest": lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)} if weak else {}
    found = exact_duplicates(odd, salts=2, **options).collect()
    want = brute_exact(ODD)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == sorted((w[:3] for w in want), key=repr)
    if not weak:
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found), key=repr) == want
    groups = {r.keep_id: 0 for r in found}
    for r in found:
        groups[r.keep_id] += r.kept
    assert set(groups.values()) == {1}


def test_exact_duplicates_of_nothing(nothing):
    assert exact_duplicates(nothing).count() == 0


def brute_lines(docs, least):
    first, out = {}, {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        lines = [(line.strip(), len(line.split()), n) for n, line in enumerate((text or "").split("\n")) if line.strip()]
        gone = set()
        for start in range(len(lines)):
            stop, words = start, 0
            while words < least and stop < len(lines):
                words, stop = words + lines[stop][1], stop + 1
            if words < least:
                break
            key = tuple(line[0] for line in lines[start:stop])
            if key not in first:
                first[key] = (lines, start)
                continue
            other, at = first[key]
            a, b, oa, ob = start, stop, at, at + stop - start
            while a and oa and lines[a - 1][0] == other[oa - 1][0]:
                a, oa = a - 1, oa - 1
            while b < len(lines) and ob < len(other) and lines[b][0] == other[ob][0]:
                b, ob = b + 1, ob + 1
            gone.update(range(lines[a][2], lines[b - 1][2] + 1))
        out[i] = "\n".join(line for n, line in enumerate((text or "").split("\n")) if n not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for least in (8, 50):
        want = brute_lines([tuple(r) for r in docs.collect()], least)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least).collect()} == want


def test_line_dedup_hand_cases(spark):
    shared = "\n".join(f"line {n} of a passage that several documents share" for n in range(8))
    rows = [(1, f"own start\n{shared}\nown end"), (2, f"other\n\n{shared}\n\nmore"), (3, shared.replace("line 7", "changed")), (4, "x y\n" * 60), (5, None)]
    out = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1][0] == rows[0][1]
    assert out[2] == ("other\n\n\nmore", 8)
    assert out[3][0] == "changed of a passage that several documents share"
    assert out[4][0].count("x y") == 1 and out[5] == (None, 0)


def test_line_dedup_odd_rows(odd, nothing):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "lines_removed"]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(ODD, key=repr)
    assert line_dedup.dedup_lines(nothing).count() == 0


def bags(rows):
    out = {}
    for i, text in rows:
        words = [w for w in (re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()) if w]
        out[i] = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()
    return out


def brute_classes(rows):
    held = bags(rows)
    names = sorted(held, key=lambda i: (i is not None, i))
    leader = {i: i for i in names}

    def root(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            common, whole = (held[a] & held[b]).total(), (held[a] | held[b]).total()
            if (common >= 0.8 * whole) and root(a) != root(b):
                leader[root(b)] = root(a)
    least = {}
    for i in names:
        least.setdefault(root(i), i)
    return {i: least[root(i)] for i in names}


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = near_dedup.near_duplicates(docs).collect()
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in found} == want
    assert sum(r.kept for r in found) == len(set(want.values()))


def test_near_duplicates_of_a_family(spark):
    """Copies with a few changes each: many buckets fall into several components."""
    random = np.random.default_rng(5)
    base = [f"w{n}" for n in range(160)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in random.choice(160, random.integers(0, 9), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows += [(200, "a a a a a a a a a b"), (201, "A, a a a a a a a a b."), (202, "a a a a a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == brute_classes(rows)


def test_near_duplicates_odd_rows(odd, nothing):
    found = near_dedup.near_duplicates(odd).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert len(found) == len(ODD) and sorted(classes[1]) == [1, 2, 3] and sorted(classes[4]) == [4, 4, 10]
    assert sum(r.kept for r in found) == len(classes)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(classes)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_signatures_estimate_weighted_jaccard():
    random = np.random.default_rng(3)
    values = mix(np.arange(60, dtype=np.uint64))
    one, two = random.integers(1, 40, 60), random.integers(1, 40, 60)
    text, weight = np.repeat([0, 1], 60), np.concatenate([one, two])
    made = near_dedup.bag_min_hash(np.concatenate([values, values]), text, weight, 2, 6_000)
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((made[0] == made[1]).mean() - true) < 4 * (true * (1 - true) / 6_000) ** 0.5


@pytest.mark.parametrize("kind", ["ascending", "star", "pairs"])
def test_components_of_long_chains(spark, kind, monkeypatch):
    """A chain shrinks by a share each round, whatever its numbers."""
    rounds = []
    landed = near_dedup.landed
    monkeypatch.setattr(near_dedup, "landed", lambda df, name, **options: (rounds.append(name), landed(df, name, **options))[1])
    edges = {"ascending": [(n, n + 1) for n in range(1_000)], "star": [(0, n) for n in range(1, 500)], "pairs": [(2 * n, 2 * n + 1) for n in range(100)]}[kind]
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: (n - n % 2 if kind == "pairs" else 0) for edge in edges for n in edge}
    assert found == want and rounds.count("contraction") <= 14


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(1, "one two three four five six", "a", 1, "b"), (2, "one two three four five six", "c", 2, "d"), (3, "other", "e", 3, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version_of_text string, version int, row string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
