import io
import struct

import pytest

from stylograph.llm import topk, url_filter, warc
from stylograph.llm.queries import RULES


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_verdicts(spark):
    rules = [*RULES, ("block", "a.b.example.org", "/x"), ("allow", "a.b.example.org", "/x/y"), ("block", "com", "/"), ("allow", "com", "/ÿ")]
    urls = [
        None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org/es", "https://x.example.org/en/12",
        "https://x.example.org/en/2", "http://a.b.example.org/x/y/z", "http://a.b.example.org/xz", "http://com/fr/", "http://a.com/ÿ/", "http://a.com?x=/de/",
        "ftp://a.com/de/#x", "http://example.orgx/es/", "http://org.example/es/", "http://a.org/" + "y" * 30_000, "http://exa%mple.org/es/://", "x://" + "a." * 300 + "com/",
    ] * 2
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, None)], "page_id long, url string").repartition(3)
    found = url_filter.url_verdicts(pages, url_filter.rule_table(spark, rules)).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=repr)
    assert got == sorted([(i, *brute_verdict(u, rules)) for i, u in [*enumerate(urls), (0, None)]], key=repr)
    assert url_filter.url_verdicts(pages.where("false"), url_filter.rule_table(spark, rules)).count() == 0


def test_archives(spark):
    rows = [(1, "http://a b\n/", "same"), (2, None, "same"), (5, "u", "same"), (3, "u", None), (4, "u", ""), (6, "u", "é" * 50_000), (None, "u", "lone"), (7, "u", "x"), (7, "u", "x")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_round_trip(pages).collect()}
    assert found == {
        (1, "revisit", 5, 4), (2, "revisit", 5, 4), (5, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (6, "response", None, 100_000),
        (None, "response", None, 4), (7, "response", None, 1),
    }
    high = warc.archive_round_trip(pages, least_bytes=5).collect()
    assert len(high) == len(rows) and {r.record_type for r in high} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_records_are_validated():
    good = warc.record("1", "http://x", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    bad = [
        good.replace(b"payload", b"PAYLOAD"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dat"), good[:-1], good + b"x",
        good.replace(b"Content-Length: 7", b"Content-Length: 8"),
    ]
    for data in bad:
        with pytest.raises(ValueError):
            warc.parse(data)
    sink = io.BytesIO()
    assert warc.write_archive(sink, iter([good] * 200)) == 200
    data = sink.getvalue()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
    assert list(warc.read_archive(io.BytesIO(data))) == [good] * 200
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-5])))


def test_top_k(spark):
    vectors = [(i, [((i * 7 + d * 3) % 11 - 5) / 7 for d in range(5)]) for i in range(60)]
    vectors += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (105, [0.5]), (106, vectors[3][1]), (None, [1.0] * 5)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    import pyspark.sql.functions as F

    held = {i: [int(1024 * x // 1) for x in v] for i, v in vectors if i is not None and i not in (100, 101, 102, 103)}
    want = set()
    for q in (i for i in held if i % 5 == 0):
        scores = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)[:7]
        want |= {(q, place, i, -s) for place, (s, i) in enumerate(scores, 1)}
    asked = topk.integer_vectors(rows.where("vec_id % 5 = 0"), "vec_id", "embedding")
    for block in (8, 4096):
        index = topk.build_index(topk.integer_vectors(rows, "vec_id", "embedding"), block)
        found = topk.search(index, asked, 7, chunk=4).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert topk.top_k(rows.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(rows, F.lit(False)).count() == 0


def test_top_k_broadcasts_neither_queries_nor_index(spark):
    import pyspark.sql.functions as F

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    found = topk.top_k(rows, F.col("vec_id") % 5 == 0, k=3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 12 * 3


def test_top_k_refuses_what_it_cannot_hold(spark):
    import pyspark.sql.functions as F

    for big in (1e15, 1e6):
        rows = spark.createDataFrame([(0, [big, 1.0], "x", 1)] + [(i, [1e6, float(i)], "y", 2) for i in range(1, 30)], "vec_id long, embedding array<double>, id string, score int")
        with pytest.raises(Exception, match="too large"):
            topk.top_k(rows, F.col("vec_id") == 0).collect()
    fine = spark.createDataFrame([(i, [float(i), 1.0], "clash", 5, 7) for i in range(20)], "vec_id long, embedding array<double>, id string, score int, rank int")
    assert topk.top_k(fine, F.col("vec_id") == 0, k=2).columns == ["query_id", "rank", "vec_id", "score"]


def test_url_verdicts_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "p", "r", "v")], "page_id long, url string, host string, path string, rule string, verdict string")
    found = url_filter.url_verdicts(pages, url_filter.rule_table(spark, RULES)).first()
    assert (found.page_id, found.host, found.path, found.rule, found.verdict) == (1, "a.org", "/x", "org/", "allow")
