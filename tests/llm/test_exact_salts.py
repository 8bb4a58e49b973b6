from pyspark.sql import functions as F

from stylograph.llm import exact_dedup

from .conftest import ODD
from .test_dedup import brute_exact


def test_more_repeated_digests_than_may_be_broadcast(spark, odd, monkeypatch):
    """The most frequent text is still merged over several salts, and the results are the same."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "lookup", lambda small: small)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, "hot" if i % 3 else f"t{i % 4}") for i in range(120)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        salts, whole = [], exact_dedup._salted
        monkeypatch.setattr(exact_dedup, "_salted", lambda *a: salts.append(whole(*a)) or salts[0])
        found = exact_dedup.exact_duplicates(docs)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found.collect()), key=repr) == brute_exact(rows)
        assert salts[0].where("content = 'hot'").select(F.count_distinct("salt")).first()[0] > 1
        monkeypatch.setattr(exact_dedup, "_salted", whole)
        odd_found = exact_dedup.exact_duplicates(odd, salts=2).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in odd_found), key=repr) == brute_exact(ODD)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
