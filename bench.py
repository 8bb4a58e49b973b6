"""Time the headline queries on local cores and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from stylograph.session import get_spark
from suite.queries import QUERIES

HEADLINE = (
    "clean_documents", "assemble_chapters", "chunk_paragraphs", "type_frequencies", "lexical_metrics", "sentence_metrics",
    "punctuation_rates", "contraction_rate", "dialogue_ratio", "tree_depth", "sentence_types", "pos_densities", "vocabulary",
    "annotate_chunks", "tidy_measurements", "token_table_measurements", "zscore_by_metric", "normalized_measurements",
    "vocab_jaccard", "fact_style_measurement", "mart_work_fingerprint", "pivot_by_values", "check_unique",
    "check_relationships", "check_concepts", "report_works", "report_author_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", int(cpus), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.range(1).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
