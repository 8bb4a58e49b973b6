"""URL rules as a sort-merge range join over reversed-host keys.

A rule is a host and a path prefix: it fits its host, all subdomains of it, and every path that
begins with the rule's. Reversing the labels of a host makes subdomains share a prefix, and each
reversed suffix of a url's host under which rules exist gives one key, reversed host + path. On
those keys a rule is exactly one interval [rule, rule + 0xFF), and intervals are nested or disjoint.

The sweep sorts rules and urls together by key within a host block and carries the stack of the
last rule before each url, that rule and the rules it is nested in. As the family is nested, the
rules that are active at a url are those of the stack that its path begins with; the longest wins.

Hosts that hold many urls are dealt over several blocks, in proportion to their share, and only
their rules are repeated. Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from stylograph.llm.common import partitions
from stylograph.session import lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
    there up to ``?``, ``#`` or the end. Both are empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows; verdicts are allow or block."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack that is active at its start: the rules of its host it is nested in, outermost
    first, and itself. Nesting rules are found by an equi-join on the prefixes of the rule's path."""
    distinct = rules.groupBy("rhost", "rule_path").agg(F.max("verdict").alias("verdict"), F.first("rule").alias("rule"))
    prefixes = distinct.select(
        "rhost",
        "rule_path",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("rule_path")), lambda n: F.substr(F.col("rule_path"), F.lit(1), n))).alias("outer_path"),
    )
    outer = distinct.select("rhost", F.col("rule_path").alias("outer_path"), "rule", "verdict")
    entry = F.struct(F.length("outer_path").alias("n"), F.col("outer_path").alias("path"), "rule", "verdict")
    return prefixes.join(outer, ["rhost", "outer_path"]).groupBy("rhost", "rule_path").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    The longest fitting rule (characters of host and path, then of the host, then its text) decides; of two equal
    rules block does. Without a fitting rule ``rule`` is null and the verdict is ``default``. Null urls and urls without
    ``://`` have empty host and path, as rules with an empty host never fit; urls of any length are
    judged whole. Rows that repeat are each judged. Other columns are not read.
    """
    spark = pages.sparkSession
    rules = rules.where("host <> '' AND path IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("rule_path"), "verdict"
    ).select(_reversed_host(F.col("host")).alias("rhost"), "rule_path", "verdict", F.concat("host", "rule_path").alias("rule"))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    keyed = urls.where("host <> ''").select("id", "host", "path", F.explode(suffixes).alias("rhost"))
    keyed = keyed.join(lookup(rules.select("rhost").distinct()), "rhost", "left_semi")

    # Blocks per host, by its share of the keys.
    shares = keyed.groupBy("rhost").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    blocks = shares.select("rhost", F.ceil(F.lit(2 * partitions(spark)) * F.col("n") / F.col("total")).cast("int").alias("blocks"))
    blocks = lookup(blocks)
    point = (
        keyed.join(blocks, "rhost")
        .withColumn("block", F.pmod(F.xxhash64("id", "path"), F.col("blocks")).cast("int"))
        .select("rhost", "block", F.col("path").cast("binary").alias("at"), F.lit(1).alias("kind"), "id", "host", "path")
    )
    start = (
        _stacks(rules).join(blocks, "rhost")
        .select("rhost", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rule_path").cast("binary").alias("at"), F.lit(0).alias("kind"), "stack")
    )
    sweep = Window.partitionBy("rhost", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = point.unionByName(start, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    innermost = F.try_element_at(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1))
    fitting = active.where("kind = 1").select("id", "host", "path", innermost.alias("r"), "rhost").where("r IS NOT NULL")

    candidate = F.struct(F.length("r.rule").alias("n"), F.length("rhost").alias("host_n"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    none = F.lit(None).cast("struct<n:int,host_n:int,rule:string,verdict:string>")
    judged = (
        urls.select("id", "host", "path", none.alias("best"), F.lit(1).alias("rows"))
        .unionByName(fitting.select("id", "host", "path", candidate.alias("best"), F.lit(0).alias("rows")))
        .groupBy("id", "host", "path").agg(F.max("best").alias("best"), F.sum("rows").cast("int").alias("rows"))
    )
    return judged.select(F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"), "*").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
