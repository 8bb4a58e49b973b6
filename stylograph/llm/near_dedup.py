"""Near duplicates: BagMinHash signatures of shingle multisets, banding, and exact verification.

A shingle that occurs w times is a weight of w, discretised into units. The units of a shingle form a hierarchy of blocks [0, 1),
[1, 2), [2, 4), [4, 8) ...; each block is a Poisson process whose rate is its width times the signature's length,
and each of its points carries a signature component and the unit it falls on. Points on units at or beyond w do not
count. A component's value is the earliest point that counts. Two texts share the points of min(w, w'), so the share of equal
components is an unbiased estimate of the weighted Jaccard similarity. All points are functions of hashes, and as points are made in
ascending order only up to a bound that fills all components with high probability (and further where it doesn't), the work
per text is its number of shingles plus a number that depends on the signature alone.

Texts with equal words are one node. Signatures are cut into bands; nodes that agree in a band share a bucket. Links are tested
exactly, by the overlap of the multisets, first between each bucket's least node and its others, so a group of near copies
costs about one test each. Where the links found leave a bucket in several components, its members are dealt into blocks of
bounded size, and block meets block: counts of shingles in bins bound every overlap from above, and only pairs of different components whose bound
allows the similarity are put out and tested. No pair that shares a bucket is left undecided, and none is tested for nothing but its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from stylograph.llm.common import landed, partitions, text_of
from stylograph.llm.tokenize import forget, slices
from stylograph.llm.words import FACTOR, mix, multisets, shingles, word_hashes
from stylograph.session import lookup

BANDS, ROWS, SHINGLE, SIMILARITY = 30, 5, 5, 0.8
UNIT = 2.0**-53
#: Characters whose shingles are hashed at a time; a word is some ten numbers then.
BATCH_CHARS = 1_000_000


def bag_min_hash(values: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, length: int) -> np.ndarray:
    """Signatures (texts x length) of the multisets given as (value, text, weight); texts without values get zeros."""
    total = np.bincount(text, weight, texts)
    bound = (np.log(length) + 3) / np.maximum(total, 1)
    signature = np.zeros((texts, length), np.uint64)
    todo = total > 0
    while todo.any():
        chosen = todo[text]
        best, points = _earliest(values[chosen], text[chosen], weight[chosen], texts, length, bound)
        full = todo & np.isfinite(best).all(1)
        signature[full] = points[full]
        todo &= ~full
        bound = bound * 2
    return signature


def _earliest(values, text, weight, texts: int, length: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and hash of each component's earliest point that comes before the text's bound."""
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    item = np.repeat(np.arange(len(values)), blocks)
    block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(start, 1)
    owner, limit = text[item], weight[item] - start
    state = mix(values[item] + mix(block.astype(np.uint64) + np.uint64(1)))
    until, rate = bound[owner], width * float(length)
    time = np.zeros(len(item))
    best = np.full(texts * length, np.inf)
    seen = []
    while len(owner):
        state = state + FACTOR
        point = mix(state)
        time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 1) * UNIT) / rate
        alive = time <= until
        owner, limit, width, state, until, rate, time, point = (a[alive] for a in (owner, limit, width, state, until, rate, time, point))
        mark = mix(point ^ FACTOR)
        component = ((mark >> np.uint64(32)) * np.uint64(length) >> np.uint64(32)).astype(np.int64)
        unit = (mark & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width
        counts = unit < limit
        place = owner[counts] * length + component[counts]
        np.minimum.at(best, place, time[counts])
        seen.append((place, time[counts], point[counts]))
    points = np.zeros(texts * length, np.uint64)
    for place, when, point in seen:
        first = when == best[place]
        points[place[first]] = point[first]
    return best.reshape(texts, length), points.reshape(texts, length)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets, each ascending values and their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole else 1.0


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """``docs`` (id, version, text) as id, version, two halves of a digest of the words, shingles (how many) and bands."""
    schema = StructType([docs.schema["id"], docs.schema["version"]]).add("high", "long").add("low", "long").add("shingles", "long")
    schema = schema.add("bands", ArrayType(LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for whole in batches for part in slices(whole, "text", BATCH_CHARS)):
            words, bounds = word_hashes(batch["text"])
            n = len(bounds) - 1
            values, text = shingles(words, bounds, width)
            signature = bag_min_hash(*multisets(values, text), n, bands * rows)
            sizes = np.bincount(text, minlength=n)
            keys = np.zeros((n, bands), np.uint64)
            for row in range(rows):
                keys = mix(keys * FACTOR + signature[:, row::rows])
            keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
            # Position-dependent sums over the words tell different texts apart.
            place = (np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64) + np.uint64(1)
            halves = []
            for salt in (1, 2):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + mix(place * np.uint64(2) + np.uint64(salt)) * FACTOR), dtype=np.uint64)])
                halves.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
            held = np.where(sizes > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(keys[sizes > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["version"], *map(pa.array, halves), pa.array(sizes), lists], schema=arrow)

    return docs.select("id", "version", "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, least: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """Those of ``pairs`` (a, b, text_a, text_b) whose multisets are at least so similar, without the texts."""
    schema = StructType([pairs.schema["a"], pairs.schema["b"]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (half for whole in batches for part in slices(whole, "text_a", BATCH_CHARS) for half in slices(part, "text_b", BATCH_CHARS)):
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            first = {n: at for at, n in enumerate(a + b)}
            texts = pa.concat_arrays([batch["text_a"], batch["text_b"]]).take(pa.array(list(first.values()), pa.int64()))
            number = {n: at for at, n in enumerate(first)}
            values, text, counts = multisets(*shingles(*word_hashes(texts), width))
            bounds = np.searchsorted(text, np.arange(len(number) + 1))
            bags = [(values[s:e], counts[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
            keep = pa.array([similarity(bags[number[x]], bags[number[y]]) >= least for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], schema=arrow)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


#: Rounds in which components are contracted by number.
BY_NUMBER = 2


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b). Each round maps every node to the least of itself
    and its neighbours and contracts the edges; the maps are then followed in order. What is left after two rounds, which are enough for stars, is
    compared by hashes that differ by round, so a chain whose numbers ascend shrinks as fast as any other."""
    maps = []
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        edges = landed(edges.distinct(), "edges")
        if edges.isEmpty():
            break

        def ranked(node: str) -> Column:
            hashed = F.xxhash64(F.col(node), F.lit(len(maps))) if len(maps) >= BY_NUMBER else F.lit(0).cast("long")
            return F.struct(hashed.alias("hash"), F.col(node).alias("to"))

        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("least"))
        to = landed(least.select("node", F.least(F.col("least"), ranked("node"))["to"].alias("to")), "contraction")
        maps.append(to)
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("to").alias("met"))
    for to in maps[1:]:
        out = out.join(to.select(F.col("node").alias("met"), "to"), "met", "left").select("node", F.coalesce("to", "met").alias("met"))
    if len(maps) <= BY_NUMBER:
        return landed(out.withColumnRenamed("met", "component"), "components")
    out = landed(out, "components-met")
    names = out.groupBy("met").agg(F.min("node").alias("component"))
    return landed(out.join(names, "met").select("node", "component"), "components")


def _fit(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Pairs whose numbers of shingles allow the similarity."""
    a, b = (sizes.select(F.col("node").alias(c), F.col("shingles").alias(f"n_{c}")) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")).select("a", "b")


def profiles(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """node and bins: how many shingles fall into each of a power of two of bins, 4 to 8 times their number but at most 65,536,
    as 16-bit integers; a text with 32,768 or more in a bin gets no bins, and no bound."""
    schema = StructType([texts.schema["node"]]).add("bins", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", BATCH_CHARS)):
            values, text = shingles(*word_hashes(batch["text"]), width)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = []
            for start, stop in zip(bounds[:-1], bounds[1:]):
                size = min(4 << int(stop - start).bit_length(), 1 << 16)
                bins = np.bincount((values[start:stop] & np.uint64(size - 1)).astype(np.int64), minlength=size)
                out.append(bins.astype("<u2").tobytes() if bins.max() < 1 << 15 else b"")
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(out, pa.binary())], schema=arrow)

    return texts.select("node", "text").mapInArrow(run, schema)


def possible_pairs(bucket: int, bands: np.ndarray, of: np.ndarray, sizes: np.ndarray, bins: list[bytes], half: int, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (first, second) of positions, the first below ``half`` and the second from there on, or any pair if ``half`` is 0, of different components, whose
    sizes and bins allow the similarity. A pair that shares several buckets belongs to the first of them alone."""
    place = (bands == bucket).argmax(1)
    width = np.array([len(b) // 2 for b in bins])
    left = np.arange(half or len(of))
    right = np.arange(half, len(of))
    for w in np.unique(width):
        for v in (u for u in np.unique(width) if u in (w // 2, w, 2 * w) or 0 in (u, w)):
            rows, columns = left[width[left] == w], right[width[right] == v]
            if not (len(rows) and len(columns)):
                continue
            fold = min(w, v)
            table = [np.stack([np.frombuffer(bins[i], "<u2").reshape(-1, fold).sum(0, dtype=np.uint16) for i in part]) if fold else None for part in (rows, columns)]
            for at, row in enumerate(rows):
                others = columns[(columns > row) | bool(half)]
                fit = (of[others] != of[row]) & (np.minimum(sizes[others], sizes[row]) >= least * np.maximum(sizes[others], sizes[row]))
                others = others[fit]
                others = others[(bands[others] == bands[row]).argmax(1) == place[row]]
                if fold and len(others):
                    common = np.minimum(table[0][at], table[1][np.searchsorted(columns, others)]).sum(1, dtype=np.int64)
                    others = others[common >= least * (sizes[row] + sizes[others] - common)]
                yield from ((int(row), int(other)) for other in others)


def candidates(members: DataFrame, least: float, block: int = 256, buckets: DataFrame | None = None) -> DataFrame:
    """Pairs a < b, each once, of nodes that share a bucket, are of different components, and may be similar enough. ``members``:
    bucket, node, component, shingles, bins, bands. ``buckets``: the same rows with the bucket alone, where that is cheaper to read."""
    counts = (members if buckets is None else buckets).groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    hot = lookup(landed(counts.where("blocks > 1"), "hot-buckets"))
    dealt = members.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A bucket's blocks, and then its pairs of blocks, are dealt by keys of their own: nothing holds a whole bucket.
    dealt = dealt.repartition(partitions(members.sparkSession), "bucket", "block")
    held = dealt.groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("node", "component", "shingles", "bins", "bands")).alias("held"))
    held = landed(held, "blocks", compression="zstd")  # read three times, joined once
    single = held.where("blocks = 1").select("bucket", "held", F.lit(None).cast(held.schema["held"].dataType).alias("other"))
    many = held.where("blocks > 1")
    firsts = many.select("bucket", "held", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("second"))
    pairs = firsts.join(many.select("bucket", F.col("block").alias("second"), F.col("held").alias("other")), ["bucket", "second"])
    pairs = pairs.select("bucket", "held", F.when(F.col("block") < F.col("second"), F.col("other")).alias("other"))
    schema = StructType().add("a", "long").add("b", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                own, other = batch["held"][at].values, batch["other"][at]
                parts = [own, other.values] if other.is_valid else [own]
                nodes, of, sizes = (np.concatenate([pc.struct_field(p, c).to_numpy() for p in parts]) for c in ("node", "component", "shingles"))
                bins = [b for p in parts for b in pc.struct_field(p, "bins").to_pylist()]
                bands = np.concatenate([pc.struct_field(p, "bands").flatten().to_numpy() for p in parts]).reshape(len(nodes), -1)
                half = len(own) if other.is_valid else 0
                found += [(nodes[i], nodes[j]) for i, j in possible_pairs(batch["bucket"][at].as_py(), bands, of, sizes, bins, half, least)]
            pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    return single.unionByName(pairs).mapInArrow(run, schema)


def links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """node, component of the nodes (node, shingles, bands) that have a link. ``texts_of`` gives (node, text) for a table of nodes."""
    rows = nodes.select("node", "shingles", F.explode("bands").alias("bucket"))
    centres = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("bucket", "centre")
    shared = landed(rows.join(centres, "bucket"), "buckets")
    texts = landed(texts_of(shared.select("node").distinct()), "candidate-texts", compression="zstd")
    sizes = shared.select("node", "shingles").distinct()

    def test(pairs: DataFrame) -> DataFrame:
        met = _fit(pairs, sizes, least)
        for c in ("a", "b"):
            met = met.join(texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")), c)
        return landed(verified(met, least, width), "links")

    tested = landed(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "tested")
    edges = test(tested)
    known = components(edges)
    labelled = shared.select("bucket", "node", "shingles").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = landed(labelled, "labelled-buckets")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x <> y AND members > 2")
    members = landed(labelled.join(split.select("bucket"), "bucket"), "split-buckets")
    if members.isEmpty():
        return known
    bins = landed(profiles(texts.join(members.select("node").distinct(), "node"), width), "profiles", compression="zstd")
    bins = bins.join(nodes.select("node", "bands"), "node")
    untested = candidates(members.join(bins, "node"), least, buckets=members).join(tested, ["a", "b"], "left_anti")
    return components(edges.unionByName(test(landed(untested, "pairs"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, kept, version.

    A class is a component of the links of similarity ``least`` or more; its id is its smallest document id (null ids come
    first), and the row of that id stays, the one with the least hash of its text if several share it. Texts with equal words are alike, and so are all texts without
    words; null texts count as empty. Rows that repeat id and text are counted each, and one of them stays. Other columns
    are not read; an empty table gives an empty result."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    sketched = landed(sketches(source, bands, rows, width), "sketches", compression="zstd")
    place = F.struct("id", "version")
    nodes = sketched.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"), F.first("bands").alias("bands"))
    nodes = landed(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", compression="zstd")

    def texts_of(wanted: DataFrame) -> DataFrame:
        held = lookup(landed(nodes.select("node", "first.*").join(wanted, "node").select("node", F.col("id").alias("of"), "version"), "wanted"))
        met = (source["version"] == held["version"]) & source["id"].eqNullSafe(held["of"])
        return source.join(held, met).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))

    known = links(nodes.select("node", "shingles", "bands"), texts_of, least, width)
    classed = nodes.select("high", "low", "node", "first", "copies").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = classed.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    by_digest = classed.select("high", "low", "component").join(classes, "component").select("high", "low", "keep", "class_size")
    copies = sketched.groupBy("id", "version", "high", "low").agg(F.count("*").cast("int").alias("copies"))
    out = copies.join(by_digest, ["high", "low"]).select("*", F.posexplode(F.sequence(F.lit(1), F.col("copies"))).alias("copy", "number"))
    kept = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("version") == F.col("keep.version")) & (F.col("copy") == 0)
    return out.select(F.col("id").alias(id_col), F.col("keep.id").alias("class_id"), F.col("class_size").cast("long").alias("class_size"), kept.alias("kept"), "version")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each class. Of rows that repeat id and text any one stays."""
    found = near_duplicates(docs, id_col, text_col, **options)
    found = landed(found.groupBy(id_col, "version").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")), "decisions")
    versioned = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("version"))
    gone, repeated = (
        lookup(found.where(which).select(F.col(id_col).alias("of_id"), F.col("version").alias("of_version"))) for which in ("stay = 0", "stay = 1 AND rows > 1")
    )

    def met(other: DataFrame) -> Column:
        return (versioned["version"] == other["of_version"]) & versioned["id"].eqNullSafe(other["of_id"])

    once = versioned.join(gone, met(gone), "left_anti").join(repeated, met(repeated), "left_anti")
    first = versioned.join(repeated, met(repeated), "left_semi").dropDuplicates(["id", "version"])
    return once.unionByName(first).select("row.*")
