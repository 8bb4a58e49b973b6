"""Repeated passages, found by winnowing over runs of words; lines don't bound them.

A document is its sequence of words. Every run of ``min_words`` words is a window; a window that occurred before (by id,
text and position) is deleted at the later place. A repeated run of at least that many words consists of such windows, so it
goes to its last word, wherever in a line it begins or ends and whichever earlier place it repeats.

From each window the run of a few words with the least hash is selected (the last of equal ones); its hash is the fingerprint, its place a
position. Neighbouring windows with one position are a stretch. Equal windows select equal runs at equal distances, so no
repeated window is missed if positions are compared by fingerprint only:

1. fingerprints of a single position are dropped;
2. of equal stretches, which hold equal windows, all but the first go whole;
3. the first places of the different stretches of a fingerprint are joined with the first of them, and each match is extended
   both ways, word by word, over line ends. What is extended to ``min_words`` words goes at the later place;
4. with three stretches or more, windows outside the match may repeat one of the others: they are known by a hash, and
   of equal ones all but the first go.

A fingerprint of many different stretches is split over salts. Each salt has a first stretch of its own, whose windows
then take part in step 4.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.llm.common import Steps, landed, text_of
from stylograph.llm.line_dedup import MIN_WORDS, MULTIPLIERS, _meet
from stylograph.llm.tokenize import forget, slices
from stylograph.llm.words import mix
from stylograph.session import BROADCAST_ROWS, lookup

#: Versions of texts (8 bytes each) that may be broadcast to pick texts before they are shuffled.
BROADCAST_VERSIONS = 1_000_000
#: Different stretches of a fingerprint that meet one first stretch; more are split over salts.
STRETCHES = 1_000
#: Characters whose words are hashed at a time.
BATCH_CHARS = 1_000_000
#: Stretches whose words are handed on at a time.
CONTEXTS = 10_000


class Words:
    """The words of several texts, one after the other, and the hashes of any run of them."""

    def __init__(self, own: np.ndarray, counts: np.ndarray):
        self.counts, self.begins = counts, np.cumsum(counts) - counts
        self.halves = [self._sums(values, m) for values, m in zip((own, mix(own ^ np.uint64(MULTIPLIERS[1]))), MULTIPLIERS)]

    @staticmethod
    def _sums(values: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of value times power up to each word, and the powers' inverses."""
        def powers(of: int) -> np.ndarray:
            return np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), of, np.uint64)]), dtype=np.uint64)

        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers(multiplier)[:-1], dtype=np.uint64)])
        return sums, powers(pow(multiplier, -1, 1 << 64))

    def hashed(self, half: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        sums, inverse = self.halves[half]
        return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and the texts' numbers of words."""
    split = [text.split() for text in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(counts.sum())), counts


def stretches(words: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, first window's start, number of windows, distance of the selected run from that start, fingerprint and key of each
    stretch. The key is independent of the fingerprint; together they tell stretches apart."""
    few = max(1, min_words // 4)
    width = min_words - few + 1
    size = int(words.counts.sum())
    text = np.repeat(np.arange(len(words.counts)), np.maximum(words.counts - min_words + 1, 0))
    if not len(text):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    before = np.cumsum(np.maximum(words.counts - min_words + 1, 0)) - np.maximum(words.counts - min_words + 1, 0)
    starts = np.arange(len(text)) - before[text] + words.begins[text]
    at = np.arange(size - few + 1)
    hashes = words.hashed(0, at, at + few)

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] <= hashes[left], right, left)

    least, span = at, 1  # the place of the least hash among span of them
    while 2 * span <= width:
        least, span = better(least[:-span], least[span:]), 2 * span
    selected = better(least[starts], least[starts + width - span])

    fresh = np.concatenate([[True], (np.diff(selected) != 0) | (np.diff(starts) != 1)])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    low = starts[first]
    key = words.hashed(1, low, low + count + min_words - 1)
    return text[first], low - words.begins[text[first]], count, selected[first] - low, hashes[selected[first]], key


def _stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """A row per stretch: id, version, start, count, at, fingerprint, key."""
    schema = StructType([rows.schema["id"], rows.schema["version"]])
    for name in ("start", "count", "at"):
        schema = schema.add(name, "integer")
    for name in ("fingerprint", "key"):
        schema = schema.add(name, "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for whole in batches for part in slices(whole, "text", BATCH_CHARS)):
            text, *places, fingerprint, key = stretches(Words(*hashes_of(batch["text"].to_pylist())), min_words)
            columns = [*(pa.array(p, pa.int32()) for p in places), *(pa.array(k.view(np.int64)) for k in (fingerprint, key))]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["version"].take(take), *columns], schema=arrow)

    return rows.select("id", "version", "text").mapInArrow(run, schema)


def _contexts(rows: DataFrame, min_words: int) -> DataFrame:
    """A row per stretch of the array stretches: id, version, its fields, and words, the hashes of all its words."""
    fields = rows.schema["stretches"].dataType.elementType.fields
    schema = StructType([rows.schema["id"], rows.schema["version"], *fields]).add("words", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", BATCH_CHARS)):
            own, counts = hashes_of(batch["text"].to_pylist())
            lists = batch["stretches"]
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            given = {f.name: flat.field(at) for at, f in enumerate(fields)}
            low = given["start"].to_numpy() + (np.cumsum(counts) - counts)[text]
            high = low + given["count"].to_numpy() + (min_words - 1)
            for part in range(0, len(text), CONTEXTS):
                rows = slice(part, part + CONTEXTS)
                words = pa.array([own[a:b].tobytes() for a, b in zip(low[rows], high[rows])], pa.binary())
                take = pa.array(text[rows])
                yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["version"].take(take), *(given[f.name][rows] for f in fields), words], schema=arrow)

    return rows.select("id", "version", "text", "stretches").mapInArrow(run, schema)


def extend(own: np.ndarray, at: int, other: np.ndarray, other_at: int) -> tuple[int, int]:
    """First and behind the last word in ``own`` of the match that holds position ``at``, equal to ``other_at`` in ``other``."""
    left, right = min(at, other_at), min(len(own) - at, len(other) - other_at)
    same = own[at - left : at + right] == other[other_at - left : other_at + right]
    before, behind = np.flatnonzero(~same[:left]), np.flatnonzero(~same[left:])
    return at - left + (before[-1] + 1 if len(before) else 0), at + (behind[0] if len(behind) else right)


def _extended(contexts: DataFrame, min_words: int) -> DataFrame:
    """Matches with the first stretch of each fingerprint and salt, and the windows outside them that may repeat another stretch.

    A row per match (id, version, start, size in words, no key) and per window (size min_words, fingerprint, key)."""
    schema = StructType([contexts.schema["id"], contexts.schema["version"]]).add("start", "integer").add("size", "integer")
    schema = schema.add("fingerprint", "long").add("key", "long")
    arrow = to_arrow_schema(schema)
    place = ("fingerprint", "salt", "id", "version", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, other, other_at = None, None, 0
        for batch in batches:
            own = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch["words"]]
            ats, starts, several, salts = (batch[c].to_pylist() for c in ("at", "start", "several", "salts"))
            matches, open_rows, open_starts = [], [], []
            for row, here in enumerate(zip(*(batch[c].to_pylist() for c in place))):
                count = len(own[row]) - min_words + 1
                windows = np.arange(count)
                if first is None or here[:2] != first[:2]:
                    first, other, other_at = here, own[row], ats[row]
                    windows = windows if salts[row] > 1 else windows[:0]
                elif here == first:
                    continue
                else:
                    low, high = extend(own[row], ats[row], other, other_at)
                    if high - low >= min_words:
                        matches.append((row, starts[row] + low, high - low))
                    windows = windows[(windows < low) | (windows > high - min_words)] if several[row] else windows[:0]
                open_rows.append(np.full(len(windows), row))
                open_starts.append(windows)
            counts = np.fromiter(map(len, own), np.int64, len(own))
            words = Words(np.concatenate([*own, np.zeros(0, np.uint64)]), counts)
            row, start = (np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64) for parts in (open_rows, open_starts))
            low = words.begins[row] + start
            key = words.hashed(1, low, low + min_words).view(np.int64)
            matched = np.array(matches, np.int64).reshape(-1, 3)
            take = pa.array(np.concatenate([matched[:, 0], row]))
            none = pa.nulls(len(matched), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(take), batch["version"].take(take),
                    pa.array(np.concatenate([matched[:, 1], start + np.array(starts, np.int64)[row]]), pa.int32()),
                    pa.array(np.concatenate([matched[:, 2], np.full(len(row), min_words)]), pa.int32()),
                    pa.concat_arrays([none, batch["fingerprint"].take(pa.array(row))]), pa.concat_arrays([none, pa.array(key)]),
                ],
                schema=arrow,
            )

    return contexts.repartition("fingerprint", "salt").sortWithinPartitions(*place).mapInArrow(run, schema)


def _hinted(lists: DataFrame, column: str) -> DataFrame:
    """Hint rows with a list for broadcast by the number of the lists' items."""
    return F.broadcast(lists) if (lists.agg(F.sum(F.size(column))).first()[0] or 0) <= BROADCAST_ROWS else lists


def repeated_passages(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, version and the runs to delete, arrays firsts and lasts of word numbers; only documents that have any."""
    place = F.struct("id", "version", "start")
    with Steps(rows.sparkSession) as steps:
        found = steps.land(_stretches(rows, min_words), "stretches")
        shared = steps.land(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "fingerprints")
        positions = steps.land(found.join(lookup(shared), "fingerprint", "left_semi"), "positions")
        steps.free(found, shared)

        anchor = F.min(F.struct("id", "version", "start", "count", "at")).alias("anchor")
        classes = steps.land(positions.groupBy("fingerprint", "key").agg(anchor, F.count("*").alias("n")), "stretch-classes")
        again = classes.where("n > 1").select("fingerprint", "key", F.struct("anchor.id", "anchor.version", "anchor.start").alias("anchor"))
        whole = positions.join(lookup(again), ["fingerprint", "key"]).where(place != F.col("anchor")).select(
            "id", "version", F.col("start").alias("first"), (F.col("start") + F.col("count") + (min_words - 2)).alias("last")
        )
        whole = steps.land(whole, "repeated-stretches")
        steps.free(positions)

        several = classes.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
        several = steps.land(several.select("fingerprint", (F.col("n") > 2).alias("several"), F.ceil(F.col("n") / STRETCHES).cast("int").alias("salts")), "fingerprints")
        cut = classes.select("fingerprint", "anchor.*").join(lookup(several), "fingerprint")
        salt = F.pmod(F.xxhash64("id", "version", "start"), "salts").cast("int").alias("salt")
        stretch = F.struct("start", "count", "at", "fingerprint", "several", "salts", salt)
        cut = steps.land(cut.groupBy("id", "version").agg(F.collect_list(stretch).alias("stretches")), "cut-stretches")
        steps.free(classes, several)

        versions = cut.select("version").distinct()
        texts = rows.select("id", "version", "text")
        if versions.limit(BROADCAST_VERSIONS + 1).count() <= BROADCAST_VERSIONS:
            texts = texts.join(F.broadcast(versions), "version", "left_semi")
        contexts = _contexts(_meet(texts, _hinted(cut, "stretches"), "id", "version"), min_words)
        extended = steps.land(_extended(contexts, min_words), "extended")
        steps.free(cut)

        last = (F.col("start") + F.col("size") - 1).alias("last")
        windows = extended.where("key is not null")
        first = windows.groupBy("fingerprint", "key").agg(F.min(place).alias("anchor"), F.count("*").alias("n")).where("n > 1").drop("n")
        first = steps.land(first, "repeated-windows")
        later = windows.join(lookup(first), ["fingerprint", "key"]).where(place != F.col("anchor"))
        parts = (part.select("id", "version", F.col("start").alias("first"), last) for part in (extended.where("key is null"), later))
        runs = reduce(DataFrame.unionByName, parts, whole).groupBy("id", "version").agg(F.collect_set(F.struct("first", "last")).alias("r"))
        return landed(runs.select("id", "version", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts")), "repeated-passages", compression="zstd")


def without(text: str, firsts: np.ndarray, lasts: np.ndarray) -> tuple[str, int, int]:
    """The text without the words of the runs, and the numbers of lines and words removed.

    A line that loses all its words goes, as does a blank line between removed words. Of other lines each removed word
    goes with the white space behind it, or, at the line's end, before it."""
    lines = text.split("\n")
    spans = [[m.start() for m in re.finditer(r"\S+", line)] for line in lines]
    edges = np.zeros(sum(map(len, spans)) + 2, np.int64)
    np.add.at(edges, firsts + 1, 1)
    np.add.at(edges, lasts + 2, -1)
    gone = np.append(np.cumsum(edges)[:-1] > 0, False)  # word n at n + 1
    kept, at = [], 1
    for line, words in zip(lines, spans):
        lost = gone[at : at + len(words)]
        at += len(words)
        if not lost.any():
            if words or not (gone[at - 1] and gone[at]):
                kept.append(line)
        elif not lost.all():
            pieces = [line[a:b] for a, b, cut in zip(words, [*words[1:], len(line)], lost) if not cut]
            left = line[: words[0]] + "".join(pieces)
            kept.append(left.rstrip() if lost[-1] else left)
    return "\n".join(kept), len(lines) - len(kept), int(gone.sum())


def _edited(text: Column, firsts: Column, lasts: Column) -> Column:
    kind = pa.struct([("text", pa.string()), ("lines_removed", pa.int32()), ("words_removed", pa.int32())])

    @F.arrow_udf("text string, lines_removed int, words_removed int")
    def edit(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out = []
        for at in range(len(texts)):
            if texts[at].is_valid:
                runs = (of[at].values.to_numpy().astype(np.int64) for of in (firsts, lasts))
                out.append(dict(zip(("text", "lines_removed", "words_removed"), without(texts[at].as_py(), *runs))))
            else:
                out.append(None)
        return pa.array(out, kind)

    return edit(text, firsts, lasts)


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without its later repeated passages, and ``lines_removed``
    and ``words_removed``.

    A passage is a run of ``min_words`` words or more; white space between words doesn't count. Null texts count as empty and stay
    null; texts of fewer than ``min_words`` words never change. Rows that repeat id and text are one document and change
    alike; of rows that share an id, those with different texts are ordered by a hash of the text. Null ids come first.
    Existing columns lines_removed and words_removed are replaced."""
    version = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("id"), version.alias("version"), text_of(text_col).alias("text"))
    runs = _hinted(repeated_passages(rows, min_words), "firsts")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), version.alias("version"))
    marked = _meet(row, runs, "id", "version", "left")
    changed = F.col("firsts").isNotNull()
    edited = marked.withColumn("edited", _edited(F.when(changed, F.col("row")[text_col]), "firsts", "lasts"))
    columns = [c for c in docs.columns if c not in ("lines_removed", "words_removed")]
    text = F.when(changed, F.col("edited.text")).otherwise(F.col("row")[text_col])
    counts = (F.coalesce(f"edited.{c}", F.lit(0)).alias(c) for c in ("lines_removed", "words_removed"))
    return edited.select(*((text.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in columns), *counts)
