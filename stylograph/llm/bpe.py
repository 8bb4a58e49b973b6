"""Byte-level BPE by recursive queries: DuckDB inside each task.

Spark deals out the documents. Within a task a DuckDB connection holds the vocabulary, the merge table (every pair of
tokens whose bytes joined are a token, with its rank) and the words it has met. The pattern cuts each text into
words; new words become rows (word, position, token), one per byte. A recursive query joins neighbours
to the merge table and contracts, in every word, the leftmost pair of the least rank, until no pair is left.
Decoding turns ids into rows, joins them to the vocabulary, and aggregates the bytes in the order of their positions.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stylograph.llm.tokenize import Known, binary_slices, id_lists, put_together, slices, split

#: Bytes of pieces and words with their ids that a worker remembers.
REMEMBERED_BYTES = 100_000_000
#: Words per recursive query, contractions per query, and bytes from which a word is merged by itself, round by round; none
#: changes a result.
WORDS, ROUNDS, LONG = 40_000, 64, 2_000
#: Ids per decoding query.
DECODED = 1_000_000

CONTRACT = f"""
WITH RECURSIVE state(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM symbols
  UNION ALL
  SELECT s.word, (s.pos - (s.pos > c.pos)::INTEGER)::INTEGER, CASE WHEN s.pos = c.pos THEN c.merged ELSE s.tok END, step + 1
  FROM state s JOIN (
    SELECT word, (min(pair) >> 32)::INTEGER AS merged, (min(pair) & 4294967295)::INTEGER AS pos
    FROM (
      SELECT l.word, (m.merged::BIGINT << 32) | l.pos AS pair
      FROM state l JOIN state r ON r.word = l.word AND r.pos = l.pos + 1
      JOIN merges m ON m.first = l.tok AND m.second = r.tok
      WHERE l.step < {ROUNDS})
    GROUP BY word) c USING (word)
  WHERE s.pos <> c.pos + 1),
final AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, s.pos, s.tok, s.step = {ROUNDS} AS open FROM state s JOIN final USING (word, step)
"""

# One round over a long word: all leftmost occurrences, not overlapping, of the pair of least rank. If a token so made
# forms a pair of still lower rank with what then stands beside it, that pair's turn comes first, and only the first occurrence goes.
ROUND = """
WITH pairs AS (
  SELECT l.pos, m.merged FROM symbols l JOIN symbols r ON r.pos = l.pos + 1 JOIN merges m ON m.first = l.tok AND m.second = r.tok),
least AS (SELECT min(merged) AS made FROM pairs),
placed AS (SELECT pos, made, row_number() OVER (ORDER BY pos) AS nth FROM pairs JOIN least ON merged = made),
alone AS (
  SELECT pos, made, nth FROM (SELECT *, row_number() OVER (PARTITION BY pos - nth ORDER BY pos) AS place FROM placed) WHERE place % 2 = 1),
beside AS (
  SELECT made, made AS first, z.tok AS second FROM alone a JOIN symbols z ON z.pos = a.pos + 2
  UNION ALL SELECT made, w.tok, made FROM alone a JOIN symbols w ON w.pos = a.pos - 1
  UNION ALL SELECT made, made, made FROM least),
lower AS (SELECT count(*) AS n FROM beside b JOIN merges m ON m.first = b.first AND m.second = b.second AND m.merged < b.made),
taken AS (SELECT pos FROM alone WHERE nth = 1 OR (SELECT n FROM lower) = 0)
SELECT (row_number() OVER (ORDER BY s.pos) - 1)::INTEGER AS pos, CASE WHEN t.pos IS NULL THEN s.tok ELSE (SELECT made FROM least) END::INTEGER AS tok
FROM symbols s LEFT JOIN taken t ON t.pos = s.pos LEFT JOIN taken p ON p.pos = s.pos - 1 WHERE p.pos IS NULL
"""

DECODE = """
SELECT doc, unhex(string_agg(hex(v.bytes), '' ORDER BY pos)) AS bytes
FROM ids JOIN vocabulary v USING (tok) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Coder:
    """The DuckDB side of one worker."""

    def __init__(self, path: str, pattern: str):
        self.pattern, self.ranks = regex.compile(pattern), read_ranks(path)
        self.known = Known(self.pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "max_temp_directory_size": "0KB"})
        halves = [
            (left, right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        first, second, merged = (pa.array(c, pa.int32()) for c in zip(*halves)) if halves else [pa.array([], pa.int32())] * 3
        self._table("merges", pa.table({"first": first, "second": second, "merged": merged}))
        self._table("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        symbols = pa.table({"word": word, "pos": pos, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]})
        closed = []
        while symbols.num_rows:
            self.db.register("symbols", symbols)
            state = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("symbols")
            closed.append(state.filter(pc.invert(state["open"])))
            symbols = state.filter(state["open"]).drop_columns(["open"])
        rows = pa.concat_tables(closed)
        word, pos, tok = (rows[c].to_numpy() for c in ("word", "pos", "tok"))
        order = np.lexsort([pos, word])
        bounds = np.searchsorted(word[order], np.arange(len(words) + 1)) * 4
        data = tok[order].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one word; only the last round's symbols are held."""
        tok = self.byte[np.frombuffer(word, np.uint8)]
        symbols = pa.table({"pos": np.arange(len(tok), dtype=np.int32), "tok": tok})
        while True:
            self.db.register("symbols", symbols)
            merged = self.db.sql(ROUND).to_arrow_table()
            self.db.unregister("symbols")
            if len(merged) == len(symbols):
                break
            symbols = merged
        return symbols["tok"].to_numpy()[np.argsort(symbols["pos"].to_numpy())].astype("<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """A word that is a token itself is that token; the others are merged."""
        raw = [w.encode() for w in words]
        found = [None if (rank := self.ranks.get(data)) is None else rank.to_bytes(4, "little") for data in raw]
        rest = [at for at, ids in enumerate(found) if ids is None]
        for at in (at for at in rest if len(raw[at]) >= LONG):
            found[at] = self._merge_long(raw[at])
        rest = [at for at in rest if found[at] is None]
        for start in range(0, len(rest), WORDS):
            part = rest[start : start + WORDS]
            for at, ids in zip(part, self._merge([raw[at] for at in part])):
                found[at] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' bounds in them."""
        pieces, codes, bounds = split(texts)
        table = self.known.look_up(pieces, lambda words: id_lists(self.encode_words(words.to_pylist())), REMEMBERED_BYTES)
        return put_together(table, codes, bounds)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each document."""
        out = []
        cuts = [0]
        for row in range(1, len(bounds)):
            if bounds[row] - bounds[cuts[-1]] > DECODED or row == len(bounds) - 1:
                cuts.append(row)
        for start, stop in zip(cuts, cuts[1:]):
            part = bounds[start : stop + 1] - bounds[start]
            doc = np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(part))
            rows = pa.table({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "tok": ids[bounds[start] : bounds[stop]].astype(np.int32)})
            self.db.register("ids", rows)
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            texts = [b""] * (stop - start)
            for at, data in zip(found["doc"].to_pylist(), found["bytes"].to_pylist()):
                texts[at] = data
            out += texts
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (little-endian unsigned 32-bit integers in a binary) per row; null texts count as empty and have no
    ids. Strings of special tokens are ordinary text. A batch's rows are encoded together, whole; rows that repeat an id are encoded each,
    other columns are dropped. A word of any length is merged, a long one by itself; it needs some 100 bytes a symbol."""
    return round_trip(docs, ranks_path, pattern, id_col, text_col, decoded=False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """As ``encode``, and the bytes that the ids decode to, by the same worker."""
    schema = StructType([docs.schema[id_col]]).add("ids", "binary")
    schema = schema.add("bytes", "binary") if decoded else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            worker = coder(ranks_path, pattern)
            ids, bounds = worker.encode(batch[text_col])
            columns = [batch[id_col], binary_slices(ids, bounds)]
            if decoded:
                columns.append(pa.array(worker.decode(ids, bounds), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *keep: str) -> DataFrame:
    """``keep`` columns, the ids and their bytes. Null ids decode to nothing; an id that is no token ends the job."""
    schema = StructType([encoded.schema[k] for k in keep]).add("ids", "binary").add("bytes", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pc.fill_null(batch["ids"], b"").to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
            ids = np.frombuffer(b"".join(data), "<u4")
            worker = coder(ranks_path, pattern)
            if len(ids) and ids.max() >= 2**31 or not np.isin(np.unique(ids), np.fromiter(worker.ranks.values(), np.int64)).all():
                raise ValueError("an id that the vocabulary does not have")
            texts = worker.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(data, pa.binary()), pa.array(texts, pa.binary())], schema=arrow)

    return encoded.select(*keep, "ids").mapInArrow(run, schema)
