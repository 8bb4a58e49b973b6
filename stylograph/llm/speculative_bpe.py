"""BPE over words, by speculation: propose tokens greedily, verify all neighbours at once, merge only what fails.

Merging a word pair by pair is slow, so its tokens are guessed: at every place the longest token that fits. The guess equals
the merged result if and only if every two adjacent tokens would stay apart when merged together. A token that merging
makes out of its own characters has a derivation; along the boundary of two tokens stand the parts on the left one's right edge and on
the right one's left edge, each from the merge that makes it to the merge that consumes it. A merge across the boundary takes place
if and only if two such parts form a pair that ranks before the one on the left is consumed, and not after the one on the right
is (of equal ranks the leftmost goes first). So a pair of tokens is tested by looking up the ranks of all pairs of edge parts, an
array operation over all new neighbours of a batch. Words with a pair that fails are merged exactly, on a heap.

This needs every merge to rank after those that make its parts, which is checked on loading; without it every word is merged exactly.
Tokens that merging does not make of their own characters are never proposed.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from stylograph.llm.tokenize import joined_ids, put_together, slices

#: Bytes of words with their ids, and pairs of tokens, that a worker remembers; pairs tested at once. None changes a result.
REMEMBERED_BYTES, REMEMBERED_PAIRS, PAIRS = 160_000_000, 1_000_000, 20_000
NEVER = np.int32(2**31 - 1)

#: The settings of a tokenizer file that this module covers; another file is refused.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: The same split of Latin letters in lower case, all pieces at once: a blank stands between pieces. Text with any other
#: character goes through the library's own normaliser and splitter.
LATIN = re.compile(r"[^\t-\r -~\xa1-\u012f\u0131-\u017f]")
LATIN_SPLIT = re.compile(
    r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u017f]+|[0-9²³¹¼½¾]|[^\t-\r 0-9²³¹¼½¾a-zªµºß-öø-\u017f]+"
)
#: Words of up to so many symbols are merged by scanning them, longer ones on a heap.
SHORT = 64

class Speculator:
    """The merges of a tokenizer file, what they say of neighbours, and the words a worker has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self._check(described)
        model = described["model"]
        suffix = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.size = max(vocabulary.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left * size + right -> rank * size + token made
        self.merges = {vocabulary[a] * self.size + vocabulary[b]: rank * self.size + vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.inner = {t: i for t, i in vocabulary.items() if not t.endswith(suffix)}
        self.last = {t.removesuffix(suffix): i for t, i in vocabulary.items() if t.endswith(suffix)}
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = (np.fromiter(self.merges.values(), np.int64, len(keys))[order] // self.size).astype(np.int32)
        self._edges()

        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.pre_tokenize = Split(Regex(SPLIT), "removed", invert=True).pre_tokenize_str
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        odd = [b for b in range(256) if b not in plain]  # written as letters from 256 on
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.neighbours: dict[int, bool] = {}

    @staticmethod
    def _check(described: dict) -> None:
        model, split = described["model"], described["pre_tokenizer"]["pretokenizers"]
        covered = (
            model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"] and not model["dropout"]
            and not model["byte_fallback"] and not model.get("ignore_merges") and described["decoder"] is None
            and [n["type"] for n in described["normalizer"]["normalizers"]] == NORMALIZERS
            and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": SPLIT}
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"])
        )
        if not covered:
            raise ValueError("a tokenizer file with settings that are not covered")

    def _edges(self) -> None:
        """For every token that merging makes: the parts on its left and right edge, and the rank at which each is consumed."""
        made = {merged % self.size for merged in self.merges.values()}
        born = {token: -1 for token in (*self.inner.values(), *self.last.values()) if token not in made}
        self.left = {token: [(token, NEVER)] for token in born}
        self.right = {token: [(token, NEVER)] for token in born}
        self.ordered = len(made) == len(self.merges)
        for pair, merged in self.merges.items():
            (a, b), (rank, token) = divmod(pair, self.size), divmod(merged, self.size)
            self.ordered &= a in born and b in born
            born[token] = rank
            if a in self.right and b in self.left and self._first_across(a, b) == rank:
                self.left[token] = [(token, NEVER), (a, rank), *self.left[a][1:]]
                self.right[token] = [(token, NEVER), (b, rank), *self.right[b][1:]]
        sound = set(self.left)
        self.inner_sound = {t: i for t, i in self.inner.items() if i in sound}
        self.last_sound = {t: i for t, i in self.last.items() if i in sound}
        self.longest = max(map(len, (*self.inner_sound, *self.last_sound)))

        def table(edges: dict) -> tuple[np.ndarray, np.ndarray]:
            deep = max(map(len, edges.values()))
            parts, ends = np.full((self.size, deep), -1, np.int64), np.zeros((self.size, deep), np.int32)
            for token, edge in edges.items():
                parts[token, : len(edge)] = [p for p, _ in edge]
                ends[token, : len(edge)] = [e for _, e in edge]
            return parts, ends

        self.left_parts, self.left_ends = table(self.left)
        self.right_parts, self.right_ends = table(self.right)
        del self.left, self.right

    def _first_across(self, a: int, b: int) -> int:
        """The least rank of a merge across the boundary of two tokens, as they stand one after the other."""
        least = int(NEVER)
        for x, x_end in self.right[a]:
            for y, y_end in self.left[b]:
                merged = self.merges.get(x * self.size + y)
                if merged is not None and (rank := merged // self.size) < x_end and rank <= y_end:
                    least = min(least, rank)
        return least

    def stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of adjacent tokens as it is."""
        out = np.ones(len(first), bool)
        for start in range(0, len(first), PAIRS):
            a, b = first[start : start + PAIRS], second[start : start + PAIRS]
            x, y = self.right_parts[a][:, :, None], self.left_parts[b][:, None, :]
            row, i, j = np.nonzero((x >= 0) & (y >= 0))
            key = x[row, i, 0] * self.size + y[row, 0, j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[at] == key
            rank, row, i, j = self.ranks[at[met]], row[met], i[met], j[met]
            crosses = (rank < self.right_ends[a[row], i]) & (rank <= self.left_ends[b[row], j])
            out[start + row[crosses]] = False
        return out

    def propose(self, word: str) -> list[int]:
        """The longest token that fits, from left to right; nothing if none fits somewhere."""
        at, size, out = 0, len(word), []
        while at < size:
            rest = size - at
            if rest <= self.longest and (token := self.last_sound.get(word[at:])) is not None:
                out.append(token)
                return out
            for length in range(min(self.longest, rest - 1), 0, -1):
                if (token := self.inner_sound.get(word[at : at + length])) is not None:
                    out.append(token)
                    at += length
                    break
            else:
                return []
        return out

    def merge(self, word: str) -> list[int]:
        """The exact result: the pair of least rank is merged, the leftmost of equals, until none is left. Characters that the
        vocabulary lacks are left out."""
        tokens = [self.inner.get(c) for c in word[:-1]] + [self.last.get(word[-1])]
        tokens = [t for t in tokens if t is not None]
        return self._merge_short(tokens) if len(tokens) <= SHORT else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        merges, size = self.merges, self.size
        none = size * size  # above every rank
        found = [merges.get(a * size + b, none) for a, b in zip(tokens, tokens[1:])]
        while found and (least := min(found)) < none:
            at = found.index(least)
            tokens[at : at + 2] = [least % size]
            del found[at]
            if at:
                found[at - 1] = merges.get(tokens[at - 1] * size + tokens[at], none)
            if at < len(found):
                found[at] = merges.get(tokens[at] * size + tokens[at + 1], none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        merges, size, end = self.merges, self.size, len(tokens)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [
            (found // size, at, pair, found % size) for at in range(end - 1)
            if (found := merges.get(pair := tokens[at] * size + tokens[at + 1])) is not None
        ]
        heapify(queue)

        def offer(at: int) -> None:
            if at >= 0 and after[at] < end:
                pair = tokens[at] * size + tokens[after[at]]
                if (found := merges.get(pair)) is not None:
                    heappush(queue, (found // size, at, pair, found % size))

        while queue:
            _, at, pair, token = heappop(queue)
            gone = after[at]
            if tokens[at] < 0 or gone >= end or tokens[at] * size + tokens[gone] != pair:
                continue
            tokens[at], tokens[gone] = token, -1
            after[at] = after[gone]
            if after[gone] < end:
                before[after[gone]] = at
            offer(before[at])
            offer(at)
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        if not self.ordered:
            return [self.merge(w) for w in words]
        guessed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, guessed), np.int64, len(guessed))
        flat = np.fromiter((t for g in guessed for t in g), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, codes = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        known = [self.neighbours.get(p) for p in pairs.tolist()]
        new = np.flatnonzero([k is None for k in known])
        if len(new):
            apart = self.stay_apart(pairs[new] // self.size, pairs[new] % self.size)
            if len(self.neighbours) > REMEMBERED_PAIRS:
                self.neighbours.clear()
            for at, verdict in zip(new.tolist(), apart.tolist()):
                known[at] = self.neighbours[int(pairs[at])] = verdict
        failing = np.zeros(len(words), bool)
        if len(inside):
            failing[word[inside[~np.array(known, bool)[codes]]]] = True
        failing |= sizes == 0
        return [self.merge(w) if fails else g for w, g, fails in zip(words, guessed, failing.tolist())]

    def _spelled(self, word: str) -> str:
        """A word in the vocabulary's letters, one for each byte."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def _words(self, piece: str) -> list[str]:
        """The words of a piece and the special tokens in it, as the library splits it."""
        out = []
        for part in self.special_split.split(piece) if self.special else (piece,):
            out += [part] if part in self.special else [w for w, _ in self.pre_tokenize(self.normalize(part))]
        return out

    def split(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all pieces, a blank after each piece's, and where each piece stands among them."""
        special = self.special_split.search if self.special else lambda _: False
        plain = [p for p in pieces if not LATIN.search(p) and not special(p)]
        words: list[str] = LATIN_SPLIT.findall(" ".join(plain).lower())
        if plain:
            words.append(" ")
        place = {p: n for n, p in enumerate(plain)}
        for piece in pieces:
            if piece not in place:
                place[piece] = len(place)
                words += self._words(piece)
                words.append(" ")
        return words, np.fromiter((place[p] for p in pieces), np.int64, len(pieces))

    def ids_of(self, distinct: list[str]) -> pa.ListArray:
        """The ids of each word; words not met before are speculated on together."""
        if self.held > REMEMBERED_BYTES:
            self.words.clear()
            self.held = 0
        new = [w for w in distinct if w not in self.words and w not in self.special and w != " "]
        encoded = self.encode_words([self._spelled(w) for w in new])
        fresh = {w: array("I", ids).tobytes() for w, ids in zip(new, encoded)} | {w: i.to_bytes(4, "little") for w, i in self.special.items()}
        found = [fresh[w] if w in fresh else self.words.get(w, b"") for w in distinct]
        for word, ids in fresh.items():
            if len(word) <= 64:  # long ones hardly recur
                self.words[word] = ids
                self.held += len(word) + len(ids) + 180
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4")))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' bounds in them. A blank ends a piece; no word runs over one."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        flat = lists.flatten().dictionary_encode()
        words, rows = self.split(flat.dictionary.to_pylist())
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return put_together(joined_ids(words, " ", self.ids_of), rows[flat.indices.to_numpy()], bounds - bounds[0])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The tokens of each text joined by blanks."""
        names = self.names.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), names), pa.scalar(" ", pa.large_string()))


@lru_cache(maxsize=2)
def speculator(path: str) -> Speculator:
    return Speculator(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) per row, without special tokens round a text; those whose strings stand in it are found. Null
    and empty texts have no ids; rows that repeat an id are encoded each; a text is encoded whole, however long. Other columns are dropped."""
    return round_trip(docs, path, id_col, text_col, decoded=False)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """As ``encode``, and ``decoded``, the text that the ids stand for, by the same worker."""
    schema = StructType([docs.schema[id_col]]).add("ids", ArrayType(IntegerType()))
    schema = schema.add("decoded", "string") if decoded else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            worker = speculator(path)
            ids, bounds = worker.encode(batch[text_col])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            columns = [batch[id_col], lists.cast(arrow.field("ids").type)]
            if decoded:
                columns.append(worker.decode(ids, bounds).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns, ids, and the tokens' strings joined by blanks. Null ids decode to nothing; an id that is no token ends the job."""
    schema = StructType([encoded.schema[k] for k in keep]).add("ids", ArrayType(IntegerType())).add("decoded", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worker = speculator(path)
            ids = batch["ids"].flatten()
            if pc.any(pc.or_kleene(pc.less(ids, 0), pc.greater_equal(ids, len(worker.names)))).as_py() or worker.names.take(ids).null_count:
                raise ValueError("an id that the vocabulary does not have")
            sizes = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy()
            texts = worker.decode(ids.to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), batch["ids"], texts.cast(pa.string())], schema=arrow)

    return encoded.select(*keep, "ids").mapInArrow(run, schema)
