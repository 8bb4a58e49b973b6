"""Token ids of whole texts with a tokenizer file, inside Arrow batches.

A byte-level tokenizer splits a text before it merges, and a run of white space never joins what is
left of it. So a text is cut where white space follows other characters, each distinct piece of a
batch is looked up once by the words the vocabulary's pattern finds in it, words not met before are
encoded by the library, and the ids are put together again with array operations. What a worker
remembers of words and pieces is held in columns too and found by hashes, so that much of it fits.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Characters a batch is cut to, and bytes of pieces and words with their ids that a worker remembers; neither changes a result.
BATCH_CHARS = 3_000_000
REMEMBERED_BYTES = 64_000_000
#: Bytes of the longest word or piece that is remembered, words hashed at a time, and the powers their bytes are hashed with.
LONGEST, HASHED = 64, 50_000
POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
#: Words that go to the library as one text, and what stands between them there: a line end is never part of a word before or after it.
TOGETHER, BETWEEN = 300, "\n"
#: Gives what the C library holds free back to the system; None where it has no such call.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: The split of byte-level vocabularies, a fixed value.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Unicode white space, a fixed value.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Pieces that are one word of that split, and words whose bytes the byte-level alphabet leaves as they are, but for the blank.
LETTERS, PRINTED = r"^ ?[A-Za-z]+\z", r"^ ?[!-~]+\z"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def model(path: str):
    """The library's model, which encodes one word of the byte-level alphabet, and the blank in that alphabet; None for a file with other steps
    before the model than the byte-level split."""
    loaded = Tokenizer.from_file(path)
    steps = json.loads(loaded.to_str())
    before = steps["pre_tokenizer"] or {}
    if steps["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    return loaded.model, loaded.pre_tokenizer.pre_tokenize_str(" ")[0][0]


@lru_cache(maxsize=4)
def special_tokens(path: str) -> tuple[str, ...]:
    """The strings that stand for a token of their own wherever they occur."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("a special token that takes more than its own characters")
    return tuple(sorted((t.content for t in added), key=len, reverse=True))


def slices(batch: pa.RecordBatch, text_col: str, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch at rows so that each part holds about ``chars`` characters; what Arrow and the C library hold on to is given back at its end."""
    lengths = pc.fill_null(pc.utf8_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    part = np.cumsum(lengths, dtype=np.int64) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for start, stop in zip(cuts, cuts[1:]):
        yield batch.slice(start, stop - start)
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the piece numbers of all texts in order, and each text's bounds in them."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    first = np.zeros(len(codes), bool)
    first[bounds[:-1]] = True
    last = np.zeros(len(codes), bool)
    last[bounds[1:] - 1] = True
    # A blank begins a piece, unless white space stands before it.
    empty = pc.equal(words, "")
    spaced = pc.or_(empty, pc.utf8_is_space(pc.utf8_slice_codeunits(words, -1)))
    empty, spaced = (x.to_numpy(zero_copy_only=False) for x in (empty, spaced))
    loose = spaced[codes]
    odd = np.logical_or.reduceat(loose & ~last & ~(first & empty[codes]), bounds[:-1]) if len(codes) else np.zeros(0, bool)

    keys = codes * 2 + ~first
    used = np.flatnonzero(np.bincount(keys, minlength=2 * len(words)))
    number = np.zeros(2 * len(words), np.int64)
    number[used] = np.arange(len(used))
    keys = number[keys]
    blank = pc.if_else(pa.array(used % 2 == 1), " ", "")
    pieces = pc.binary_join_element_wise(blank, words.take(pa.array(used // 2)).cast(pa.string()), "")
    if not odd.any():
        return pieces, keys, bounds
    parts = list(map(PIECE.findall, texts.filter(pa.array(odd)).to_pylist()))
    both = pa.concat_arrays([pieces, pa.array(list(chain.from_iterable(parts)), pa.string())]).dictionary_encode()
    number = both.indices.to_numpy().astype(np.int64)
    counts = np.diff(bounds)
    others = number[keys[~np.repeat(odd, counts)]]
    counts[odd] = list(map(len, parts))
    return both.dictionary, _mixed(np.repeat(odd, counts), number[len(pieces) :], others), np.concatenate([[0], np.cumsum(counts)])


def _mixed(mask: np.ndarray, where: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """The values of ``where`` at the places ``mask`` marks and those of ``elsewhere`` at the others, each in order."""
    out = np.empty(len(mask), np.int64)
    out[mask], out[~mask] = where, elsewhere
    return out


def joined_ids(words: list[str], stop: str, ids_of: Callable[[list[str]], pa.ListArray]) -> pa.ListArray:
    """The ids of each run of ``words`` that ends with ``stop``; ``ids_of`` gives those of distinct words, none for ``stop``."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    ends = np.flatnonzero(codes == pc.index(coded.dictionary, stop).as_py())
    table = ids_of(coded.dictionary.to_pylist())
    sizes = np.concatenate([[0], np.cumsum(np.diff(table.offsets.to_numpy())[codes], dtype=np.int64)])
    offsets = np.concatenate([[0], sizes[ends + 1]]) if len(ends) else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(pa.array(codes)).flatten())


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; all words of more than ``LONGEST`` bytes share one."""
    if len(words) > HASHED:
        return np.concatenate([hashes_of(words.slice(start, HASHED)) for start in range(0, len(words), HASHED)])
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    if (lengths > LONGEST).any():
        words = pc.if_else(pa.array(lengths > LONGEST), "", words)
        lengths = np.where(lengths > LONGEST, 0, lengths)
    if not lengths.any():
        return np.zeros(len(words), np.uint64)
    ends = np.cumsum(lengths, dtype=np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data[start : start + ends[-1]] + np.uint64(1)) * POWERS[place], dtype=np.uint64)])
    return sums[ends] - sums[ends - lengths]


def id_lists(found: list[bytes]) -> pa.ListArray:
    """Lists of ids from little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.uint32)))


class Known:
    """The pieces and words a worker has met, with their ids, and how pieces are cut into words. Words and ids are columns; the
    sorted hashes lead to a word's place there, where the word itself is compared."""

    def __init__(self, pattern, special: tuple[str, ...] = ()):
        self.pattern = pattern
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        self.hashes, self.places, self.uses = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)

    @property
    def held(self) -> int:
        """Bytes of what is remembered."""
        return sum(x.nbytes for x in (self.words, self.ids, self.hashes, self.places, self.uses))

    def _find(self, words: pa.Array) -> np.ndarray:
        """Each word's place among those remembered, -1 if it has none."""
        if not len(self.words) or not len(words):
            return np.full(len(words), -1)
        hashes = hashes_of(words)
        order = np.argsort(hashes)
        at = np.empty(len(words), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        place = self.places[np.minimum(at, len(self.hashes) - 1)]
        return np.where(pc.equal(self.words.take(pa.array(place)), words).to_numpy(zero_copy_only=False), place, -1)

    def _remember(self, words: pa.Array, ids: pa.ListArray) -> None:
        hashes = hashes_of(words)
        order = np.argsort(hashes)
        spot = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, spot, (len(self.words) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, spot, hashes[order])
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int32)])

    def _drop_half(self) -> None:
        """The half used least goes; of equally used ones the older."""
        kept = np.zeros(len(self.uses), bool)
        kept[np.argsort(self.uses, kind="stable")[len(kept) // 2 + 1 :]] = True
        stays = kept[self.places]
        self.hashes, self.places = self.hashes[stays], (np.cumsum(kept, dtype=np.int32) - 1)[self.places[stays]]
        self.words, self.ids, self.uses = self.words.filter(pa.array(kept)), self.ids.filter(pa.array(kept)), self.uses[kept] // 2

    def _split(self, piece: str) -> list[str]:
        """The pattern's words in a piece; a special token is a word whatever the pattern says."""
        if self.special is None or not self.special.search(piece):
            return self.pattern.findall(piece)
        return [w for n, part in enumerate(self.special.split(piece)) for w in ([part] if n % 2 else self.pattern.findall(part))]

    def _cut(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the word numbers of all pieces in order, and each piece's bounds in them."""
        lone = np.zeros(len(pieces), bool)
        if self.pattern.pattern == WORD.pattern:
            lone = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False)
        rest = pieces.filter(pa.array(~lone)).to_pylist()
        plain = self.special is None or not self.special.search(" ".join(rest))
        parts = list(map(self.pattern.findall if plain else self._split, rest))
        counts = np.ones(len(pieces), np.int64)
        counts[~lone] = list(map(len, parts))
        words = pa.concat_arrays([pieces.filter(pa.array(lone)), pa.array(list(chain.from_iterable(parts)), pa.string())]).dictionary_encode()
        codes = words.indices.to_numpy()
        numbers = _mixed(np.repeat(lone, counts), codes[: lone.sum()], codes[lone.sum() :])
        return words.dictionary, numbers, np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, pieces: pa.Array, encode_words: Callable[[pa.Array], pa.ListArray]) -> pa.ListArray:
        """The ids of pieces not met before; they and their words are remembered, unless long or of several lines, which hardly recur."""
        words, numbers, bounds = self._cut(pieces)
        at = self._find(words)
        new = at < 0
        strange = words.filter(pa.array(new))
        fresh = encode_words(strange)
        table = pa.concat_arrays([fresh, self.ids.take(pa.array(at[~new]))])
        ids, ends = put_together(table, _mixed(new, np.arange(len(fresh)), np.arange(len(fresh), len(table)))[numbers], bounds)
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        several = pc.and_(pa.array(np.diff(bounds) != 1), pc.invert(pc.match_substring(pieces, "\n")))
        names, ids = pa.concat_arrays([strange, pieces.filter(several)]), pa.concat_arrays([fresh, found.filter(several)])
        short = pc.less_equal(pc.binary_length(names), LONGEST)
        self._remember(names.filter(short), ids.filter(short))
        return found

    def look_up(self, pieces: pa.Array, encode_words: Callable[[pa.Array], pa.ListArray], most: int = REMEMBERED_BYTES) -> pa.ListArray:
        """The ids of each of ``pieces``, which are distinct. Words not met before go to ``encode_words``, which gives their ids; when
        what is remembered has more than ``most`` bytes, half of it goes."""
        if self.held > most:
            self._drop_half()
        at = self._find(pieces)
        met = at >= 0
        self.uses[at[met]] += 1
        known = self.ids.take(pa.array(at[met]))
        if met.all():
            return known
        fresh = self._encode(pieces.filter(pa.array(~met)), encode_words)
        places = _mixed(met, np.arange(len(known)), len(known) + np.arange(len(fresh)))
        return pa.concat_arrays([known, fresh]).take(pa.array(places))


def put_together(table: pa.ListArray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``codes`` one after the other, and the texts' bounds in them."""
    sizes = np.diff(table.offsets.to_numpy())[codes]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return table.take(pa.array(codes)).flatten().to_numpy(), ends[bounds]


def encode_words(words: pa.Array, path: str) -> pa.ListArray:
    """The ids of each word as the library gives them. Words of printed ASCII go to its model, which merges one word; the library's other
    steps would leave them as they are but for the blank. All others go to the whole library."""
    special, merging = special_tokens(path), model(path)
    printed = np.zeros(len(words), bool)
    if merging:
        printed = pc.match_substring_regex(words, PRINTED).to_numpy(zero_copy_only=False) & ~pc.is_in(words, pa.array(special, pa.string())).to_numpy(zero_copy_only=False)
    tables = []
    if printed.any():
        merge, blank = merging[0].tokenize, merging[1]
        chosen = pc.replace_substring(words.filter(pa.array(printed)), " ", blank)
        for start in range(0, len(chosen), 5_000):
            ids = [[t.id for t in merge(w)] for w in chosen.slice(start, 5_000).to_pylist()]
            tables.append(pa.array(ids, pa.list_(pa.uint32())))
    if not printed.all():
        tables.append(id_lists(_encode_together(words.filter(pa.array(~printed)).to_pylist(), path)))
    places = _mixed(printed, np.arange(printed.sum()), printed.sum() + np.arange((~printed).sum()))
    return pa.concat_arrays([pa.array([], pa.list_(pa.uint32())), *tables]).take(pa.array(places))


def _encode_together(words: list[str], path: str) -> list[bytes]:
    """The ids of each word as the library gives them, little-endian unsigned 32-bit integers. Words go to it many at a time with line ends
    between them, where their ids are cut apart; those of white space, special tokens, and a text whose ids don't show every cut go one by one."""
    special = special_tokens(path)
    stop = next(_library([BETWEEN], path))
    together = [at for at, word in enumerate(words) if word and not word[-1].isspace() and word not in special]
    out: list[bytes | None] = [None] * len(words)
    runs = [together[start : start + TOGETHER] for start in range(0, len(together), TOGETHER)]
    for run, ids in zip(runs, _library([BETWEEN.join([*(words[at] for at in run), ""]) for run in runs], path)):
        ends = np.flatnonzero(ids == stop[0]) if len(stop) == 1 else []
        if len(ends) == len(run):
            data, cuts = ids.tobytes(), (ends * 4).tolist()
            for at, start, end in zip(run, [0, *(cut + 4 for cut in cuts)], cuts):
                out[at] = data[start:end]
    alone = [at for at, ids in enumerate(out) if ids is None]
    for at, ids in zip(alone, _library([words[at] for at in alone], path)):
        out[at] = ids.tobytes()
    return out


def _library(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The library's ids of each text."""
    batch = tokenizer(path).encode_batch_fast
    for start in range(0, len(texts), 5_000):
        yield from (np.array(e.ids, "<u4") for e in batch(texts[start : start + 5_000], add_special_tokens=False))


@lru_cache(maxsize=4)
def _known(path: str) -> Known:
    return Known(WORD, special_tokens(path))


def forget() -> None:
    """Drop the words and tokenizers that earlier tasks left in this worker: steps that encode nothing need the memory for themselves."""
    _known.cache_clear()
    tokenizer.cache_clear()
    model.cache_clear()
    if TRIM:
        TRIM(0)


def encode(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the texts' bounds in them, as the library gives them without special tokens
    round a text; a special token's string in a text is that token. Null counts as empty;
    with ``end_id`` every text, also an empty one, ends with that id."""
    pieces, codes, bounds = split(texts)
    table = _known(path).look_up(pieces, lambda words: encode_words(words, path))
    if end_id is not None:
        end = len(table)
        table = pa.concat_arrays([table, pa.array([[end_id]], pa.list_(pa.uint32()))])
        codes = np.insert(codes, bounds[1:], end)
        bounds = bounds + np.arange(len(bounds))
    return put_together(table, codes, bounds)


def binary_slices(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4, "<i8")), data]).cast(pa.binary())
