"""Hashes of words and of word shingles of whole batches of texts, as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and each text's bounds in them. Words are split by white space, lower-cased, and
    stripped of everything but letters, marks and digits; what is then empty is no word."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(flat.dictionary), r"[^\p{L}\p{M}\p{N}]+", "")
    hashes = pd.util.hash_array(plain.to_numpy(zero_copy_only=False), categorize=False) if len(plain) else np.zeros(0, np.uint64)
    empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    return hashes[codes[keep]], np.concatenate([[0], np.cumsum(keep)])[bounds]


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and the text each belongs to; a shorter text that has words is one
    shingle."""
    sizes = np.diff(bounds)
    counts = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.zeros(len(text), np.uint64)
    for step in range(width):
        at = start + step
        inside = at < bounds[1:][text]
        word = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        value = np.where(inside, value * FACTOR + mix(word + np.uint64(1)), value)
    return mix(value), text


def multisets(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in order of (text, value), their texts and how often they occur."""
    order = np.lexsort([values, text])
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return values[at], text[at], np.diff(np.concatenate([at, [len(values)]]))
