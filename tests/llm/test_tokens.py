import io
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from stylograph.llm import bpe, packing, token_files, tokenize
from stylograph.llm.tokenize import encode

from .conftest import DATA, ODD


@pytest.fixture(scope="module")
def library(tokenizer_path):
    loaded = Tokenizer.from_file(tokenizer_path)
    return lambda text: loaded.encode(text or "", add_special_tokens=False).ids


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_encode_equals_the_library(spark, tokenizer_path, library):
    rows = [t for _, t in ODD] + ["   x", "a\n b", "a \n\nb  \t c", "x\u3000y  z", "a\x1c b\x1c\x1c c", "\n\n", "a   b    c\n\n\n  d ", "<|endoftext|> x", "a  <|endoftext|>b<|endoftext|>\n c", " <|endoftext|>  c", "<|endoftext|"] + texts(spark)
    ids, bounds = encode(pa.array(rows), tokenizer_path, end_id=9)
    for text, a, b in zip(rows, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*library(text), 9]


def test_words_go_to_the_library_together(tokenizer_path, library, monkeypatch):
    met = []
    plain = Tokenizer.from_file(tokenizer_path)

    class Counting:
        def encode_batch_fast(self, given, **options):
            met.extend(given)
            return plain.encode_batch_fast(given, **options)

        def get_added_tokens_decoder(self):
            return plain.get_added_tokens_decoder()

    text = " ".join(f"w{chr(97 + n % 26)}{'xyz'[n % 3] * (n // 26)}, 'S've '{n}" for n in range(900)) + " <|endoftext|>\x1d\x1d x\x1c"
    tokenize.forget()
    monkeypatch.setattr(tokenize, "tokenizer", lambda path: Counting())
    ids, _ = encode(pa.array([text]), tokenizer_path)
    assert ids.tolist() == library(text)
    assert len(met) < 50


def test_forget_drops_what_a_worker_remembers(tokenizer_path):
    encode(pa.array(["some words"]), tokenizer_path)
    assert tokenize._known.cache_info().currsize
    tokenize.forget()
    assert not tokenize._known.cache_info().currsize and not tokenize.tokenizer.cache_info().currsize


def test_vector_best_fit_keeps_every_capacity():
    random = np.random.default_rng(1)
    demands = np.stack([random.integers(1, 50, 400), np.ones(400), random.integers(1, 30, 400)], 1).astype(float)
    capacities = np.array([100.0, 7.0, 60.0])
    for score in ("norm", "dot"):
        bins = packing.vector_best_fit(demands, capacities, np.array([1.0, 0.5, 0.7]), score)
        filled = np.stack([np.bincount(bins, d) for d in demands.T], 1)
        assert (filled <= capacities).all()
        assert len(filled) <= 1.25 * (demands.sum(0) / capacities).max() + 2


def check_packing(rows, library, found, capacity):
    by_sequence, by_row = {}, {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= capacity and crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_row.setdefault(r.doc_id, []).append((r.piece, r.start, ids.tolist()))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i in {i for i, _ in rows}:
        want = sorted([*library(t), 2] for j, t in rows if j == i)
        pieces = sorted(by_row[i])
        assert sum(len(p[2]) for p in pieces) == sum(map(len, want))
        if len(want) == 1:
            assert [x for p in pieces for x in p[2]] == want[0] and all(len(p[2]) == capacity for p in pieces[1:])
            assert [p[1] for p in pieces] == np.cumsum([0, *(len(p[2]) for p in pieces[:-1])]).tolist()
    return len(by_sequence)


def test_pack_documents(spark, odd, nothing, tokenizer_path, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = check_packing(rows, library, packing.pack_documents(docs, tokenizer_path, ids=True).collect(), 1024)
    least = -(-sum(len(library(t)) + 1 for _, t in rows) // 1024)
    assert n <= 1.02 * least + 1
    assert check_packing(ODD, library, packing.pack_documents(odd, tokenizer_path, 64, ids=True).collect(), 64)
    bounded = packing.pack_documents(docs, tokenizer_path, max_documents=2, max_attention=300_000, shard_items=50, ids=True).collect()
    check_packing(rows, library, bounded, 1024)
    cost = {}
    for r in bounded:
        cost.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(c) <= 2 and (len(c) == 1 or sum(x * x for x in c) <= 300_000) for c in cost.values())
    assert packing.pack_documents(nothing, tokenizer_path).count() == 0


def test_token_files(spark, odd, nothing, tokenizer_path, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for rows, frame in (([(r.doc_id, r.text) for r in docs.collect()], docs), (ODD, odd)):
        found = sorted(token_files.token_files(frame, tokenizer_path, files=3).collect(), key=lambda r: r.start)
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
        at = 0
        for r, (i, text) in zip(found, ordered, strict=True):
            want = [*library(text), 0]
            assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(want), want)
            at += len(want)
    assert token_files.token_files(nothing, tokenizer_path).count() == 0


def test_chosen_documents_only(spark, tokenizer_path, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    manifest = token_files.write_token_files(docs, str(tmp_path), tokenizer_path)
    whole = {r.doc_id: r for r in token_files.read_token_files(manifest, docs.schema["doc_id"].dataType).collect()}
    some = token_files.read_token_files(manifest, docs.schema["doc_id"].dataType, wanted=[3, 150]).collect()
    assert sorted(r.doc_id for r in some) == [3, 150] and all(r == whole[r.doc_id] for r in some)


def test_damaged_frame_is_found():
    sink = io.BytesIO()
    writer = token_files.FrameWriter(sink)
    writer.add(pa.array([1, 2]), [memoryview(b"abcd" * 50), memoryview(b"")])
    writer.close()
    data = bytearray(sink.getvalue())
    reader = token_files.FrameReader(pa.BufferReader(bytes(data)))
    assert reader.document(0) == b"abcd" * 50 and reader.document(1) == b""
    data[-13] ^= 1  # the last entry's checksum
    with pytest.raises(ValueError):
        token_files.FrameReader(pa.BufferReader(bytes(data))).document(1)


def test_bpe_round_trip(spark, odd, nothing, ranks_path):
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens={})
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for frame in (docs, odd):
        rows = sorted((tuple(r[:2]) for r in frame.collect()), key=repr)
        found = bpe.round_trip(frame, ranks_path, public_tokenizers.PATTERN).collect()
        got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in found if r.doc_id is not None)
        want = sorted((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows if i is not None)
        assert got == want and len(found) == len(rows)
    assert bpe.round_trip(nothing, ranks_path, public_tokenizers.PATTERN).count() == 0


def test_bpe_decodes_ids_of_any_origin(spark, ranks_path):
    ids = np.array([464, 3290, 0], "<u4").tobytes()
    frame = spark.createDataFrame([(1, ids), (2, None), (3, b"")], "k long, ids binary")
    out = {r.k: bytes(r.bytes) for r in bpe.decode(frame, ranks_path, public_tokenizers.PATTERN, "k").collect()}
    assert out == {1: b"The dog!", 2: b"", 3: b""}
    with pytest.raises(Exception, match="does not have"):
        bpe.decode(spark.createDataFrame([(1, np.array([99_999], "<u4").tobytes())], "k long, ids binary"), ranks_path, public_tokenizers.PATTERN, "k").collect()


def test_bpe_merges_long_words(ranks_path):
    import random
    import time

    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens={})
    worker = bpe.coder(ranks_path, public_tokenizers.PATTERN)
    chosen = random.Random(8)
    words = ["a" * 1_000_000, "ab" * 30_000, "the" * 5_000 + "é" * 3_001, "".join(chosen.choice("abcdefghij") for _ in range(6_000)), "=" * 4_999]
    start = time.time()
    for word, ids in zip(words, worker.encode_words(words)):
        want = encoding.encode_ordinary(word) if len(word) < 100_000 else encoding.encode_ordinary("a" * 8_192)[:1] * (len(ids) // 4)
        assert np.frombuffer(ids, "<u4").tolist()[: len(want)] == want
        assert encoding.decode(np.frombuffer(ids, "<u4").tolist()) == word
    assert time.time() - start < 120


def test_bpe_round_by_round_equals_the_library(spark, ranks_path, monkeypatch):
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens={})
    worker = bpe.Coder(ranks_path, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LONG", 2)
    words = ["hello", "aaaaaaa", " internationalisation", "ababababab"] + sorted({w for t in texts(spark)[:3] for w in t.split()})[:150]
    words = [w for w in words if w.isalpha() or w[0] == " "]
    assert [np.frombuffer(i, "<u4").tolist() for i in worker.encode_words(words)] == [encoding.encode_ordinary(w) for w in words]


def test_bpe_rounds_when_a_token_ranks_before_its_parts(tmp_path):
    """xy makes a token that joins the next x at once, so the second xy is never merged."""
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"xyx", b"xy", b"zz", b"zzzz", b"yz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % n for n, t in enumerate(ranks)))
    worker = bpe.Coder(str(path), r"\w+")
    for word in (b"xyxy", b"xyxyxyx", b"zzzzzzz", b"xyzxyzz", b"yxyx"):
        short = np.frombuffer(worker._merge([word])[0], "<u4").tolist()
        assert np.frombuffer(worker._merge_long(word), "<u4").tolist() == short


def test_query_columns(spark, tokenizer_path, ranks_path, library):
    """What the queries derive: checksums and digests of ids and bytes."""
    from hashlib import sha256

    from stylograph.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {i: library(t) for i, t in texts.items()}
    data = lambda values: np.array(values, "<u4").tobytes()
    for r in QUERIES["op4_best_fit_packing"](spark, str(DATA)).collect():
        assert r.ids_crc32 == crc32(data([*ids[r.doc_id], 2][r.start : r.start + r.length]))
    for r in QUERIES["op7_token_files"](spark, str(DATA)).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]) + 1, crc32(data([*ids[r.doc_id], 0])))
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens={})
    for r in QUERIES["op9_byte_level_bpe"](spark, str(DATA)).collect():
        own = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha256(data(own)).hexdigest(), sha256(texts[r.doc_id].encode()).hexdigest())
