import json
import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stylograph.llm import speculative_bpe
from stylograph.llm.queries import op13_speculative_bpe

from .conftest import DATA, ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aàéñßΣσςİıЖ漢字'’.,;:!?-–—()[]{}<>|/\\ \t\n\r\x1c\x1d\x85\xa0　́̈éÅ１２3４①½abcdefghijklmnopqrstuvwxyzTHEthe\x00\x7f😀‍﻿"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def worker():
    return speculative_bpe.speculator(PATH)


def equal(worker, library, texts):
    ids, bounds = worker.encode(pa.array(texts, pa.string()))
    decoded = worker.decode(ids, bounds).to_pylist()
    for text, a, b, found in zip(texts, bounds, bounds[1:], decoded):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, repr(text)[:200]
        assert found == library.decode(want, skip_special_tokens=False)


def test_encode_equals_the_library(worker, library):
    chosen = random.Random(3)
    texts = ["".join(chosen.choice(ALPHABET) for _ in range(chosen.randint(0, 50))) for _ in range(2_000)]
    texts += ["<|endoftext|>x<|startoftext|><|endoftext|", "a<|endoftext|> b", "</w>", "x</w>y", "it's don't I'LL 'S 's", "ab" * 3_000, "<|ENDOFTEXT|>", None, ""]
    texts += ["".join(chosen.choice("abcdeiorst") for _ in range(chosen.randint(1, 14))) for _ in range(5_000)]
    equal(worker, library, texts)


def test_verdicts_on_neighbours_equal_merging(worker):
    chosen = random.Random(4)
    inner, last = list(worker.inner_sound.items()), list(worker.last_sound.items())
    pairs = [(chosen.choice(inner), chosen.choice(last)) for _ in range(4_000)]
    pairs += [(("t", worker.inner["t"]), p) for p in chosen.sample(last, 500)]
    verdicts = worker.stay_apart(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    merged = [worker.merge(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]
    assert verdicts.tolist() == merged and 0 < sum(merged) < len(merged)


def test_guesses_are_kept_only_when_right(worker):
    chosen = random.Random(5)
    words = list({"".join(chosen.choice("abcdeiorst") for _ in range(9)) for _ in range(3_000)})
    right = [worker.propose(w) == worker.merge(w) for w in words]
    assert 0 < sum(right) < len(words)
    assert worker.encode_words(words) == [worker.merge(w) for w in words]


def test_a_long_word_ends(worker, library):
    start = time.time()
    equal(worker, library, ["a" * 200_000, "the" * 100_000 + " x", "-" * 100_000])
    assert time.time() - start < 60


def test_memory_is_bounded_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(speculative_bpe, "REMEMBERED_BYTES", 1_000)
    monkeypatch.setattr(speculative_bpe, "REMEMBERED_PAIRS", 5)
    fresh = speculative_bpe.Speculator(PATH)
    for start in range(0, 60, 20):
        equal(fresh, library, [f"word{n} gardens of Überraschung n{n}" for n in range(start, start + 30)])


def test_merges_out_of_order_and_other_files(tmp_path, worker):
    described = json.load(open(PATH, encoding="utf-8"))
    small = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    merges = [["ab", "c</w>"], ["a", "b"], ["b", "c</w>"], ["ab", "ab"], ["a", "a"], ["aa", "a</w>"]]
    vocab = {t: i for i, t in enumerate([*small, *("".join(m) for m in merges)])}
    described["model"] |= {"vocab": vocab, "merges": merges}
    described["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(described))
    made, library = speculative_bpe.Speculator(str(path)), Tokenizer.from_file(str(path))
    assert not made.ordered and worker.ordered
    chosen = random.Random(6)
    for _ in range(500):
        word = "".join(chosen.choice("abc") for _ in range(chosen.randint(1, 12)))
        assert made.encode_words([word])[0] == library.encode(word).ids
    described["model"]["byte_fallback"] = True
    path.write_text(json.dumps(described))
    with pytest.raises(ValueError):
        speculative_bpe.Speculator(str(path))


def test_frames(spark, odd, nothing, library):
    found = speculative_bpe.round_trip(odd, PATH).collect()
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in found), key=repr) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in found)
    again = speculative_bpe.decode(speculative_bpe.encode(odd, PATH), PATH, "doc_id").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert speculative_bpe.round_trip(nothing, PATH).count() == 0
    with_null = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in speculative_bpe.decode(with_null, PATH, "k").collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}
    with pytest.raises(Exception, match="does not have"):
        speculative_bpe.decode(spark.createDataFrame([(1, [99_999])], "k long, ids array<int>"), PATH, "k").collect()


def test_query_on_documents(spark, library):
    from hashlib import sha256

    digest = lambda text: sha256(text.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in op13_speculative_bpe(spark, str(DATA)).collect()} == want
