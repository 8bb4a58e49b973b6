"""What a worker remembers of words, and which words reach the whole library."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stylograph.llm import tokenize
from stylograph.llm.tokenize import Known, WORD, encode


def new_words(count, start=0):
    return ["".join(chr(97 + n // 26**k % 26) for k in range(4)) + "ing" for n in range(start, start + count)]


@pytest.fixture(autouse=True)
def afresh():
    tokenize.forget()
    yield
    tokenize.forget()


def test_printed_words_skip_the_library_s_other_steps(tokenizer_path, monkeypatch):
    met, plain = [], Tokenizer.from_file(tokenizer_path)

    class Counting:
        def encode_batch_fast(self, given, **options):
            met.extend(given)
            return plain.encode_batch_fast(given, **options)

        def get_added_tokens_decoder(self):
            return plain.get_added_tokens_decoder()

    text = " ".join(new_words(500)) + ", 'tis (3.14) <|endoftext|>don't~ naïve\x01 x"
    monkeypatch.setattr(tokenize, "tokenizer", lambda path: Counting())
    assert encode(pa.array([text]), tokenizer_path)[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not any("ing" in given for given in met) and any("naïve" in given for given in met)


def test_other_files_go_to_the_whole_library(tmp_path, tokenizer_path):
    plain = Tokenizer.from_file(tokenizer_path)
    assert tokenize.model(tokenizer_path)[1] == "Ġ"
    plain.pre_tokenizer.add_prefix_space = True
    plain.save(str(tmp_path / "prefix.json"))
    assert tokenize.model(str(tmp_path / "prefix.json")) is None


def test_a_remembered_word_takes_few_bytes(tokenizer_path):
    encode(pa.array([" ".join(new_words(20_000))]), tokenizer_path)
    assert 0 < tokenize._known(tokenizer_path).held < 100 * 20_000


def test_words_in_use_stay_when_the_memory_is_full():
    asked, known = [], Known(WORD)

    def ids_of(words):
        asked.extend(words.to_pylist())
        return pa.array([[len(w), ord(w[-1])] for w in words.to_pylist()], pa.list_(pa.uint32()))

    for turn in range(20):
        pieces = [" common", " often.", *new_words(300, 300 * turn), "z" * 70]
        found = known.look_up(pa.array(pieces), ids_of, most=20_000).to_pylist()
        assert found == [[7, 110], [6, 110, 1, 46], *([7, 103] for _ in range(300)), [70, 122]]
        assert known.held < 60_000
    assert asked.count(" common") == asked.count(" often") == 1 and asked.count("z" * 70) == 20


def test_words_that_share_a_hash_are_told_apart(tokenizer_path, monkeypatch):
    library = Tokenizer.from_file(tokenizer_path)
    monkeypatch.setattr(tokenize, "hashes_of", lambda words: np.zeros(len(words), np.uint64))
    text = "one two, three two\n\none  two " + " ".join(new_words(50))
    for _ in range(3):
        assert encode(pa.array([text, None, text]), tokenizer_path)[0].tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def test_split_of_rows_with_and_without_odd_white_space():
    rows = ["a b", " c  d\n e", "", "b a c", "　a", "a\n", "  "]
    pieces, codes, bounds = tokenize.split(pa.array(rows))
    names = pieces.to_pylist()
    assert len(set(names)) == len(names)
    assert ["".join(names[c] for c in codes[a:b]) for a, b in zip(bounds, bounds[1:])] == rows
    assert [names[c] for c in codes[bounds[1] : bounds[2]]] == [" c", "  d", "\n e"]
