from pathlib import Path

import public_tokenizers
import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def ranks_path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Texts that hold what the operators must bear: null, empty, blank, repeated, long, odd white space, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a  b\n\n c"), (4, "a  b\n\n c"), (5, "A word's end,  don't!"), (6, "漢字 x é\x85f"),
    (7, "<|endoftext|> x"), (8, "ab" * 3_000), (9, "one two three four five six seven " * 900), (None, "no id"), (10, "a b c"), (11, "a bc"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", "y", "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, version string, content string").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
