"""Works in pieces give what whole works give, wherever they are cut."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stylograph.operators import long_texts, surface
from stylograph.operators.cleaning import clean_markdown
from stylograph.operators.tokens import sentence_rows, tokenize, tokenize_pieces
from stylograph.session import checkpoint_folder

PARTS = [
    "word ", "two words ", "a", "\n", "\n\n", "\n\n\n\n", "\r\n", "\r", "# ", "\n## heading with words ", "\n* * *\n", "\n---\n", "---\n", "\n___\n", "\n> ", "*", "**", "***",
    "_", "__", "`", "``", "![", "[", "]", "](", ")", "(", "[text](url)", "![image text](picture)", "[]()", "[x]()", "**bold words**", "*it*", "`code`", " \t", ".", "! ", "? ", "… ",
    "end. Next", "“", "”", '"', "don't ", "’s ", "it’s", "--", "...", "—", "the ", "thou ", "漢字。", "\xa0", "  ", "é", "7", "3.14 ", ", ", "; ", "x\x1fy", "!", "unclosed [ text ",
]


def marked_texts(n, seed, longest=60):
    chosen = random.Random(seed)
    texts = []
    for _ in range(n):
        words = chosen.choice([0.2, 0.6])
        parts = [chosen.choice(["word ", "more words here ", "yes. Then "]) if chosen.random() < words else chosen.choice(PARTS) for _ in range(chosen.randint(1, longest))]
        texts.append(chosen.choice(["", "", "---\nname: x\n", "---\n"]) + "".join(parts))
    return texts


def cut_anywhere(texts, seed):
    chosen, rows = random.Random(seed), []
    for n, text in enumerate(texts):
        cuts = sorted(chosen.randint(0, len(text)) for _ in range(chosen.randint(0, 6)))
        rows += [(f"w{n}", piece, text[a:b]) for piece, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]
    chosen.shuffle(rows)
    return rows


def whole_and_pieces(spark, texts, seed):
    whole = spark.createDataFrame([(f"w{n}", t) for n, t in enumerate(texts)], "work_id string, text string")
    return whole, spark.createDataFrame(cut_anywhere(texts, seed), "work_id string, piece_no long, text string")


def joined(pieces):
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"])
    return {r.work_id: r.text for r in pieces.groupBy("work_id").agg(F.array_join(in_order, "").alias("text")).collect()}


SPECIAL = [
    "", " \n ", "x", "[a long link text](and a long address) after **", "![a picture ![inner](u) [b](c)", "**bold over\n\n many words** rest", "open ** never closed words",
    "[text](never closed words and [more](words)", "![a](b ![c](d) e](f)", "# heading of many many words\nbody text", "body\n# last heading of many words", "*a word\n b* and *more words*",
    "---\ntitle: many words here\n\nmore words\n---\nbody words [x](y)", "---\nnever closed words\n", "_a long_ snake_case_name _", "`code over\nlines` and ` open", "[**](address words)**bold words**",
    "[a](b words c)\n\n\n\n[d](words)", "_**__bold inside__**_", "words(![alt words](u words))[link words](u)", "[text] (no link) [text words](link words)", "a **b *c** d* e words",
]


@pytest.mark.parametrize("seed", range(3))
def test_cleaned_pieces_are_the_cleaned_whole(spark, seed):
    texts = marked_texts(400, seed) + SPECIAL * 8
    whole, pieces = whole_and_pieces(spark, texts, seed)
    want = {r.work_id: r.clean for r in whole.select("work_id", clean_markdown(F.col("text")).alias("clean")).collect()}
    got = joined(long_texts.cleaned_pieces(pieces))
    assert set(got) == set(want)
    wrong = [(texts[int(w[1:])], want[w], got[w]) for w in want if want[w] != got[w]]
    assert not wrong, (len(wrong), wrong[:3])


def test_every_cut_of_a_text(spark):
    text = "---\nt: ab\n---\n# he ad\nto [li nk](ur l) ![im g](pi c)**bo ld** *it al* __un der__ _on e_ `co de`\n\n\n\nen d\n* * *\n"
    rows = [(f"w{cut}", n, part) for cut in range(len(text) + 1) for n, part in enumerate((text[:cut], text[cut:]))]
    want = spark.createDataFrame([(text,)], "text string").select(clean_markdown(F.col("text")).alias("c")).first().c
    assert set(joined(long_texts.cleaned_pieces(spark.createDataFrame(rows, "work_id string, piece_no long, text string"))).values()) == {want}


@pytest.mark.parametrize("seed", [7, 8])
def test_counts_tokens_and_sentences_of_pieces(spark, seed):
    texts = [t for t in marked_texts(250, seed, 120)] + ["", "no blank line " * 300, "one,two,three;" * 200, "Ends. " * 100, "a" * 500]
    whole, pieces = whole_and_pieces(spark, texts, seed)

    def same(a, b):
        left, right = ({tuple(sorted(r.asDict().items())) for r in df.collect()} for df in (a, b))
        assert left == right, (len(left ^ right), sorted(left - right)[:2], sorted(right - left)[:2])

    same(surface.surface_counts(whole), surface.surface_counts_of_pieces(pieces))
    same(surface.type_frequencies(whole), surface.type_frequencies_of_pieces(pieces))
    tokens = tokenize(whole).drop("lower", "is_alpha", "is_punct")
    same(tokens, tokenize_pieces(pieces).drop("lower", "is_alpha", "is_punct"))
    # the switch by length
    same(surface.surface_counts(whole), surface.surface_counts(whole, in_row_chars=50))
    same(tokens, tokenize(whole, in_row_chars=50).drop("lower", "is_alpha", "is_punct"))
    same(sentence_rows(whole), sentence_rows(whole, in_row_chars=50))


def test_a_long_text_without_blank_lines_is_many_rows(spark):
    text = "Some words, and a few more of them; in sentences that end. And [links](with addresses) here " * 30_000
    works = spark.createDataFrame([("w", text)], "work_id string, text string")
    pieces = long_texts.cleaned_pieces(long_texts.in_pieces(works, 50_000))
    sizes = [r.n for r in pieces.select(F.length("text").alias("n")).collect()]
    assert len(sizes) > 40 and max(sizes) < 60_000
    assert surface.surface_counts(works).first() == surface.surface_counts(works, in_row_chars=10_000_000).first()


def test_resolve_by_hand():
    # piece 0 opens state 1, piece 1 says nothing, piece 2 closes it
    assert long_texts.resolve([[1, 1], [0, 1], [0, 0]], [[None], [None], [1]]) == [(0, 1), (1, 1), (1, 0)]
    assert long_texts.resolve([[1, 1], [0, 1], [0, 0]], [[None], [None], [0]]) == [(0, 0), (1, 0), (1, 0)]
    assert long_texts.resolve([], []) == []


def test_cleaning_leaves_one_table(spark):
    texts = ["[a [b " * 40 + "](x [c](d) ![p [q](r) **s** `t` [u", "plain words " * 50, "[[[x](y) ![![z](w) ![v", ""] * 5
    _, pieces = whole_and_pieces(spark, texts, 3)
    root = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(root.glob("kept-*"))
    cleaned = joined(long_texts.cleaned_pieces(pieces))
    left = set(root.glob("kept-*")) - before
    assert len(left) == 1, left
    want = {r.work_id: r.c for r in spark.createDataFrame([(f"w{n}", t) for n, t in enumerate(texts)], "work_id string, text string").select("work_id", clean_markdown(F.col("text")).alias("c")).collect()}
    assert cleaned == want


@pytest.mark.parametrize("name", ["image", "link"])
def test_linear_rules_are_the_rules(spark, name):
    chosen = random.Random(9)
    marks = ["[", "]", "(", ")", "!", "![", "](", "x", "\n", "yz"]
    rows = spark.createDataFrame([("".join(chosen.choice(marks) for _ in range(chosen.randint(0, 14))),) for _ in range(20_000)], "text string")
    span = next(s for s in long_texts.SPANS if s.name == name)
    assert rows.where(F.regexp_replace("text", *span.linear) != F.regexp_replace("text", span.pattern, span.replacement)).isEmpty()


def test_gathered_rows(spark):
    rows = [("w", n, f"{n} ") for n in (5, 1, 30, 2, 11)] + [("v", 0, ""), ("u", 3, "x" * 20), ("u", 4, "y")]
    got = long_texts.gathered(spark.createDataFrame(rows, "work_id string, piece_no long, text string"), 4)
    assert sorted(map(tuple, got.collect())) == [("u", 3, "x" * 20), ("u", 4, "y"), ("v", 0, ""), ("w", 1, "1 2 "), ("w", 5, "5 11 "), ("w", 30, "30 ")]


def test_pieces_that_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(long_texts, "gathered", lambda pieces: pieces)  # else these texts are a row each
    texts = marked_texts(400, 11) + SPECIAL * 8
    whole, pieces = whole_and_pieces(spark, texts, 11)
    want = {r.work_id: r.clean for r in whole.select("work_id", clean_markdown(F.col("text")).alias("clean")).collect()}
    got = joined(long_texts.cleaned_pieces(pieces))
    assert not [(texts[int(w[1:])], got.get(w), want[w]) for w in want if got.get(w) != want[w]][:3]
