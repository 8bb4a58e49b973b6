"""Measures: worked values, and the text path against the token path."""

import random
import math

import pytest
from pyspark.sql import functions as F

from stylograph.functions.arrays import token_depths
from stylograph.functions.lexicons import ALL_SERIES, FUNCTION_WORDS, SURFACE_SERIES
from stylograph.operators import annotated, measures, surface
from stylograph.operators.tokens import sentence_token_rows, sentence_tokens, tokenize
from stylograph.sources import works as work_files
from suite import inputs


def works(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "work_id string, text string")


def surface_of(spark, in_row_chars=surface.IN_ROW_CHARS, **texts):
    counts = surface.surface_counts(works(spark, **texts), in_row_chars)
    return {r["work_id"]: r for r in measures.measure(counts, measures.SURFACE, "n_words", "n_quoted").collect()}


def test_series_names():
    assert len(ALL_SERIES) == len(set(ALL_SERIES)) == 63
    assert tuple(measures.ALL) == ALL_SERIES
    assert tuple(measures.SURFACE) == SURFACE_SERIES


@pytest.mark.parametrize("in_row_chars", [surface.IN_ROW_CHARS, 0])
def test_worked_values(spark, in_row_chars):
    got = surface_of(
        spark,
        in_row_chars,
        richness="a a b",
        hapax="a b",
        length="été ab",
        two="One two. One two three four.",
        marked="a b. ! c d e f.",
        dense="the the cat",
        clitics="I don’t know. It's fine.",
        dash="a — b – c -- d... e… (f)",
        quotes='a “ b ” c " d " e “ f',
        archaic="Thou hast thy cat",
        empty="",
    )
    assert got["richness"]["yules_k"] == pytest.approx(20000 / 9)
    assert got["richness"]["honore_r"] == pytest.approx(100 * math.log(3) / 0.5)
    assert got["hapax"]["honore_r"] == 0.0
    assert got["length"]["mean_word_length"] == 2.5
    assert (got["two"]["mean_sentence_length"], got["two"]["sentence_length_stdev"]) == (3.0, 1.0)
    assert got["hapax"]["sentence_length_stdev"] == 0.0
    assert got["marked"]["mean_sentence_length"] == 2.0
    assert got["dense"]["funcword_the"] == pytest.approx(2 / 3)
    assert sum(got["dense"][f"funcword_{w}"] for w in FUNCTION_WORDS) == pytest.approx(2 / 3)
    assert got["clitics"]["n_words"] == 5 and got["clitics"]["contraction_rate"] == 2 / 5
    assert (got["dash"]["punct_dash"], got["dash"]["punct_ellipsis"], got["dash"]["punct_parenthesis"]) == (3 / 6, 2 / 6, 2 / 6)
    assert got["dash"]["punct_period"] == 0.0
    assert (got["quotes"]["n_words"], got["quotes"]["n_quoted"]) == (6, 3)
    assert got["archaic"]["archaic_word_rate"] == 0.75
    assert [got["empty"][s] for s in SURFACE_SERIES] == [0.0] * len(SURFACE_SERIES)


def test_pieces_merge_exactly(spark):
    """A work cut into many pieces gives the very same counts, quotes running across the cuts."""
    paragraph = 'He said “yes, and then no. "Why?" It was the end... (or not)'
    text = "\n\n".join(f"{paragraph} word{i % 7} don't" for i in range(200))
    works_ = works(spark, long=text, short="the cat", other=text[:5000])
    whole = surface.surface_counts(works_)
    pieces = surface.piece_counts(
        works_.select("work_id", F.posexplode(F.split("text", "\n\n")).alias("piece_no", "text")),
        surface.text_counts(F.col("text")),
    )
    wanted = {r["work_id"]: r.asDict() for r in whole.collect()}
    assert {r["work_id"]: r.asDict() for r in surface.merged_counts(pieces).collect()} == wanted
    by_two = surface.PIECES_PER_BLOCK
    try:
        surface.PIECES_PER_BLOCK = 3
        assert {r["work_id"]: r.asDict() for r in surface.merged_counts(pieces).collect()} == wanted
    finally:
        surface.PIECES_PER_BLOCK = by_two


def labelled_tokens(works_):
    tokens = tokenize(works_).withColumn("tag", F.lit(None).cast("string"))
    for labels in inputs.RULE_LABELS:
        tokens = tokens.withColumns(labels(tokens))
    return tokens


def test_token_table_agrees_with_texts(spark):
    texts = {
        f"w{i}": f"It’s the {'very ' * i}end -- “he said. No\" and don't ... (why)?\n\nThou walking slowly; happily {i}. Dangerous!"
        for i in range(6)
    } | {"empty": "", "marks": "... !"}
    works_ = works(spark, **texts)
    from_tokens = annotated.token_counts(labelled_tokens(works_), works_)
    columns = [c for c in surface.surface_counts(works_).columns]
    want = {r["work_id"]: r.asDict() for r in surface.surface_counts(works_).collect()}
    got = {r["work_id"]: r.asDict() for r in from_tokens.select(columns).collect()}
    assert got == want
    for few in (1, 60):  # in shares of works, also repeated ones
        doubled = works_.unionByName(works_.where("work_id = 'w3'"))
        shared = annotated.token_counts(labelled_tokens(doubled), doubled, share_tokens=few)
        whole = annotated.token_counts(labelled_tokens(doubled), doubled)
        assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, whole.collect()))
    packed = sentence_tokens(works_, labels=inputs.RULE_LABELS)
    again = annotated.token_counts(labelled_tokens(works_), works_, packed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, from_tokens.collect()))
    rows = annotated.measured(from_tokens).collect()
    assert len(rows) == len(texts) * len(ALL_SERIES)
    assert all(r["value"] == 0.0 for r in rows if r["work_id"] == "empty")
    shares = {}
    for r in rows:
        if r["metric"].startswith("senttype_"):
            shares[r["work_id"]] = shares.get(r["work_id"], 0) + r["value"]
    assert all(total == pytest.approx(1.0) for work, total in shares.items() if work != "empty")


@pytest.mark.parametrize("in_row_chars", [surface.IN_ROW_CHARS, 10])
def test_words_and_types_of_texts(spark, in_row_chars):
    works_ = works(spark, a="The cat.\n\nDon't the *cat* İs\n\nthe", b="", c="?! 7")
    tokens = tokenize(works_)
    types = sorted(map(tuple, surface.type_frequencies(works_, in_row_chars).collect()))
    assert types == sorted(map(tuple, annotated.type_frequencies(tokens).collect()))
    assert ("a", "the", 3) in types and ("a", "do", 1) in types
    assert dict(map(tuple, surface.word_counts(works_).collect())) == {"a": 7, "b": 0, "c": 0}


def test_markup_may_cross_chapter_ends(spark):
    """Chapters are joined before they are cleaned."""
    texts = ["---\ntitle: x\n---\nHe **said", "loudly** “yes [a", "page](http://x) no” `code", "more` end."]
    rows = [("w", f"Chapter-{i}.md", t) for i, t in enumerate(texts, start=9)] + [("v", "a.md", "The cat.")]
    assembled = work_files.assemble(spark.createDataFrame(rows, "work_id string, name string, text string"))
    counts = {r["work_id"]: r for r in surface.surface_counts(assembled).collect()}
    want = surface.surface_counts(works(spark, w="He said loudly “yes a page no” code more end.")).collect()[0]
    assert counts["w"]["n_words"] == want["n_words"] == 10 and counts["w"]["n_quoted"] == want["n_quoted"]


def test_long_sentences_need_no_packing(spark):
    """Sentences beyond the packing limit give the same facts, here a chain, a star and mixed trees."""
    works_ = works(spark, **{f"w{i}": "A walking " + "slowly dangerous hopping word " * (i * 7) + "stopped." for i in range(4)})
    tokens = labelled_tokens(works_)
    chain = tokens.where("work_id = 'w1'").withColumns({"work_id": F.lit("chain"), "head_no": F.expr("greatest(sent_tok_no - 1, 1)")})
    star = tokens.where("work_id = 'w2'").withColumns({"work_id": F.lit("star"), "head_no": F.expr("if(sent_tok_no < 3, 1, 2)")})
    bare = tokens.where("work_id = 'w2'").withColumns({"work_id": F.lit("bare"), "head_no": F.expr("CAST(NULL AS INT)")})
    gaps = tokens.where("work_id = 'w1'").withColumns({"work_id": F.lit("gaps"), "sent_tok_no": F.expr("sent_tok_no * 3"), "head_no": F.expr("greatest(sent_tok_no - 1, 1) * 3")})
    cycle = tokens.where("work_id = 'w2'").withColumns({"work_id": F.lit("cycle"), "head_no": F.expr("if(sent_tok_no = 2, 3, if(sent_tok_no = 3, 2, 1))")})
    lost = tokens.where("work_id = 'w2'").withColumns({"work_id": F.lit("lost"), "head_no": F.expr("if(sent_tok_no = 2, 999, 1)")})
    tokens = tokens.unionByName(chain).unionByName(star).unionByName(bare).unionByName(gaps).unionByName(cycle).unionByName(lost)
    want = sorted(map(tuple, annotated.token_sentence_facts(tokens).collect()))
    assert sorted(map(tuple, annotated.token_sentence_facts(tokens, packed_tokens=10).collect())) == want
    depths = {r[0]: r[5] for r in want}
    assert depths["chain"] == depths["gaps"] == 31 and depths["star"] == 2
    assert depths["bare"] is None and depths["cycle"] is None and depths["lost"] is None


def test_quote_blocks_chain(spark):
    text = 'a “ b ” c " d " e “ f g " h ” i ' * 20
    works_ = works(spark, w=text)
    want = surface.surface_counts(works_).collect()[0]["n_quoted"]
    before = annotated.TOKENS_PER_BLOCK
    try:
        annotated.TOKENS_PER_BLOCK = 5
        assert annotated.quoted_words(tokenize(works_)).collect()[0]["n_quoted"] == want
    finally:
        annotated.TOKENS_PER_BLOCK = before


def test_depths(spark):
    chain = [max(1, i) for i in range(300)]
    heads = spark.createDataFrame([([1, 1, 2, 3, 3],), ([1],), (chain,), ([2, 1],)], "heads array<int>")
    depths = [r[0] for r in heads.select(token_depths(F.col("heads"))).collect()]
    assert depths[0] == [0, 1, 2, 3, 3]
    assert depths[1] == [0]
    assert depths[2] == list(range(300))
    assert depths[3] == [None, None]  # a cycle has no root


PACKED = "work_id string, sent_no int, tokens array<struct<sent_tok_no:int,is_alpha:boolean,pos:string,dep:string,head_no:int>>"


def sentence(*tokens):
    return [(i, True, pos, dep, head) for i, (pos, dep, head) in enumerate(tokens, start=1)]


def test_sentence_kinds(spark):
    rows = [
        ("a", 1, sentence(("VERB", "ROOT", 1), ("VERB", "conj", 1), ("VERB", "advcl", 1))),
        ("a", 2, sentence(("VERB", "ROOT", 1), ("NOUN", "conj", 1))),
        ("a", 3, sentence(("VERB", "ROOT", 1), ("AUX", "conj", 1))),
        ("a", 4, sentence(("VERB", "ROOT", 1), ("NOUN", "obj", 1), ("VERB", "conj", 2))),
        ("b", 1, sentence(("VERB", None, None))),
    ]
    facts = annotated.sentence_facts(spark.createDataFrame(rows, PACKED))
    kinds = {(r["work_id"], r["sent_no"]): r["kind"] for r in facts.collect()}
    assert kinds == {("a", 1): "complex", ("a", 2): "simple", ("a", 3): "compound", ("a", 4): "simple", ("b", 1): None}
    counts = {r["work_id"]: r for r in annotated.sentence_counts(facts).collect()}
    assert counts["a"]["n_parsed_sentences"] == 4 and counts["a"]["sum_depth"] == 1 + 1 + 1 + 2
    assert counts["b"]["n_parsed_sentences"] is None and counts["b"]["n_sentences"] == 1


def test_unparsed_works_have_no_tree_rows(spark):
    works_ = works(spark, a="One two. Three.")
    tokens = labelled_tokens(works_).withColumn("dep", F.lit(None).cast("string"))
    rows = annotated.measured(annotated.token_counts(tokens, works_)).collect()
    assert {r["metric"] for r in rows} == set(ALL_SERIES) - {"mean_parse_tree_depth", "senttype_simple", "senttype_compound", "senttype_complex"}


def test_contractions_and_possessives(spark):
    rows = [("w", 1, i, t, t.lower(), tag, t.isalpha()) for i, (t, tag) in enumerate(
        [("do", "VB"), ("n’t", "RB"), ("it", "PRP"), ("'s", "VBZ"), ("Tom", "NNP"), ("'s", "POS"), ("'s", None)], start=1)]
    tokens = spark.createDataFrame(rows, "work_id string, sent_no int, tok_no long, text string, lower string, tag string, is_alpha boolean")
    assert tokens.agg(F.count_if(annotated.is_contraction())).collect()[0][0] == 3


def test_vocabulary(spark):
    rows = [
        ("w", "Journeys", "Journey", "NOUN", True, False),
        ("w", "journeyed", "journey", "VERB", True, False),
        ("w", "the", "the", "DET", True, True),
        ("w", "Peak", "Peak", "PROPN", True, False),
        ("w", "is", "be", "VERB", True, True),
        ("w", "7th", "7th", "ADJ", False, False),
    ]
    tokens = spark.createDataFrame(rows, "work_id string, text string, lemma string, pos string, is_alpha boolean, is_stop boolean")
    assert [tuple(r) for r in annotated.vocabulary(tokens).collect()] == [("w", "journey", 2)]


def test_facts_of_token_rows_are_those_of_packed_sentences(spark, monkeypatch):
    chosen, rows = random.Random(4), []
    for n in range(600):
        size = chosen.randint(1, 12)
        gaps = chosen.random() < 0.3
        places = sorted(chosen.sample(range(1, 20), size)) if gaps else list(range(1, size + 1))
        for at, place in enumerate(places):
            head = None if chosen.random() < 0.02 else chosen.choice([place, *places, chosen.randint(0, 21)])
            if n % 2:
                head = places[0] if at < 2 else places[chosen.randint(0, at - 1)]
            dep = chosen.choice(["ROOT", "conj", "dep", "dep", "dep"]) if chosen.random() > 0.02 else None
            if n % 5 == 0 and chosen.random() < 0.1:
                dep = "advcl"
            rows.append((f"w{n % 7}" if n % 7 else None, n, at, place, chosen.random() < 0.7, chosen.choice(["ADJ", "ADV", "VERB", "NOUN", None]), dep, head))
    tokens = spark.createDataFrame(rows, "work_id string, sent_no int, at int, sent_tok_no int, is_alpha boolean, pos string, dep string, head_no int").coalesce(1)
    packed = tokens.groupBy("work_id", "sent_no").agg(F.array_sort(F.collect_list(F.struct("sent_tok_no", "is_alpha", "pos", "dep", "head_no"))).alias("tokens"))
    want = sorted(map(str, annotated.sentence_facts(packed).collect()))
    for at_once in (1, 40, 100_000):
        monkeypatch.setattr(annotated, "TOKENS_AT_ONCE", at_once)
        assert sorted(map(str, annotated.sentence_facts_of_rows(tokens).collect())) == want
    kinds = {r.kind for r in annotated.sentence_facts(packed).collect()}
    assert kinds == {None, "simple", "compound", "complex"}


def test_labelled_texts_are_measured_without_packing(spark):
    texts = {"a": "Slowly it went. “No!” he said, and the dangerous cats walked…\n\nWhy?", "b": "", "c": "...", "d": "don't " * 500 + ". Next one"}
    works_ = works(spark, **texts)
    rows = annotated.sentence_facts_of_rows(sentence_token_rows(works_, labels=inputs.RULE_LABELS))
    packed = annotated.sentence_facts(sentence_tokens(works_, labels=inputs.RULE_LABELS))
    assert sorted(map(str, rows.collect())) == sorted(map(str, packed.collect()))
