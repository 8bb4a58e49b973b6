"""Cleaning, splitting, tokens."""

from hashlib import md5

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from stylograph.operators.cleaning import cleaned
from stylograph.operators.pieces import chunks, paragraph_rows
from stylograph.operators.tokens import (
    annotate,
    pack_sentences,
    restore_order,
    sentence_rows,
    tokenize,
    with_lexical_columns,
)
from suite.queries import toy_annotator, whole_texts


def works(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "work_id string, text string")


def by_work(df):
    return {r["work_id"]: r for r in df.collect()}


CLEANING = [
    ("a\r\nb\rc", "a\nb\nc"),
    ("---\ntitle: x\n---\nBody", "Body"),
    ("Body\n---\ntitle: x\n---\nmore", "Body\n\ntitle: x\n\nmore"),
    ("# Head\ntext\n####### seven\n#none", "text\n####### seven\n#none"),
    ("a\n* * *\nb\n***\nc\n---\nd\n___\ne\n**\nf", "a\n\nb\n\nc\n\nd\n\ne\n**\nf"),
    ("> said\n>> twice", "said\n> twice"),
    ("see ![alt](u.png) and [label](http://x) or [l](u)", "see  and label or l"),
    ("**bold** __bold__ *it* _it_ `code`", "bold bold it it code"),
    ("*not\nitalic*", "*not\nitalic*"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("   x—“y”… 　\n", "x—“y”…"),
    ("head # not\n  ## yes\u0085no", "head # not"),
    ("", ""),
]


def test_cleaning_rules(spark):
    got = by_work(cleaned(works(spark, *(raw for raw, _ in CLEANING))))
    assert [got[str(i)]["text"] for i in range(len(CLEANING))] == [want for _, want in CLEANING]


def test_cleaning_survives_long_rule_lines(spark):
    # No rule line, so its stars pair up as italics around blanks.
    line = "* " * 40_000 + "x"
    dots = "." * 40_000 + "x"
    assert by_work(cleaned(works(spark, line)))["0"]["text"] == "x"
    assert sentence_rows(works(spark, dots)).count() == 1


def test_filter_above_cleaning_stays_small(spark):
    """A filter on a cleaned text must not multiply the expression (it once ran out of memory)."""
    assert cleaned(works(spark, "**a** b")).where(F.length("text") > 1).count() == 1


def test_chunks_pack_greedily(spark):
    text = "aaaa\n\nbbb\n \n" + "c" * 14 + "\n\nd"
    rows = chunks(works(spark, text), 10).orderBy("chunk_no").collect()
    assert [r["text"] for r in rows] == ["aaaa\n\nbbb", "c" * 14, "d"]
    assert [r["text"] for r in chunks(works(spark, text), 1000).collect()] == ["aaaa\n\nbbb\n\n" + "c" * 14 + "\n\nd"]
    assert [r["text"] for r in paragraph_rows(works(spark, text)).orderBy("paragraph_no").collect()][1:3] == ["bbb", "c" * 14]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=20), st.integers(3, 30))
def test_chunks_lose_nothing(spark, texts, limit):
    paragraphs = paragraph_rows(works(spark, *texts)).orderBy("work_id", "paragraph_no").collect()
    parts = chunks(works(spark, *texts), limit).orderBy("work_id", "chunk_no").collect()
    for i in map(str, range(len(texts))):
        whole = "\n\n".join(r["text"] for r in paragraphs if r["work_id"] == i)
        assert "\n\n".join(r["text"] for r in parts if r["work_id"] == i) == whole


def test_tokens(spark):
    text = "I don’t -- really... It's Tom's “end”. Été 12%!\n\nnext"
    rows = tokenize(works(spark, text)).orderBy("tok_no").collect()
    assert [r["text"] for r in rows] == [
        "I", "do", "n’t", "--", "really", "...", "It", "'s", "Tom", "'s", "“", "end", "”", ".", "Été", "12", "%", "!", "next",
    ]
    assert [r["tok_no"] for r in rows] == list(range(1, 20))
    assert [r["sent_no"] for r in rows] == [1] * 6 + [2] * 8 + [3] * 4 + [4]
    assert {r["text"] for r in rows if r["is_alpha"]} == {"I", "do", "really", "It", "Tom", "end", "Été", "next"}
    assert not [r for r in rows if r["text"] == "n’t" and (r["is_alpha"] or r["is_punct"])]


def test_pack_keeps_order(spark):
    packed = pack_sentences(tokenize(works(spark, "One two three. Four five."))).orderBy("sent_no").collect()
    assert [[t["text"] for t in r["tokens"]] for r in packed] == [["One", "two", "three", "."], ["Four", "five", "."]]


def test_lexicon_beats_rules(spark):
    lexicon = spark.createDataFrame(
        [("quickly", "NOUN", "quick", None)], "lower string, pos string, lemma string, is_stop boolean"
    )
    rows = by_work(
        with_lexical_columns(tokenize(works(spark, "quickly", "slowly", "the", "stories", "7")), lexicon)
    )
    assert [rows[str(i)]["pos"] for i in range(5)] == ["NOUN", "ADV", "NOUN", "NOUN", "NUM"]
    assert [rows[str(i)]["lemma"] for i in range(5)] == ["quick", "slowly", "the", "story", "7"]
    assert [rows[str(i)]["is_stop"] for i in range(5)] == [False, False, True, False, False]


@pytest.mark.parametrize("limit", [20, 100_000])
def test_annotator_order_is_restored(spark, limit):
    texts = [f"Word{i} one. Two {i}!\n\nThree four five.\n\nSix {i}" for i in range(5)] + [""]
    ordered = restore_order(annotate(works(spark, *texts), toy_annotator, limit, batch=2))
    rows = ordered.where("work_id = '3'").orderBy("tok_no").collect()
    assert [r["text"] for r in rows] == ["Word", "3", "one", ".", "Two", "3", "!", "Three", "four", "five", ".", "Six", "3"]
    assert [r["tok_no"] for r in rows] == list(range(1, 14))
    assert [r["sent_no"] for r in rows] == [1] * 4 + [2] * 3 + [3] * 4 + [4] * 2
    assert ordered.columns[:3] == ["work_id", "sent_no", "tok_no"]


def test_carried_offsets_change_no_number(spark):
    """Tokens whose chunks carry their offsets are placed without a join; carried or not, also where a work comes twice, the numbers are those of the chunks' totals."""
    texts = [f"Word{i} one. Two {i}!\n\nThree four five.\n\nSix {i}\n\n{'more words ' * i}" for i in range(5)]
    whole = works(spark, *texts)
    twice = whole.unionByName(whole.where("work_id = '2'")).unionByName(whole.where("work_id = '4'").select(F.lit("3").alias("work_id"), F.concat(F.lit("A b c d. E f g!\n\n"), "text").alias("text")))
    null = whole.where("work_id = '1'").withColumn("work_id", F.lit(None).cast("string"))
    for rows, joins in ((whole, False), (twice.unionByName(null), True)):
        tokens = annotate(rows, toy_annotator, 20, batch=2).localCheckpoint()
        ordered = restore_order(tokens)
        assert ("Join" in ordered._jdf.queryExecution().optimizedPlan().toString()) == joins
        totals = {}
        for t in tokens.collect():
            if t["work_id"] is not None:
                key = (t["work_id"], t["chunk_no"])
                totals[key] = tuple(map(max, totals.get(key, (0, 0)), (t["tok_no"], t["sent_no"])))
        before = lambda w, c, n: sum(v[n] for (work, chunk), v in totals.items() if work == w and chunk < c)
        want = sorted((t["work_id"], t["sent_no"] + before(t["work_id"], t["chunk_no"], 1), t["tok_no"] + before(t["work_id"], t["chunk_no"], 0), t["text"]) for t in tokens.collect() if t["work_id"] is not None)
        for table in (ordered, restore_order(tokens.drop("tok_offset", "sent_offset"))):
            assert sorted((r["work_id"], r["sent_no"], r["tok_no"], r["text"]) for r in table.collect()) == want


def test_whole_texts_are_digests_of_pieces_in_order(spark):
    rows = [("a", 2, "zwei 漢字"), ("a", 1, "eins "), ("a", 3, None), ("a", 2, "zwei 漢字"), ("b", 7, ""), ("c", 1, None), (None, 1, "x"), (None, 0, "é")]
    rows += [("d", i, f"{i} 🦉" * 50) for i in range(3_000)]
    pieces = spark.createDataFrame(rows, "work_id string, piece_no long, text string").repartition(5)
    found = whole_texts(pieces)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = {"a": "eins zwei 漢字zwei 漢字", "b": "", "c": "", None: "éx", "d": "".join(f"{i} 🦉" * 50 for i in range(3_000))}
    assert {tuple(r) for r in found.collect()} == {(w, md5(t.encode()).hexdigest(), len(t)) for w, t in whole.items()}
    assert found.schema.names == ["work_id", "digest", "n_chars"] and whole_texts(pieces.where("false")).count() == 0
