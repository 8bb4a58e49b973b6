"""Works in many rows: a text cut anywhere, cleaned, counted and numbered as if it were whole.

A long text is rows ``(work_id, piece_no, text)`` whose texts, joined in order, are the work. Pieces may be cut at any
character; ``moved_cuts`` shifts each cut to the next place where a step does not mind it, so every step works on a piece
by itself, knowing two things about the rest:

* what is open where the piece begins (a heading, a link's brackets, a pair of stars, a sentence), and
* whether what is open where it ends is closed later, since markup that is never closed stays as it is.

Both follow from a summary of each piece, some hundred bytes: what the piece leaves open for each thing it may begin in, and what its first decisive mark says to
something opened before. Summaries are composed in order, texts never meet. A rule is then applied by its own pattern to the piece between a
text that stands for what was opened and one that stands for what closes it, so pieces and whole texts share one definition.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograph.functions.arrays import let, long_sum
from stylograph.functions.prose import BLANK, BLANK_CHARS, PARAGRAPH_BREAK, is_blank, sentence_parts, sentences, token_texts
from stylograph.operators.cleaning import MARKUP
from stylograph.session import Kept, checkpointed, lookup, scattered, small_texts

# Characters of a piece, about. It changes no result.
PIECE_CHARS = 500_000
# Characters of a row that short pieces are gathered into, and pieces whose numbers are sent to the texts. They change no result.
ROW_CHARS = 50_000
FEW_PIECES = 300_000

# Where a cut may lie. Between two letters or digits no markup begins or ends. Between a letter or digit and what is
# neither part of a word nor of a clitic, a terminator, a closing mark or a dash, no token and no sentence ends or begins inside.
INSIDE_WORD = r"[\p{L}\p{N}](?=[\p{L}\p{N}])"
AFTER_TOKEN = r"[\p{L}\p{N}](?=[^\p{L}\p{N}\p{M}'’.!?…\"”)\-])"

_RULES = {name: (pattern, replacement) for name, _, pattern, replacement in MARKUP}

# Noncharacters, which no text should hold: where a piece begins and ends inside the text a rule is applied to, what took a
# match's place, and a link's text in an earlier piece.
BEGIN, END, MATCHED, EARLIER = (chr(code) for code in range(0xFDD0, 0xFDD4))


def in_pieces(works: DataFrame, chars: int = PIECE_CHARS) -> DataFrame:
    """``works(work_id, text)`` cut at every ``chars`` characters; an empty text is one empty piece, a null one stays null."""
    parts = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    rows = works.select("work_id", F.posexplode_outer(parts).alias("piece_no", "text"))
    return rows.select("work_id", F.coalesce("piece_no", F.lit(0)).cast("long").alias("piece_no"), "text")


def gathered(pieces: DataFrame, chars: int = ROW_CHARS) -> DataFrame:
    """The same texts in rows of about ``chars`` characters: short neighbours are joined, so that what is known of the pieces of a corpus
    is few rows, which are sent to the texts. Only lengths are put in order over a work."""
    before = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    places = pieces.select("work_id", "piece_no", F.length("text").alias("n"))
    so_far = places.groupBy("work_id", "piece_no").agg(F.sum("n").alias("n")).select("work_id", "piece_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("so_far"))
    placed = pieces.join(lookup(checkpointed(so_far)), ["work_id", "piece_no"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"])
    rows = placed.groupBy("work_id", F.floor(F.col("so_far") / chars).alias("row")).agg(F.min("piece_no").alias("piece_no"), F.array_join(in_order, "").alias("text"))
    return rows.select("work_id", "piece_no", "text")


def moved_cuts(pieces: DataFrame, place: str = INSIDE_WORD) -> DataFrame:
    """The same texts, each cut moved on to the next character that ``place`` matches. What lies before it goes to the piece
    before; a piece without such a character goes there as a whole, so a row is as long as the longest stretch without one."""
    return _moved_cuts(pieces, place, checkpointed)


def _moved_cuts(pieces: DataFrame, place: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    head = F.regexp_extract("text", rf"(?s)\A(.*?(?:{place}))", 1)
    firsts = checkpointed(pieces.groupBy("work_id").agg(F.min("piece_no").alias("first")))
    told = keep(
        pieces.join(lookup(firsts), "work_id")
        .select("work_id", "piece_no", "text", F.when(F.col("piece_no") == F.col("first"), "").otherwise(head).alias("head"), "first")
        .select(
            "work_id", "piece_no",
            ((F.col("piece_no") == F.col("first")) | (F.col("head") != "")).alias("stays"),
            F.when((F.col("piece_no") == F.col("first")) | (F.col("head") != ""), F.col("head")).otherwise(F.col("text")).alias("head"),
            F.substring("text", F.length("head") + 1, F.length("text")).alias("body"),
        )
    )
    before = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    owners = told.select("work_id", "piece_no", F.last(F.when(F.col("stays"), F.col("piece_no")), ignorenulls=True).over(before).alias("owner"))
    heads = told.where(F.col("head") != "").select("work_id", "piece_no", "head").join(owners, ["work_id", "piece_no"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "head"))), lambda h: h["head"])
    tails = checkpointed(heads.groupBy("work_id", F.col("owner").alias("piece_no")).agg(F.array_join(in_order, "").alias("tail")))
    return (
        told.where("stays").join(small_texts(tails, "tail", FEW_PIECES), ["work_id", "piece_no"], "left")
        .select("work_id", "piece_no", F.concat("body", F.coalesce("tail", F.lit(""))).alias("text"))
    )


# --- markup that may run over a cut -------------------------------------------------------------


@dataclass(frozen=True)
class Open:
    """Something a piece may begin or end in: a text that stands for it before a piece, what it looks like at the end of a piece, a
    text that closes it, and what the first decisive mark of later text must be like: ``mark`` any such mark, ``closing`` one that
    closes, ``awaits`` one that closes if the next state's does too."""

    stands: str
    tail: str
    closes: str
    mark: str
    closing: str
    awaits: str | None = None


@dataclass(frozen=True)
class Span:
    name: str
    needs: str  # characters without which nothing matches
    states: tuple[Open, ...]
    takes_words: bool = False  # what it deletes may hold a cut
    linear: tuple[str, str] | None = None  # the rule as a pattern and replacement that pass over a text once

    @property
    def pattern(self) -> str:
        return _RULES[self.name][0]

    @property
    def replacement(self) -> str:
        return _RULES[self.name][1]


def _pair(name: str, mark: str, stop: str = "") -> Span:
    """Text between two equal marks, without that mark or ``stop`` in it."""
    one, many = re.escape(mark[0]), re.escape(mark)
    state = Open(mark + "x", rf"{many}[^{one}{stop}]+\z", mark, f"[{one}{stop}]", rf"\A[^{one}{stop}]*{many}")
    return Span(name, mark[0], (state,))


# Where an opening bracket's text is no link, none that opens before the same closing bracket is: ``linear`` passes over all of them.
SPANS = (
    Span("image", "![]()", (
        Open("![x", r"!\[[^\]]*\z", "](x)", r"\]", r"\A[^\]]*\]\([^)]*\)", r"\A[^\]]*\]\([^)]*\z"),
        Open("![x](x", r"!\[[^\]]*\]\([^)]*\z", ")", r"\)", r"\)"),
    ), takes_words=True, linear=(r"!\[[^\]]*+\]\([^)]*+\)|(!\[[^\]]*+)", "$1")),
    Span("link", "[]()", (
        Open("[x", r"\[[^\]]+\z", "](x)", r"\]", r"\A[^\]]*\]\([^)]+\)", r"\A[^\]]*\]\([^)]+\z"),
        Open(f"[{EARLIER}](x", r"\[[^\]]+\]\([^)]+\z", ")", r"\)", r"\)"),
    ), takes_words=True, linear=(r"\[([^\]]++)\]\([^)]++\)|(\[[^\]]++)", "$1$2")),
    _pair("bold_star", "**"), _pair("bold_underscore", "__"), _pair("italic_star", "*", r"\n"), _pair("italic_underscore", "_", r"\n"),
    _pair("code", "`"),
)


def _left_open(text: Column, span: Span) -> Column:
    """What a text leaves open after its last match: the number of the state, 0 for nothing."""
    rest = F.substring_index(F.regexp_replace(text, span.pattern, MATCHED), MATCHED, -1)

    def state(rest: Column) -> Column:
        out = F
        for number in range(len(span.states), 0, -1):
            out = out.when(rest.rlike(span.states[number - 1].tail), number)
        return out.otherwise(0)

    return let(rest, state)


def _says(text: Column, state: Open) -> Column:
    """What a text says to something open before it: 1 closes it, 0 shows that nothing closes it, 2 as the next state's mark
    says, null says nothing."""
    says = F.when(~text.rlike(state.mark), None).when(text.rlike(state.closing), 1)
    if state.awaits:
        says = says.when(text.rlike(state.awaits), 2)
    return says.otherwise(0)


def resolve(exits: Sequence[Sequence[int]], says: Sequence[Sequence[int | None]]) -> list[tuple[int, int]]:
    """For each piece of a work, in order: the state it begins in, and the state whose closing comes after it (0: none).

    ``exits[i][s]`` is what piece i leaves open when begun in state s, ``says[i][s - 1]`` what it says to state s."""
    n, k = len(exits), len(says[0]) if says else 0
    closed = [[False] * (k + 1) for _ in range(n + 1)]  # after piece i - 1, is state s closed later?
    for i in range(n - 1, 0, -1):
        for s in range(k, 0, -1):
            word = says[i][s - 1]
            later = closed[i + 1]
            closed[i][s] = later[s] if word is None else later[s + 1] if word == 2 else word == 1
    out, state = [], 0
    for i in range(n):
        begins = state
        state = exits[i][state]
        ends = closed[i + 1][state] if state else False
        if state == k > 1 and not ends:
            state = 0  # without its last mark nothing later matches either
        out.append((begins, state if ends else 0))
    return out


def _bones(text: Column, span: Span) -> Column:
    """A text of which the span's patterns say the same, most often a very short one: what is neither one of its characters nor a
    line end is shortened to one character."""
    return F.regexp_replace(text, rf"[^\n{re.escape(span.needs)}]+", "x")


def _apply(pieces: DataFrame, span: Span) -> DataFrame:
    text = F.col("text")

    def told(bones: Column) -> Column:
        exits = F.array(*(_left_open(F.concat(F.lit(start), bones), span) for start in ("", *(s.stands for s in span.states))))
        return F.struct(exits.alias("exits"), F.array(*(_says(bones, s) for s in span.states)).alias("says"))

    summary = pieces.select("work_id", "piece_no", let(_bones(text, span), told).alias("told")).select("work_id", "piece_no", "told.*")

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece_no", ignore_index=True)
        says = [[None if pd.isna(x) else int(x) for x in row] for row in frame["says"]]
        found = resolve([list(map(int, row)) for row in frame["exits"]], says)
        return frame[["work_id", "piece_no"]].assign(begins=[b for b, _ in found], ends=[e for _, e in found])

    states = checkpointed(summary.groupBy("work_id").applyInPandas(chained, "work_id string, piece_no long, begins int, ends int"))

    def chosen(column: str, texts: Sequence[str]) -> Column:
        out = F
        for number, value in enumerate(texts, 1):
            out = out.when(F.col(column) == number, F.lit(value))
        return out.otherwise(F.lit(""))

    framed = F.concat(
        chosen("begins", [s.stands for s in span.states]), F.lit(BEGIN), text, F.lit(END), chosen("ends", [s.closes for s in span.states])
    )
    done = F.regexp_replace(framed, *(span.linear or (span.pattern, span.replacement)))
    done = F.regexp_replace(done, rf"\A(?:[!\[\]()*_`x]{{0,6}}{BEGIN}|{EARLIER})", "")
    done = F.regexp_replace(done, rf"{END}[\]()*_`x]{{0,4}}\z", "")
    marked = text.contains(span.needs[0]) | (F.col("begins") > 0)
    return pieces.join(lookup(states, FEW_PIECES), ["work_id", "piece_no"]).select("work_id", "piece_no", F.when(marked, done).otherwise(text).alias("text"))


# --- whole lines ----------------------------------------------------------------------------------

LINE_RULES = ("star_rule", "dash_rule", "underscore_rule", "quote_marker")
CLOSING_RULE = "\n---\n"


def _without_front_matter(pieces: DataFrame) -> DataFrame:
    """The block at the start of a work goes, over as many pieces as it takes, if it ends at all."""
    pattern, _ = _RULES["front_matter"]
    text = F.col("text")
    begun = pieces.groupBy("work_id").agg(
        F.min_by(F.when(text.rlike(pattern), 2).when(text.startswith("---\n"), 1).otherwise(0), "piece_no").alias("kind"), F.min("piece_no").alias("first")
    ).where("kind > 0")
    later = pieces.where(text.contains(CLOSING_RULE)).join(begun.where("kind = 1"), "work_id").where(F.col("piece_no") > F.col("first"))
    ends = begun.where("kind = 2").select("work_id", "first", F.col("first").alias("last")).unionByName(
        later.groupBy("work_id", "first").agg(F.min("piece_no").alias("last"))
    )
    at = F.col("piece_no")
    left = (
        F.when(F.col("last").isNull() | (at > F.col("last")), text)
        .when(at < F.col("last"), "")
        .when(at == F.col("first"), F.regexp_replace(text, pattern, ""))
        .otherwise(F.regexp_replace(text, r"\A(?s:.*?)\n---\n", ""))
    )
    return pieces.join(lookup(checkpointed(ends)), "work_id", "left").select("work_id", "piece_no", left.alias("text"))


def _without_marked_lines(pieces: DataFrame) -> DataFrame:
    """Headings, also those that began in an earlier piece, and the rules that lie within a piece since their lines hold no word."""
    text = F.col("text")
    leaves = F.when(text.rlike(r"(?:\A|\n)[ \t]*#{1,6}[ \t][^\n]*\z"), True).when(text.contains("\n"), False)
    before = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    summary = pieces.select("work_id", "piece_no", leaves.alias("leaves"))
    begun = summary.select("work_id", "piece_no", F.coalesce(F.last("leaves", ignorenulls=True).over(before), F.lit(False)).alias("in_heading"))
    rest = F.when(F.col("in_heading"), F.regexp_replace(text, r"\A[^\n]*", "")).otherwise(text)
    for name in ("heading", *LINE_RULES):
        rest = F.regexp_replace(rest, *_RULES[name])
    return pieces.join(lookup(checkpointed(begun), FEW_PIECES), ["work_id", "piece_no"]).select("work_id", "piece_no", rest.alias("text"))


def _trimmed(pieces: DataFrame) -> DataFrame:
    """Blanks at both ends of a work go. A work that holds nothing else keeps one empty piece."""
    filled = F.when(~is_blank(F.col("text")), F.col("piece_no"))
    ends = pieces.groupBy("work_id").agg(F.min(filled).alias("from"), F.max(filled).alias("to"), F.min("piece_no").alias("first"))
    at, text = F.col("piece_no"), F.col("text")
    text = F.when(at == F.col("from"), F.ltrim(text, F.lit(BLANK_CHARS))).otherwise(text)
    text = F.when(at == F.col("to"), F.rtrim(text, F.lit(BLANK_CHARS))).otherwise(text)
    placed = pieces.join(lookup(checkpointed(ends)), "work_id").where(at.between(F.col("from"), F.col("to")) | (F.col("from").isNull() & (at == F.col("first"))))
    return placed.select("work_id", "piece_no", F.when(F.col("from").isNotNull(), text).otherwise("").alias("text"))


def cleaned_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces whose texts, joined, are ``clean_markdown`` of the whole text, for pieces cut at any character.

    A rule none of whose characters occur costs nothing. Each pass over the texts is written, so a lost executor costs its share of one;
    what the pass before wrote goes."""
    kept = Kept(pieces.sparkSession)

    def step(rows: DataFrame) -> DataFrame:
        rows = kept.keep(rows)
        kept.forget(newest=1)
        return rows

    pieces = step(gathered(pieces.select("work_id", "piece_no", F.coalesce("text", F.lit("")).alias("text"))))
    pieces = step(_moved_cuts(pieces, INSIDE_WORD, kept.keep).withColumn("text", F.regexp_replace("text", *_RULES["line_ends"])))
    marks = sorted({c for span in SPANS for c in span.needs})
    held = pieces.agg(*(F.bool_or(F.col("text").contains(c)).alias(f"has{n}") for n, c in enumerate(marks))).first()
    held = {c for n, c in enumerate(marks) if held[n]}
    pieces = step(_without_marked_lines(step(_without_front_matter(pieces))))
    shifted = False  # the cuts that follow a deletion may touch markup
    for span in SPANS:
        if not held.issuperset(span.needs):
            continue
        if shifted:
            pieces, shifted = step(_moved_cuts(pieces, INSIDE_WORD, kept.keep)), False
        pieces = step(_apply(pieces, span))
        shifted = span.takes_words
    pieces = step(_moved_cuts(pieces, INSIDE_WORD, kept.keep).withColumn("text", F.regexp_replace("text", *_RULES["blank_lines"])))
    return _trimmed(pieces)


# --- sentences over cuts --------------------------------------------------------------------------


def _parts(sizes: DataFrame) -> DataFrame:
    """The sentences that touch a cut. ``sizes(work_id, piece_no, sizes)`` holds the tokens or words of each part between sentence
    ends; result: work_id, piece_no, part (0 the piece's first, else its last), run, n. Parts of one sentence share a run, numbered from 0."""
    ended = (F.size("sizes") > 1).cast("int")
    so_far = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = sizes.select("work_id", "piece_no", "sizes", ended.alias("ended"), F.sum(ended).over(so_far).alias("run"))
    first = F.struct(F.lit(0).alias("part"), (F.col("run") - F.col("ended")).alias("run"), F.get("sizes", F.lit(0)).alias("n"))
    last = F.struct(F.lit(1).alias("part"), F.col("run").alias("run"), F.element_at("sizes", -1).alias("n"))
    both = F.when(F.col("ended") == 1, F.array(first, last)).otherwise(F.array(first))
    return numbered.select("work_id", "piece_no", F.explode(both).alias("p")).select("work_id", "piece_no", "p.*")


def _inner(sizes: Column) -> Column:
    """The sizes of the sentences that lie within a piece."""
    return F.when(F.size(sizes) > 2, F.slice(sizes, 2, F.greatest(F.size(sizes) - 2, F.lit(1)))).otherwise(F.array().cast("array<struct<n: bigint, filled: boolean>>"))


def part_sizes(text: Column, pattern: str | None = None) -> Column:
    """Array of (n, filled) per part between sentence ends: matches of ``pattern``, or tokens, and whether it holds anything."""

    def size(part: Column) -> Column:
        n = F.regexp_count(part, F.lit(pattern)) if pattern else F.size(token_texts(part))
        return F.struct(n.cast("long").alias("n"), (~is_blank(part)).alias("filled"))

    return F.transform(sentence_parts(text), size)


def sentence_sums(sizes: DataFrame) -> DataFrame:
    """n_sentences and sum_sq_sentence_words per work from ``sizes(work_id, piece_no, sizes)`` (see ``part_sizes``)."""
    inner = sizes.select("work_id", _inner(F.col("sizes")).alias("inner")).select(
        "work_id", F.size(F.filter("inner", lambda s: s["filled"])).cast("long").alias("n"), long_sum(F.col("inner"), lambda s: s["n"] * s["n"]).alias("sq")
    )
    whole = _parts(sizes).groupBy("work_id", "run").agg(F.sum("n.n").alias("words"), F.bool_or("n.filled").alias("filled"))
    runs = whole.select("work_id", F.col("filled").cast("long").alias("n"), (F.col("words") * F.col("words")).alias("sq"))
    return inner.unionByName(runs).groupBy("work_id").agg(F.sum("n").alias("n_sentences"), F.sum("sq").alias("sum_sq_sentence_words"))


def _tokens_by_part(text: Column) -> Column:
    """The tokens of each part of a text between sentence ends; parts without any are kept at both ends only."""

    def kept(parts: Column) -> Column:
        inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: F.size(p) > 0)
        return F.when(F.size(parts) > 2, F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1))).otherwise(parts)

    return let(F.transform(sentence_parts(text), token_texts), kept)


def numbered_tokens(pieces: DataFrame) -> DataFrame:
    """Flat tokens of clean pieces: work_id, sent_no, tok_no, sent_tok_no, text, numbered as in the whole text.

    Only sizes are summed over a work, in windows of one small row per piece; the tokens stay in their pieces."""
    kept = Kept(pieces.sparkSession)
    pieces = scattered(_moved_cuts(pieces, AFTER_TOKEN, kept.keep), "work_id", "piece_no")
    split = kept.keep(pieces.select("work_id", "piece_no", _tokens_by_part(F.col("text")).alias("parts")))
    kept.forget(newest=1)
    size = F.transform("parts", lambda p: F.struct(F.size(p).cast("long").alias("n"), (F.size(p) > 0).alias("filled")))
    sizes = checkpointed(split.select("work_id", "piece_no", size.alias("sizes")))

    order = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    tokens = sizes.select("work_id", "piece_no", F.coalesce(F.sum(long_sum(F.col("sizes"), lambda s: s["n"])).over(order), F.lit(0)).alias("tok_offset"))
    in_run = Window.partitionBy("work_id", "run").orderBy("piece_no", F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpointed(_parts(sizes).select(
        "work_id", "piece_no", "part", "run", F.col("n.filled").alias("filled"), F.coalesce(F.sum("n.n").over(in_run), F.lit(0)).alias("before")
    ))
    inner = parts.where("part = 1").join(sizes, ["work_id", "piece_no"]).select("work_id", "run", (F.size("sizes") - 2).alias("inner"))
    runs = parts.groupBy("work_id", "run").agg(F.max(F.col("filled").cast("int")).alias("filled")).join(inner, ["work_id", "run"], "left")
    over_runs = Window.partitionBy("work_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    # sent_no counts the sentences up to a run's own, those that lie before it in the piece where it begins among them.
    runs = runs.select("work_id", "run", "filled", F.coalesce("inner", F.lit(0)).alias("inner"))
    runs = runs.withColumn("sent_no", F.sum(F.col("filled") + F.col("inner")).over(over_runs))
    placed = parts.drop("filled").join(runs, ["work_id", "run"])
    known = placed.groupBy("work_id", "piece_no").agg(
        F.max(F.when(F.col("part") == 0, F.struct("sent_no", "before"))).alias("first"),
        F.max(F.when(F.col("part") == 1, F.struct("sent_no", "inner", "filled"))).alias("last"),
    ).join(tokens, ["work_id", "piece_no"])

    def numbered(parts: Column) -> Column:
        within = F.col("last.sent_no") - F.col("last.filled") - F.col("last.inner")

        def of(part: Column, i: Column) -> Column:
            sent = F.when(i == 0, F.col("first.sent_no")).when(i == F.size(parts) - 1, F.col("last.sent_no")).otherwise(within + i)
            offset = F.when(i == 0, F.col("first.before")).otherwise(0)
            return F.transform(part, lambda t, n: F.struct(sent.cast("int").alias("sent_no"), (n + 1 + offset).cast("int").alias("sent_tok_no"), t.alias("text")))

        return F.flatten(F.transform(parts, of))

    rows = split.join(lookup(checkpointed(known), FEW_PIECES), ["work_id", "piece_no"]).select("work_id", "tok_offset", F.posexplode(numbered(F.col("parts"))).alias("position", "t"))
    return rows.select("work_id", "t.sent_no", (F.col("tok_offset") + F.col("position") + 1).cast("long").alias("tok_no"), "t.sent_tok_no", "t.text")


# A cut after the blanks that end a sentence.
AFTER_SENTENCE = r"[.!?…][\"”’)]*" + BLANK + "+(?!" + BLANK + ")"


def numbered_sentences(pieces: DataFrame) -> DataFrame:
    """Sentences of clean pieces: work_id, sent_no, text. Cuts are moved to sentence ends, so a row is as long as the longest
    sentence at least."""
    pieces = scattered(moved_cuts(pieces, AFTER_SENTENCE), "work_id", "piece_no")
    split = checkpointed(pieces.select("work_id", "piece_no", sentences(F.col("text")).alias("found")))
    before = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.select("work_id", "piece_no", F.size("found").alias("n")).select(
        "work_id", "piece_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    rows = split.join(offsets, ["work_id", "piece_no"]).select("work_id", "offset", F.posexplode("found").alias("position", "text"))
    return rows.select("work_id", (F.col("offset") + F.col("position") + 1).cast("int").alias("sent_no"), "text")


# --- chunks over many rows ------------------------------------------------------------------------

# A cut after a blank line that is followed by text in the same piece.
AFTER_PARAGRAPH = r"\n" + BLANK + r"*\n(?=(?:(?!\n)" + BLANK + ")*(?!" + BLANK + r")(?s:.))"


def paragraph_arrays(pieces: DataFrame) -> DataFrame:
    """work_id, piece_no and ``paragraphs``, those that begin in the piece; no paragraph lies in two pieces."""
    pieces = checkpointed(moved_cuts(pieces, AFTER_PARAGRAPH))
    last = pieces.groupBy("work_id").agg(F.max("piece_no").alias("last"))
    parts = F.split("text", PARAGRAPH_BREAK)
    # Every piece but the last ends with a break.
    whole = let(parts, lambda p: F.when(F.col("piece_no") < F.col("last"), F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return pieces.join(last, "work_id").select("work_id", "piece_no", whole.alias("paragraphs"))


def jumps(lengths: Sequence[int], max_chars: int, glue: int) -> list[int | None]:
    """For a chunk that begins at each paragraph: where the next one begins, None if not in this piece."""
    ends = list(accumulate(n + glue for n in lengths))  # after each paragraph and its glue
    out: list[int | None] = []
    for at in range(len(lengths)):
        before = ends[at - 1] if at else 0
        nxt = max(bisect_right(ends, before + max_chars + glue, at), at + 1)
        out.append(nxt if nxt < len(lengths) else None)
    return out


def chunk_summary(lengths: Sequence[int], max_chars: int, glue: int) -> tuple[list[int], list[int], int]:
    """What a piece does to the chunk that is open where it begins, of any size: ``limits[j]``, the size up to which the chunk
    takes all paragraphs up to j in; ``sizes[j]``, the size of the chunk open at the end if one begins at j; and the size of all."""
    follow, total = jumps(lengths, max_chars, glue), sum(lengths) + glue * len(lengths)
    ends = list(accumulate(n + glue for n in lengths))
    sizes = [0] * len(lengths)
    for at in range(len(lengths) - 1, -1, -1):
        sizes[at] = total - (ends[at - 1] if at else 0) if follow[at] is None else sizes[follow[at]]
    limits = [max_chars + glue - end for end in ends]
    reached = next((j + 1 for j, limit in enumerate(limits) if limit < 0), len(limits))  # no chunk takes more in
    return limits[:reached], sizes[:reached], total


def entered(limits: Sequence[int], size: int) -> int | None:
    """The paragraph at which a chunk of ``size`` that is open before the piece ends, None if it takes the piece in."""
    return next((j for j, limit in enumerate(limits) if size > limit), None)


def chunk_starts(lengths: Sequence[int], size: int | None, max_chars: int, glue: int) -> list[int]:
    """The paragraphs at which chunks begin, given the size of the chunk that is open before the piece, None at the start of a work."""
    if not lengths:
        return []
    limits, _, _ = chunk_summary(lengths, max_chars, glue)
    at = 0 if size is None else entered(limits, size)
    follow, out = jumps(lengths, max_chars, glue), []
    while at is not None:
        out.append(at)
        at = follow[at]
    return out


def chunks_of_pieces(pieces: DataFrame, max_chars: int, glue: str) -> DataFrame:
    """Paragraphs packed greedily into chunks, as ``pieces.chunks`` packs a whole text: work_id, chunk_no, text.

    A piece is summarised by the paragraphs at which a chunk open before it may end, and what is then open at its end (jump
    pointers over its paragraphs, as far as one chunk reaches); summaries are composed in order, so a work is never in one row."""
    found = checkpointed(paragraph_arrays(pieces))
    lengths = found.select("work_id", "piece_no", F.transform("paragraphs", lambda p: F.length(p).cast("long")).alias("lengths"))

    def summarised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [chunk_summary(list(x), max_chars, len(glue)) for x in frame["lengths"]]
            yield frame[["work_id", "piece_no"]].assign(limits=[r[0] for r in rows], sizes=[r[1] for r in rows], total=[r[2] for r in rows])

    summary = lengths.mapInPandas(summarised, "work_id string, piece_no long, limits array<long>, sizes array<long>, total long")

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece_no", ignore_index=True)
        size, sizes = None, []
        for limits, ends, total in zip(frame["limits"], frame["sizes"], frame["total"]):
            sizes.append(size)
            if len(limits):
                at = 0 if size is None else entered(limits, size)
                size = size + total if at is None else int(ends[at])
        return frame[["work_id", "piece_no"]].assign(size=pd.array(sizes, dtype="Int64"))

    sizes = summary.groupBy("work_id").applyInPandas(composed, "work_id string, piece_no long, size long")

    def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts = [
                chunk_starts(list(x), None if pd.isna(size) else int(size), max_chars, len(glue)) for x, size in zip(frame["lengths"], frame["size"])
            ]
            yield frame[["work_id", "piece_no"]].assign(starts=starts)

    starts = lengths.join(sizes, ["work_id", "piece_no"]).mapInPandas(begun, "work_id string, piece_no long, starts array<int>")
    before = Window.partitionBy("work_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(starts.select("*", F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)).alias("base")))
    opens = F.coalesce(F.get("starts", F.lit(0)) == 0, F.lit(False))
    firsts = F.when(opens, F.col("starts")).otherwise(F.concat(F.array(F.lit(0)), "starts"))
    # Parts of chunks in each piece; the first continues the chunk open before it unless one begins there.
    parts = F.transform("firsts", lambda at, n: F.struct(
        (F.col("base") + n - F.when(F.col("opens"), 0).otherwise(1)).cast("int").alias("chunk_no"),
        F.array_join(F.slice("paragraphs", at + 1, F.coalesce(F.get("firsts", n + 1), F.size("paragraphs")) - at), glue).alias("text"),
    ))
    rows = found.where(F.size("paragraphs") > 0).join(starts, ["work_id", "piece_no"])
    rows = rows.withColumn("opens", opens).withColumn("firsts", firsts).select("work_id", "piece_no", F.explode(parts).alias("p"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "p.text"))), lambda p: p["text"])
    return rows.groupBy("work_id", F.col("p.chunk_no").alias("chunk_no")).agg(F.array_join(in_order, glue).alias("text"))
