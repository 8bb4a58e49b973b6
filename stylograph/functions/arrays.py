"""Column expressions over arrays: run lengths, tree depth, and the quote switch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylograph.functions.lexicons import CLOSE_QUOTE, OPEN_QUOTE, STRAIGHT_QUOTE
from stylograph.functions.prose import QUOTE, WORD


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.

    A column that names another several times grows with every step, and the optimizer copies it
    once more below each filter; a lambda variable does neither.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(values: Column) -> Column:
    """Array of (term, n): the distinct strings of an array with their counts, by term.

    Sort, find where runs start, subtract neighbouring starts: a grouped count inside the row,
    without exploding or shuffling a single word.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        first_of_run = F.filter(
            F.sequence(F.lit(0), size - 1), lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1))
        )
        starts = F.when(size == 0, F.array().cast("array<int>")).otherwise(first_of_run)
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, run: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(at, run + 1), size) - start).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(values), runs)


def long_sum(array: Column, value) -> Column:
    """Sum of ``value(element)`` over an array, as bigint."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda total, x: total + value(x).cast("bigint"))


def token_depths(heads: Column) -> Column:
    """Hops from every token to its root. ``heads`` is 1-based; a root points to itself. A token that reaches no
    root, for its heads run in a circle or out of the array, has null.

    Pointer doubling: each round adds the depth of the ancestor reached so far and jumps to that
    ancestor's ancestor, so ceil(log2(n)) rounds suffice.
    """
    start = F.struct(
        heads.alias("up"),
        F.transform(heads, lambda head, i: F.when(head == i + 1, 0).otherwise(1)).alias("depth"),
    )
    rounds = F.ceil(F.log2(F.greatest(F.size(heads), F.lit(2)))).cast("int")

    def double(state: Column, _round: Column) -> Column:
        up, depth = state["up"], state["depth"]
        return F.struct(
            F.transform(up, lambda a: F.get(up, a - 1)).alias("up"),
            F.transform(depth, lambda d, i: d + F.get(depth, F.get(up, i) - 1)).alias("depth"),
        )

    def rooted(state: Column) -> Column:
        up = state["up"]
        return F.transform(state["depth"], lambda d, i: F.when(F.get(heads, F.get(up, i) - 1) == F.get(up, i), d))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, double, rooted)


# The quote switch of a stretch of text, for either state it may be entered in:
# in0/in1 = words inside quotes when entered outside/inside, out0/out1 = the state it ends in.
SWITCH = ("in0", "in1", "out0", "out1")


def quote_switch(body: Column, n_words: Column) -> Column:
    """The switch of one text of ``n_words``: an opening mark sets it, a closing mark clears it, a
    straight one flips it. Words are counted again only in the stretches of texts that have marks."""
    marked = body.contains(OPEN_QUOTE) | body.contains(CLOSE_QUOTE) | body.contains(STRAIGHT_QUOTE)

    def step(state: Column, x: Column) -> Column:
        def after(was: Column) -> Column:
            return F.when(x["mark"] == OPEN_QUOTE, True).when(x["mark"] == CLOSE_QUOTE, False).otherwise(~was)

        return F.struct(
            (state["in0"] + F.when(after(state["out0"]), x["n"]).otherwise(0)).alias("in0"),
            (state["in1"] + F.when(after(state["out1"]), x["n"]).otherwise(0)).alias("in1"),
            after(state["out0"]).alias("out0"),
            after(state["out1"]).alias("out1"),
        )

    marks = F.regexp_extract_all(body, F.lit(QUOTE), F.lit(0))
    stretches = F.transform(F.split(body, QUOTE), lambda part: F.regexp_count(part, F.lit(WORD)).cast("bigint"))
    swept = let(
        F.struct(marks.alias("marks"), stretches.alias("n")),
        lambda t: F.aggregate(
            F.transform(t["marks"], lambda mark, i: F.struct(mark.alias("mark"), F.get(t["n"], i + 1).alias("n"))),
            untouched(F.get(t["n"], F.lit(0))),
            step,
        ),
    )
    return F.when(marked, swept).otherwise(untouched(n_words))


def untouched(words: Column) -> Column:
    """The switch of a stretch without marks."""
    return F.struct(
        F.lit(0).cast("bigint").alias("in0"), words.alias("in1"), F.lit(False).alias("out0"), F.lit(True).alias("out1")
    )


def chained_switch(switches: Column) -> Column:
    """Compose the switches of consecutive stretches (already in order) into one."""
    def step(state: Column, x: Column) -> Column:
        def follow(out: str, total: str) -> tuple[Column, Column]:
            inside = F.when(state[out], x["in1"]).otherwise(x["in0"])
            ends = F.when(state[out], x["out1"]).otherwise(x["out0"])
            return state[total] + inside, ends

        in0, out0 = follow("out0", "in0")
        in1, out1 = follow("out1", "in1")
        return F.struct(in0.alias("in0"), in1.alias("in1"), out0.alias("out0"), out1.alias("out1"))

    return F.aggregate(switches, untouched(F.lit(0).cast("bigint")), step)
