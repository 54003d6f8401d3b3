"""Native regex spans: the positions of all matches of a pattern, with built-in functions only.

Spark returns matches without positions. Splitting by the same pattern gives the texts between the matches, found by the
same left-to-right search; lengths of both, summed up, are the positions, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Numbers that are added up in one fold.
FOLD = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(numbers: Column) -> Column:
    """Running sums; a fold copies what it has for each number."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"))
    return F.aggregate(numbers, state, step, lambda acc: acc["out"])


def running(numbers: Column, depth: int = 3) -> Column:
    """Running sums of an array of integers, by stretches of FOLD ** depth numbers, and those by shorter ones in the same way.

    Work is in proportion to the array up to FOLD ** (depth + 1) numbers; any array is summed.
    """
    if not depth:
        return _fold(numbers)
    size = FOLD**depth

    def placed(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), _fold(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, o: F.transform(p, lambda v: v + o)))

    def cut(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(x), F.lit(size)), lambda i: running(F.slice(x, i, size), depth - 1))
        return F.when(F.size(x) > size, let(parts, placed)).otherwise(running(x, depth - 1))

    return let(numbers, cut)


def matches(text: Column, pattern: str, kind: str, ok: Callable[[Column], Column], probe: str | None = None) -> Column:
    """Array of struct<start, kind, end, value>: leftmost non-overlapping matches that pass ``ok``, in order.

    ``text`` must not be null. ``probe`` is a pattern that every text with a match contains; it is searched first, so
    that most texts are passed over once. Work is in proportion to the text, however many matches it has.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
        # a match ends after all matches and gaps up to it
        ends = running(F.zip_with(found, between, lambda m, g: g + F.length(m)))
        one = lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value"))
        return F.filter(F.zip_with(found, ends, one), lambda s: ok(s["value"]))

    empty = F.array().cast("array<struct<start:int,kind:string,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.regexp_like(text, F.lit(probe or pattern)), let(found, placed)).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an ordered array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans sorted by start, then by their kind's place in ``kinds``, then end."""
    names = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
