"""Match positions with SQL functions only, in time near linear in a text and its matches.

SQL can list a pattern's matches and the text between them, but not where they are. Both lists
together give the places: each match starts after all gaps and matches before it. A list that grows inside
aggregate() is copied at every step, so lists are scanned in blocks: a first pass keeps the state at the start of
each block (a number), a second one lists what each block yields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
BLOCK = 64
#: Characters of a piece in which a text is kept, where many short parts of it are wanted.
PIECE = 1024


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` computed once, also where f uses it for every item of a list."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scanned(items: Column, kind: str, following: Callable[[Column, Column], Column], yielded: Callable[[Column, Column], Column], keeps: Callable[[Column, Column], Column]) -> Column:
    """What a pass over `items` yields, as array of `kind`. The state is a number, 0 at first; `following` gives the next one from the
    state and an item, `yielded` what the item adds to the list if `keeps` holds."""

    def run(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_items) / BLOCK).cast("int"), F.lit(1)) - 1)
        block = lambda i: F.slice(all_items, i * BLOCK + 1, F.lit(BLOCK))
        ahead = F.aggregate(
            numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, i: F.struct(F.aggregate(block(i), s["at"], following).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"],
        )
        step = lambda s, x: F.struct(following(s["at"], x).alias("at"), F.when(keeps(s["at"], x), F.concat(s["out"], F.array(yielded(s["at"], x)))).otherwise(s["out"]).alias("out"))
        inside = lambda start, i: F.aggregate(block(i), F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda s: s["out"])
        return let(ahead, lambda starts: F.flatten(F.transform(numbers, lambda i: inside(F.get(starts, i), i))))

    return let(items, run)


def match_spans(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost, non-overlapping matches as array of (start, end, value); code points, end exclusive.

    `pattern` must be one that Java's find() and split() read alike: no empty match. `guard` is a cheap
    condition that every text with a match meets; the others cost nothing more.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("value"))
    start = lambda at, p: at + F.length(p["gap"])
    end = lambda at, p: start(at, p) + F.coalesce(F.length(p["value"]), F.lit(0))
    span = lambda at, p: F.struct(start(at, p).alias("start"), end(at, p).alias("end"), p["value"].alias("value"))
    # the last pair holds only the text after the last match
    found = scanned(pairs, SPAN, end, span, lambda at, p: p["value"].isNotNull())
    return F.when(guard, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def places(kind: str, spans: Column) -> Column:
    """`kind:start:end` of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(cut: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text that `cut` has the pieces of; costs the pieces that it touches."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")

    def one(k: Column) -> Column:
        low, high = F.greatest(start - k * PIECE, F.lit(0)), F.least(end - k * PIECE, F.lit(PIECE))
        return F.substring(F.get(cut, k), (low + 1).cast("int"), (high - low).cast("int"))

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), one), "")).otherwise("")
