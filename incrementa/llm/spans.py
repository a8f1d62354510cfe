"""Places of regular-expression matches, with DataFrame functions only.

A place counts code points from 0, its end exclusive. Patterns are written possessively and, where
a run of characters must start a match, anchored to the run's start or the end of the match before
(``\\G``), which gives the same leftmost non-overlapping matches in linear time and without
recursion on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
#: elements that one step of a scan appends to each other, and code points in a chunk of a text
BLOCK, CHUNK = 64, 1024
_FAR = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(values: Column, join: Callable[[Column, Column], Column], first: int, levels: int = 2) -> Column:
    """For each of an array of ints, ``join`` folded over those before it, from ``first`` on.

    An array grows by copying, so elements are taken in blocks, whose folds are scanned in the same way: the time
    is in proportion to the array up to many millions of elements.
    """

    def plain(xs: Column, start: Column) -> Column:
        begun = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, begun, lambda acc, x: F.struct(join(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def level(xs: Column, depth: int) -> Column:
        if not depth:
            return plain(xs, F.lit(first))
        cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        folds = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(first), lambda acc, x: join(acc, x).cast("int")))
        return let(let(xs, cut), lambda bs: F.flatten(F.zip_with(bs, level(folds(bs), depth - 1), plain)))

    return let(values, lambda v: F.when(F.size(v) > 0, level(v, levels)).otherwise(F.array().cast("array<int>")))


def found(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """``array<struct<start,end,value>>`` of the matches: what lies between them is what ``split`` leaves."""
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))

    def span(p: Column, at: Column) -> Column:
        return F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value"))

    spans = let(pairs, lambda v: F.zip_with(v, scanned(F.transform(v, lambda p: p["gap"] + p["size"]), lambda x, y: x + y, 0), span))
    return F.when(F.size(matches) > 0, spans).otherwise(no_spans())


def marked(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def checked(spans: Column, kind: str, valid: Callable[[str, Column], Column]) -> Column:
    """Those spans whose value is ``valid`` for ``kind``."""
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def named(spans: Column, kind: str, place: int | None = None) -> Column:
    """Spans as ``struct<start[,place],end,kind>``."""
    between = [] if place is None else [F.lit(place).alias("place")]
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), *between, s["end"].alias("end"), F.lit(kind).alias("kind")))


def clear_of(spans: Column, others: Column) -> Column:
    """Those of the sorted, disjoint ``spans`` that share no place with any of ``others`` (both with start and end)."""
    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end")))
    ends = lambda v: F.transform(v, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0))
    starts = lambda v: F.transform(v, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(_FAR))
    before = lambda v: scanned(ends(v), F.greatest, 0)  # noqa: E731  of others that begin no later
    after = lambda v: F.reverse(scanned(F.reverse(starts(v)), F.least, _FAR))

    def judged(v: Column) -> Column:
        near = F.zip_with(before(v), after(v), lambda x, y: F.struct(x.alias("before"), y.alias("after")))
        return F.transform(F.filter(F.zip_with(v, near, lambda s, n: F.struct(s["own"].alias("own"), ((s["start"] >= n["before"]) & (s["end"] <= n["after"])).alias("free"))), lambda x: x["own"] == 1), lambda x: x["free"])

    free = let(F.array_sort(F.concat(mark(others, 0), mark(spans, 1))), judged)
    chosen = lambda xs: F.transform(F.filter(F.zip_with(xs, free, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok"))), lambda x: x["ok"]), lambda x: x["s"])
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), chosen(spans)).otherwise(spans)


def merged(spans: Column, label: str) -> Column:
    """Sorted spans, those that overlap joined into one under the label of the first: ``array<struct<start,end,label>>``."""

    def joined(v: Column) -> Column:
        far = scanned(F.transform(v, lambda s: s["end"]), F.greatest, -1)
        heads = lambda w: F.filter(F.zip_with(v, w, lambda s, e: F.struct(s["start"].alias("start"), e.alias("before"), s[label].alias("label"))), lambda x: x["start"] >= x["before"])
        last = F.array_max(F.transform(v, lambda s: s["end"]))
        # a head's run ends where the ends before the next head reach
        return let(let(far, heads), lambda h: F.zip_with(h, F.concat(F.transform(F.slice(h, F.lit(2), F.size(h)), lambda x: x["before"]), F.array(last)), lambda x, e: F.struct(x["start"].alias("start"), e.alias("end"), x["label"].alias("label"))))

    return let(spans, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, k: Column) -> Column:
        d = F.substring(number, F.length(number) - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def replaced(text: Column, spans: Column, label: str) -> Column:
    """``text`` with what the sorted ``spans`` cover as ``[KIND]``; ``label`` names the field that tells the kind.

    A string's place is found by counting from its start, so the text is cut into chunks first.
    """

    def between(chunks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
        return F.when(end > begin, F.substring(F.array_join(some, ""), (begin - first * CHUNK + 1).cast("int"), (end - begin).cast("int"))).otherwise("")

    def pieces(chunks: Column, v: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(v, lambda s: s["end"]))
        starts = F.concat(F.transform(v, lambda s: s["start"]), F.array(F.length(text)))
        marks = F.concat(F.transform(v, lambda s: F.concat(F.lit("["), F.upper(s["label"]), F.lit("]"))), F.array(F.lit("")))
        kept = F.zip_with(ends, starts, lambda b, e: between(chunks, b, e))
        return F.array_join(F.zip_with(kept, marks, lambda k, m: F.concat(k, m)), "")

    chunks = found(text, f"(?s).{{1,{CHUNK}}}+")
    return F.when(F.size(spans) > 0, let(chunks, lambda c: let(merged(spans, label), lambda v: pieces(c, v)))).otherwise(text)
