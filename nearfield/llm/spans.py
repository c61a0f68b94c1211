"""Places of pattern matches in texts, in column functions alone and in time linear in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of a block: running sums are made in blocks, then over blocks, as appending to one array costs the square of its length.
BLOCK = 256


def let(value: Column, make) -> Column:
    """make(value), with the value computed once: inside a lambda an expression is computed anew for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: make(v)), 1)


def _type(fields) -> str:
    return "array<struct<start:int,end:int," + ",".join(f"{f}:string" for f in fields) + ">>"


def matches(text: Column, pattern: str, *, group: int = 0, has: Column | None = None, context: int = 0) -> Column:
    """array<struct<start, end, value>>: the leftmost matches that don't overlap, in code points, ends exclusive, with the value of a group. The pattern never matches
    nothing; `has` tells where a match is possible at all. With a context, also `before`, as many characters at most since the match before, and `after`, the next character;
    a match that touches the one before it or after it has a 0 there."""
    fields = ("value", "before", "after") if context else ("value",)

    def zipped(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        n = F.size(found)
        pieces = F.split(text, pattern, -1)

        def made(pieces: Column) -> Column:
            beside = ()
            if context:
                before = F.transform(F.slice(pieces, 1, n), lambda g, i: F.when((g == "") & (i > 0), "0").otherwise(F.right(g, F.lit(context))))
                after = F.transform(F.slice(pieces, 2, n), lambda g, i: F.when((g == "") & (i < n - 1), "0").otherwise(F.left(g, F.lit(1))))
                beside = (before.alias("before"), after.alias("after"))
            gaps = F.transform(F.slice(pieces, 1, n), lambda g: F.char_length(g))
            return F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda f: F.char_length(f)).alias("long"), values.alias("value"), *beside)

        return let(pieces, made) if context else made(pieces)

    some = F.rlike(text, F.lit(pattern)) if has is None else has & F.rlike(text, F.lit(pattern))
    items = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)
    return F.when(some, let(items, lambda x: _placed(x, fields))).otherwise(F.array().cast(_type(fields)))


def in_blocks(items: Column) -> Column:
    """The items in arrays of BLOCK, in order."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _placed(items: Column, fields) -> Column:
    """items: array<struct<gap, long, *fields>>, each gap the characters since the last match."""
    kind = _type(fields)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["long"]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), *(x[f].alias(f) for f in fields))).alias("out"))

    inner = F.transform(in_blocks(items), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<by:int,out:" + kind + ">>").alias("out"))
    moved = F.aggregate(inner, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("by"), x["out"].alias("out"))).alias("out")))
    shift = lambda b: F.transform(b["out"], lambda x: F.struct((x["start"] + b["by"]).alias("start"), (x["end"] + b["by"]).alias("end"), *(x[f].alias(f) for f in fields)))
    return F.flatten(F.transform(moved["out"], shift))


def touched(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others, an array of disjoint spans in order: by halving, as the first of them that ends behind the span's start decides."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        behind = F.get(others, middle)["end"] > span["start"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & ~behind, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & behind, middle).otherwise(acc["high"]).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + F.lit(1))).cast("int"))
    first = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(others).alias("high")), halve)["low"]
    return (F.size(others) > 0) & F.coalesce(F.get(others, first)["start"] < span["end"], F.lit(False))
