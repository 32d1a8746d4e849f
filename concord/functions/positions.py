"""Matches of a pattern with their places, which Spark's own functions don't give.

Arrays that grow by appending are copied at every step, so nothing here appends to more than ``BLOCK`` items: running values are
found block by block, and texts are cut from blocks of ``CUT`` characters. Work then grows with the length of the text, also where
a text is one long list of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,raw:string>>"
BLOCK = 128
#: Log2 of the characters in a block of text.
CUT_BITS = 9


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, where value is computed once however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: of(v)), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """The running combination (sum, maximum) of an array of ints, each item included; ``combine`` is associative with identity ``zero``."""
    nothing = F.array().cast("array<int>")
    last = lambda items: F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(zero))
    grown = lambda items: F.aggregate(items, nothing, lambda acc, x: F.array_append(acc, combine(last(acc), x)))

    def blocked(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(items) - 1, BLOCK.bit_length() - 1)), lambda b: grown(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda own: F.flatten(F.zip_with(own, F.concat(F.array(F.lit(zero)), F.slice(grown(F.transform(own, last)), 1, F.size(own) - 1)), lambda items_, before: F.transform(items_, lambda x: combine(before, x)))))

    return let(values, lambda items: F.when(F.size(items) <= BLOCK, grown(items)).otherwise(blocked(items)))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, raw), in code points from 0: the text is cut at marks around each match, and every second part is one."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0002")), "[\u0001\u0002]", -1)

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, F.length), lambda a, b: a + b)
        of = lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(at, i - 1).alias("start"), F.get(at, i).alias("end"), F.get(parts, i).alias("raw")))
        return F.when(F.size(parts) > 1, let(ends, of)).when(parts.isNotNull(), F.array().cast(SPANS))

    return let(marked, spans)


def text_blocks(text: Column) -> Column:
    """The text in blocks of 2^CUT_BITS code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CUT_BITS}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive), from its blocks, without walking through what lies before."""
    first = F.shiftright(start, CUT_BITS)
    own = F.array_join(F.slice(blocks, first + 1, F.shiftright(end, CUT_BITS) - first + 1), "")
    return F.substring(own, start - F.shiftleft(first, CUT_BITS) + 1, end - start)


def before(text: Column, at: Column, n: int) -> Column:
    """Up to n characters that end at ``at``."""
    return F.substring(text, F.greatest(F.lit(1), at + 1 - n), F.least(F.lit(n), at))


def after(text: Column, at: Column, n: int) -> Column:
    return F.substring(text, at + 1, F.lit(n))
