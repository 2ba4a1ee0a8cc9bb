"""Arrays and long texts as Spark columns, in time that grows with their length alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that uses it often stays small."""
    return F.transform(F.array(value), body)[0]


def _plus(a: Column, x: Column) -> Column:
    return a + x


def running(values: Column, op=_plus, zero: int = 0) -> Column:
    """What op makes of the values before each position, starting from zero (sums, if nothing is said).

    op is associative and leaves zero's partner as it is; the work is done in chunks, so long arrays stay cheap.
    """
    return let(values, lambda v: _running(v, op, zero))


def _running(values: Column, op, zero: int) -> Column:
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK))
    step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
    return let(chunks, lambda chs: _joined(chs, step, op, zero))


def _joined(chunks: Column, step, op, zero: int) -> Column:
    totals = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(zero), lambda a, x: op(a, x)))
    before = F.aggregate(totals, F.array(F.lit(zero)), step)
    # Within a chunk the value after the last one belongs to the next chunk.
    return F.flatten(
        F.transform(
            F.arrays_zip(chunks.alias("ch"), F.slice(before, F.lit(1), F.size(chunks)).alias("at")),
            lambda z: F.slice(F.aggregate(z["ch"], F.array(z["at"]), step), F.lit(1), F.size(z["ch"])),
        )
    )


_PART = 512


def parts(text: Column) -> Column:
    """The text in pieces of 512 code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points start..end of the text cut into parts, without walking through the text before them."""
    first = F.floor(start / _PART).cast("int")
    count = F.floor((F.greatest(end, start + 1) - 1) / _PART).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(parts, first + 1, count), ""), start - first * _PART + 1, end - start)
