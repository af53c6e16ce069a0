"""Column expressions over matches of a pattern and over arrays; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperfold.functions.text import let

STEP = 256


def running_totals(values: Column) -> Column:
    """Sums of the first 1, 2, ... entries of a long array. Totals are taken within pieces of
    STEP entries and over the pieces, so the work stays near linear for very long arrays."""

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")),
                           lambda a: a["out"])

    def pieces(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: F.slice(v, i * STEP + 1, STEP))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(scan(sums, F.lit(0).cast("bigint")), 1, F.size(parts) - 1))
        return let(before, lambda starts: F.flatten(F.zip_with(parts, starts, scan)))

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(pieces(v), joined)).otherwise(empty))


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value); code points, end exclusive.

    Split and extraction walk through the same matches, so a match starts after all earlier
    pieces and matches.
    """
    lit = F.lit(pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    whole = lengths(F.regexp_extract_all(text, lit, F.lit(0)))
    value = F.regexp_extract_all(text, lit, F.lit(value_group))

    def placed(m: Column) -> Column:
        gaps = F.slice(lengths(F.split(text, pattern, -1)), 1, F.size(m))
        ends = running_totals(F.zip_with(gaps, m, lambda g, n: g + n))
        return F.zip_with(F.arrays_zip(ends.alias("end"), m.alias("n")), value,
                          lambda e, v: F.struct((e["end"] - e["n"]).alias("start"), e["end"].alias("end"), v.alias("value")))

    return let(whole, placed)
