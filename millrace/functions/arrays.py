"""Array expressions: slices, padding, positions, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = -1  # fixed value: padding of positions, tokens and sampler slots


def int_slice(arr: Column, start0, length) -> Column:
    """``length`` elements from the 0-based ``start0`` on (none for a negative length)."""
    start0 = start0 if isinstance(start0, Column) else F.lit(start0)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.slice(arr, start0.cast("int") + F.lit(1), F.greatest(length.cast("int"), F.lit(0)))


def pad_to(arr: Column, width, value) -> Column:
    """Right-pad to ``width``; longer arrays are left alone."""
    width = width if isinstance(width, Column) else F.lit(width)
    missing = F.greatest((width - F.size(arr)).cast("int"), F.lit(0))
    return F.concat(arr, F.array_repeat(value, missing))


def counting(n: Column) -> Column:
    """0, 1, ..., n-1 (empty for n <= 0; ``sequence`` alone would count down)."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def restart_positions(ids: Column, eos) -> Column:
    """Position of every token, restarting at 0 after each end-of-document token.

    One pass: the state carries the positions so far per segment as an array of cut points
    (index after each EOS); a token's position is its index minus the last cut at or before it.
    """
    n = F.size(ids)
    cuts = F.concat(
        F.array(F.lit(0)),
        F.filter(
            F.transform(ids, lambda x, i: F.when(x == F.lit(eos), i + 1)), lambda c: c.isNotNull()
        ),
        F.array(n),
    )
    spans = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: b - a)
    return F.flatten(F.transform(spans, counting))


def split_before(arr: Column, marker) -> Column:
    """Array of the pieces between markers (markers removed), always at least one piece."""
    n = F.size(arr)
    marks = F.filter(F.transform(arr, lambda x, i: F.when(x == F.lit(marker), i)), lambda c: c.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: m + 1))
    ends = F.concat(marks, F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.slice(arr, a + 1, b - a))


def packed(arr: Column) -> Column:
    """An array of strings for the way through a shuffle: one text, and the array itself only where a blank or a null in it forbids that.

    An array spends 16 bytes or more on every short string, the text one.
    """
    plain = (F.size(arr) > 0) & ~F.exists(arr, lambda x: x.isNull() | F.contains(x, F.lit(" ")))
    return F.struct(F.when(plain, F.array_join(arr, " ")).alias("text"), F.when(~F.coalesce(plain, F.lit(False)), arr).alias("rest"))


def unpacked(col: Column) -> Column:
    return F.coalesce(F.split(col["text"], " ", -1), col["rest"])
