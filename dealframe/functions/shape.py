"""The shape language: 5431, 5-4-3-1, [3:5], 3:5, 4+, 3-, x for each suit; sorted shapes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = re.compile(r"\[(\d+):(\d+)\]|(\d+):(\d+)|(\d+)\+|(\d+)-(?=$|,)|(\d+)|[xX]")


def parse_shape(pattern: str) -> list[tuple[int, int]] | None:
    """Bounds for S, H, D, C; None when the text isn't a shape.

    Parts are separated by commas, spaces or dashes, or are four digits or x run
    together. Write ``3-`` parts with commas.
    """
    p = pattern.strip()
    if re.fullmatch(r"[\dxX]{4}", p):
        parts = list(p)
    elif "," in p or " " in p:
        parts = [x for x in re.split(r"[,\s]+", p) if x]
    else:
        parts = p.split("-")
    if len(parts) != 4:
        return None
    out = []
    for x in parts:
        m = ONE.fullmatch(x)
        if not m:
            return None
        a, b, c, d, least, most, exact = m.groups()
        if a or c:
            out.append((int(a or c), int(b or d)))
        elif least:
            out.append((int(least), 13))
        elif most:
            out.append((0, int(most)))
        elif exact:
            out.append((int(exact), int(exact)))
        else:
            out.append((0, 13))
    return out


def shape_filter(lengths: Column, pattern: str) -> Column:
    """Lengths (S, H, D, C) within the pattern's bounds, suit by suit."""
    bounds = parse_shape(pattern)
    if bounds is None:
        raise ValueError(f"not a shape: {pattern}")
    return reduce(lambda a, b: a & b, [F.element_at(lengths, i + 1).between(lo, hi) for i, (lo, hi) in enumerate(bounds)])


def sorted_shape_filter(lengths: Column, digits: str) -> Column:
    """Lengths that are the digits in some order."""
    return F.array_sort(lengths) == F.array(*[F.lit(int(d)) for d in sorted(digits)])


def shape_overlaps(columns: dict[str, tuple[Column, Column]], pattern: str) -> Column:
    """Ranges (min, max) by suit letter that could hold the pattern."""
    bounds = parse_shape(pattern)
    if bounds is None:
        raise ValueError(f"not a shape: {pattern}")
    tests = [(columns[s][0] <= hi) & (columns[s][1] >= lo) for s, (lo, hi) in zip("SHDC", bounds, strict=True)]
    return reduce(lambda a, b: a & b, tests)
