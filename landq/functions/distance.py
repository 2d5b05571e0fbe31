"""Edit distance of long sequences, by bit-parallel columns: a column of the table is one integer, so n words take n steps."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(most: int, same: Callable[[int, int], bool]) -> int:
    """The greatest number of leading elements, up to `most`, that two sequences share; `same` compares them from one place to another."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if same(low, middle):
            low = middle
        else:
            high = middle - 1
    return low


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The least number of insertions, deletions and replacements that make a of b.

    Bit i of `up` and `down` says that the distance grows or falls by one from prefix i to prefix i + 1 of `a`.
    """
    low = shared(min(len(a), len(b)), lambda x, y: a[x:y] == b[x:y])
    a, b = a[low:], b[low:]
    m, n = len(a), len(b)
    tail = shared(min(m, n), lambda x, y: a[m - y:m - x] == b[n - y:n - x])
    a, b = a[:m - tail], b[:n - tail]
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, found = every, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(level | up)), up & level
        found += bool(rise & top) - bool(fall & top)
        rise, fall, same = (rise << 1 | 1) & every, fall << 1 & every, same | down
        up, down = fall | (every & ~(same | rise)), rise & same
    return found


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of two texts (by characters) or two arrays (by elements); NULL where either is NULL."""
    def each(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x if isinstance(x, str) else list(x), y if isinstance(y, str) else list(y))
                          for x, y in zip(left, right)], dtype="Int64")
    return F.pandas_udf(each, "bigint")(a, b)
