"""Exact medians of any number of rows by counting.

The range of a column is cut into BINS bins and the rows of each are counted, with their least and greatest value; the bin that holds the wanted rank becomes the next range,
until all its values are one. Each round is one aggregation for all columns, with at most BINS rows for each rank that is still open, so memory depends neither on the rows nor on
their distinct values. The result is the value that a sort would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


@dataclass
class _Open:
    column: str
    rank: int  # from 0, among the values from lo to hi
    lo: float
    hi: float


def medians(rows: DataFrame, *columns: str) -> dict[str, float | None]:
    """The median of each numeric column, the mean of the two middle values if their number is even; nulls don't count, and None is the median of nothing.

    rows is read once in each round, of which there are few: have it written if it is dear.
    """
    first = rows.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wanted: dict[str, list[tuple[str, int]]] = {}
    found: dict[tuple[str, int], float] = {}
    todo: list[_Open] = []
    for k, c in enumerate(columns):
        n, lo, hi = (first[f"{x}_{k}"] for x in ("n", "lo", "hi"))
        wanted[c] = [(c, (n - 1) // 2), (c, n // 2)] if n else []
        for key in dict.fromkeys(wanted[c]):
            if lo == hi:
                found[key] = lo
            else:
                todo.append(_Open(c, key[1], lo, hi))
    names = {id(o): (o.column, o.rank) for o in todo}
    while todo:
        items = []
        for k, o in enumerate(todo):
            x = F.col(o.column).cast("double")
            # Monotone in x, 0 at lo and the last bin at hi.
            place = F.least(F.lit(BINS - 1), F.floor((x - F.lit(o.lo)) / F.lit(o.hi - o.lo) * F.lit(float(BINS))))
            items.append(F.when(x.between(o.lo, o.hi), F.struct(F.lit(k).alias("k"), place.cast("int").alias("bin"), x.alias("x"))))
        each = rows.select(F.explode(F.array_compact(F.array(*items))).alias("i")).groupBy("i.k", "i.bin").agg(F.count("*").alias("n"), F.min("i.x").alias("lo"), F.max("i.x").alias("hi"))
        bins: dict[int, list] = {}
        for r in sorted(each.collect(), key=lambda r: r["bin"]):  # BINS rows for each open rank at most
            bins.setdefault(r["k"], []).append(r)
        left = []
        for k, o in enumerate(todo):
            for r in bins[k]:
                if o.rank < r["n"]:
                    o.lo, o.hi = r["lo"], r["hi"]
                    break
                o.rank -= r["n"]
            if o.lo == o.hi:
                found[names[id(o)]] = o.lo
            else:
                left.append(o)
        todo = left
    return {c: 0.5 * found[keys[0]] + 0.5 * found[keys[1]] if keys else None for c, keys in wanted.items()}
