"""Prefix scans: running sums, counts, least and greatest values in an order, without a task that sees all rows.

Rows have an integer place. A stretch is so many neighbouring places; its rows are in one task and are scanned by a window
there. Each stretch is folded to one small state for each key, the states are scanned in turn (by the same function, over
stretches of stretches, while they are many), and each stretch goes on from the state before it. Any fold will do that is
associative: the value of a run of rows follows from the values of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tessera.operators.storage import stored

#: Places of a stretch.
STRETCH = 1 << 16


@dataclass(frozen=True)
class Fold:
    """A running value: `value` of each row, folded by `how`, over the rows up to a row (`inclusive`) or before it.

    Null values don't count; a sum of none is 0, a least or greatest of none is null.
    """

    value: Column
    how: str = "sum"
    inclusive: bool = True

    def folded(self, column: str, window: WindowSpec | None = None) -> Column:
        made = _HOW[self.how](column)
        made = made if window is None else made.over(window)
        return F.coalesce(made, F.lit(0)) if self.how == "sum" else made

    def joined(self, a: Column, b: Column) -> Column:
        """Of what came before and what comes now; nulls are nothing."""
        return a + b if self.how == "sum" else F.greatest(a, b) if self.how == "max" else F.least(a, b)


_HOW: dict[str, Callable[[str], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(rows: DataFrame, place: str, folds: dict[str, Fold], by: Sequence[str] = (), then: Sequence[str] = (), stretch: int = STRETCH, most: int | None = None) -> DataFrame:
    """The rows with a column for each fold, over the rows of their key `by` in the order of (place, *then).

    place: integers from 0 or 1 on, with few rows each: a task holds the rows of `stretch` places. Rows that agree in the
    whole order are taken in any order. most: the greatest place, if known; else it is looked up. Rows of a null place
    come first, on a stretch of their own. Values of a fold are of one type all through.
    """
    if stretch < 2:
        raise ValueError("stretch: 2 at least")
    if any(f.how not in _HOW for f in folds.values()):
        raise ValueError(f"folds: {sorted(_HOW)}")
    by, then = list(by), list(then)
    own = F.expr(f"CAST(`{place}` AS BIGINT) DIV {stretch}")
    cut = rows.withColumn("_stretch", F.coalesce(own, F.lit(-1).cast("bigint"))).repartition("_stretch")
    order = Window.partitionBy("_stretch", *by).orderBy(place, *then)
    upto = {True: order.rowsBetween(Window.unboundedPreceding, 0), False: order.rowsBetween(Window.unboundedPreceding, -1)}
    cut = cut.withColumns({f"_v_{n}": f.value for n, f in folds.items()})
    cut = stored(cut.withColumns({n: f.folded(f"_v_{n}", upto[f.inclusive]) for n, f in folds.items()}), "scanned")
    states = cut.groupBy("_stretch", *by).agg(*[f.folded(f"_v_{n}").alias(f"_s_{n}") for n, f in folds.items()])
    if most is None:
        most = states.agg(F.max("_stretch")).first()[0]
        stretches = (most or 0) + 1
    else:
        stretches = most // stretch + 1
    before = {f"_b_{n}": Fold(F.col(f"_s_{n}"), f.how, False) for n, f in folds.items()}
    if stretches > stretch:
        known = scan(states.withColumnRenamed("_stretch", "_place"), "_place", before, by, (), stretch, stretches).withColumnRenamed("_place", "_stretch")
    else:  # one state for each stretch and key, and no more stretches than a stretch has places
        earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        known = states.withColumns({n: f.folded(n.replace("_b_", "_s_", 1), earlier) for n, f in before.items()})
    known = known.select(F.col("_stretch").alias("_k"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *before)
    on = F.col("_stretch") == F.col("_k")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    out = cut.join(known, on)
    return out.withColumns({n: f.joined(F.col(f"_b_{n}"), F.col(n)) for n, f in folds.items()}).select(*rows.columns, *folds)
