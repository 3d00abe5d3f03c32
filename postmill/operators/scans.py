"""Running sums, counts, maxima and last values of each key, also where one key holds a large share of all rows.

A window puts a key's rows into one task. Where a key has more than MOST_ROWS, rows are dealt into sorted ranges of
(key, order) instead, so a key spreads over as many ranges as it needs; each range and key gets its totals, a small pass
over the totals (one row for each range of a key) gives what came before, and that is added to the local running values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept

#: Rows of one key from which on its rows are spread over ranges; both ways give the same.
MOST_ROWS = 1_000_000

#: How a measure is taken over rows, and how what came before joins what is here; `last` passes over nulls.
_TAKE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "max": F.max, "last": lambda c: F.last(c, True)}
_JOIN: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b)), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a),
}


def running(rows: DataFrame, keys: list[str], order: list[str], measures: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Adds each measure (name: kind, column) over the key's rows up to and with this one, or before it.

    kind: sum, count, max or last (the last that is no null). Order should tell the rows of a key apart; rows that it
    doesn't tell apart come in any order. Null keys are one key. An empty table gives an empty result.
    """
    most, total = rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    if (most or 0) <= MOST_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return rows.withColumns({n: _TAKE[kind](c).over(w) for n, (kind, c) in measures.items()})
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // MOST_ROWS))
    values = {f"_value_{n}": c for n, (_, c) in measures.items()}
    ranged = kept(rows.withColumns(values).repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    here = ranged.withColumns({n: _TAKE[kind](F.col(f"_value_{n}")).over(local.rowsBetween(*frame)) for n, (kind, _) in measures.items()})
    ends = {n: F.max_by(f"_value_{n}", F.when(F.col(f"_value_{n}").isNotNull(), F.struct(*order))) if kind == "last" else _TAKE[kind](F.col(f"_value_{n}")) for n, (kind, _) in measures.items()}
    totals = ranged.groupBy("_range", *keys).agg(*[c.alias(f"_total_{n}") for n, c in ends.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a key
    again = {"count": F.sum}
    carried = totals.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[again.get(kind, _TAKE[kind])(F.col(f"_total_{n}")).over(before).alias(f"_before_{n}") for n, (kind, _) in measures.items()])
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = here.join(carried, same)
    return joined.select(*rows.columns, *[_JOIN[kind](F.col(f"_before_{n}"), F.col(n)).alias(n) for n, (kind, _) in measures.items()])
