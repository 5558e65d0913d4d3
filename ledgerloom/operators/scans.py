"""Running values along an order, spread over tasks where one key holds very many rows.

A window function sorts all rows of a key in one task.  ``running`` does so as long as no key has more than ``most`` rows,
which it counts first (a partial aggregation).  Beyond that it is one associative scan: rows are dealt by sampled ranges of
(keys, order), so a hot key lies in several neighbouring ranges; each range is summed up; the sums of the ranges before are
carried into the next, and windows only run inside one key of one range.  At most one key goes on from a range to the next,
so what is carried is at most a row a range: that is the bound on what is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.raw import cut

MOST = 1_000_000


def running(df: DataFrame, keys: list[str], order: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, most: int = MOST) -> DataFrame:
    """Adds columns: of ``last`` the last value that is not null in the rows before, of ``total`` the sum up to and with the row.
    Rows are told apart by (keys, order)."""
    last, total = last or {}, total or {}
    biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest <= most:
        return _inside(df.withColumns({f"__v_{n}": c for n, c in {**last, **total}.items()}), keys, order, last, total).drop(*[f"__v_{n}" for n in {**last, **total}])
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut: ranges are sampled anew by every run of the plan, and rows and sums must come from the same ones
    dealt = cut(df.withColumns({f"__v_{n}": c for n, c in {**last, **total}.items()}).repartitionByRange(ranges, *keys, *order).withColumn("__p", F.spark_partition_id()))
    at = F.struct(*order)
    sums = [F.max(F.when(F.col(f"__v_{n}").isNotNull(), F.struct(at.alias("o"), F.col(f"__v_{n}").alias("v")))).getField("v").alias(f"__s_{n}") for n in last]
    parts = dealt.groupBy("__p", *keys).agg(*sums, *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in total])
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.count("*").over(before).alias("__n"),
                         *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in last], *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in total])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__p") == F.col("__q"))
    rows = _inside(dealt, ["__p", *keys], order, last, total).join(F.broadcast(carry.where("__n > 0")), same, "left")
    out = {n: F.coalesce(n, f"__c_{n}") for n in last} | {n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in total}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _inside(df: DataFrame, keys: list[str], order: list[str], last: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(f"__v_{n}", ignorenulls=True).over(past) for n in last} | {n: F.sum(f"__v_{n}").over(upto) for n in total})
