"""Running totals and cut points over a global order, without a one-task window.

Rows are tagged with a bucket of the order key. Bucket bounds are quantiles of the key,
read once and then kept as literals, so buckets hold about equally many rows whatever the
key's distribution and a recomputed task always lands in the same bucket. Per-bucket
totals (one row each) give every bucket its offset; windows run inside buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
BUCKET_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Buckets:
    """Bounds over a numeric expression that never decreases along the order."""

    position: Column
    bounds: tuple[float, ...]

    @classmethod
    def of(cls, df: DataFrame, position: Column, count: int | None = None) -> Buckets:
        """Quantile bounds of ``position``: one aggregate over that column alone.

        Without a ``count``, four buckets per shuffle partition, and more where these would
        hold over ``BUCKET_ROWS`` rows each.
        """
        least = count or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def quantiles(wanted: int) -> tuple:
            shares = [i / wanted for i in range(1, wanted)]
            found = F.percentile_approx(position.cast("double"), shares, 10 * wanted)
            return df.select(found, F.count(F.lit(1))).first()

        found, rows = quantiles(max(2, least))
        if not count and rows > least * BUCKET_ROWS:
            found, rows = quantiles(-(-rows // BUCKET_ROWS))
        return cls(position, (-math.inf, *sorted(set(found or [0.0])), math.inf))

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the bucket number, by binary search over the bounds."""
        if BUCKET in df.columns:
            return df
        finder = Bucketizer(splits=list(self.bounds), inputCol="_position", outputCol=BUCKET)
        tagged = finder.transform(df.withColumn("_position", self.position.cast("double")))
        return tagged.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_position")

    def inside(self, bucket: int) -> Column:
        """Plain range filter around one bucket, so that the scan can skip row groups.

        One double step wider than the bucket, since a long may round onto the bound.
        """
        low, high = self.bounds[bucket], self.bounds[bucket + 1]
        keep = F.lit(True)
        if low > -math.inf:
            keep &= self.position >= F.lit(math.floor(math.nextafter(low, -math.inf)))
        if high < math.inf:
            keep &= self.position <= F.lit(math.ceil(math.nextafter(high, math.inf)))
        return keep


def div(number: Column, by: int) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", number, F.lit(by))


def _joined(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.least(left, right)


def running(
    df: DataFrame,
    order: Sequence[str],
    buckets: Buckets,
    before: Mapping[str, tuple[str, str]] | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Add ``rank`` (from 1) and, per entry of ``before``, the total over earlier rows.

    ``before`` maps an output name to ``("sum" | "min", column)``. A group of any size is
    spread over all buckets. ``df`` is read twice: give it narrow or staged.
    """
    before = dict(before or {})
    tagged = buckets.tag(df)
    keys = [*group, BUCKET]
    kinds = {"sum": F.sum, "min": F.min}

    totals = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[kinds[kind](column).alias(f"_t_{name}") for name, (kind, column) in before.items()],
    )
    earlier_buckets = (
        Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier_buckets), F.lit(0)).alias("_rows_ahead"),
        *[
            kinds[kind](f"_t_{name}").over(earlier_buckets).alias(f"_ahead_{name}")
            for name, (kind, _) in before.items()
        ],
    )
    # Without groups there is an offset per bucket, a millionth of the rows at most beyond the
    # first few; with groups Spark sizes the join.
    placed = tagged.join(offsets if group else F.broadcast(offsets), keys)

    here = Window.partitionBy(*keys).orderBy(*order)
    earlier_rows = here.rowsBetween(Window.unboundedPreceding, -1)
    columns = [c for c in tagged.columns if c != BUCKET]
    return placed.select(
        *columns,
        BUCKET,
        (F.col("_rows_ahead") + F.row_number().over(here)).alias("rank"),
        *[
            _joined(kind, F.col(f"_ahead_{name}"), kinds[kind](column).over(earlier_rows)).alias(name)
            for name, (kind, column) in before.items()
        ],
    )


def cutoff(
    df: DataFrame, order: Sequence[str], buckets: Buckets, weight: Column, target: float
) -> tuple | None:
    """Key of the first row at which the running weight reaches ``target``.

    Two passes: bucket totals, then only the bucket that holds the crossing. Returns None
    when the total stays below the target. The caller keeps rows with a key up to it.
    """
    weighed = buckets.tag(df.withColumn("_weight", weight))
    totals = weighed.groupBy(BUCKET).agg(F.sum("_weight").alias("_weight"))
    through = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        totals.select(BUCKET, "_weight", F.sum("_weight").over(through).alias("_through"))
        .filter(F.col("_through") >= F.lit(target))
        .orderBy(BUCKET)
        .first()
    )
    if crossing is None:
        return None
    ahead = crossing["_through"] - crossing["_weight"]
    # One bucket is 1/n of the rows, so this window's single task stays small.
    rows = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        weighed.filter(buckets.inside(crossing[BUCKET]))
        .filter(F.col(BUCKET) == crossing[BUCKET])
        .select(*order, (F.lit(ahead) + F.sum("_weight").over(rows)).alias("_through"))
        .filter(F.col("_through") >= F.lit(target))
        .orderBy(*order)
        .first()
    )
    return tuple(found[c] for c in order)


def up_to(order: Sequence[str], key: tuple | None) -> Column:
    """Filter for rows whose key is not after ``key``; everything when ``key`` is None."""
    if key is None:
        return F.lit(True)
    first, *rest = order
    here = F.col(first) == F.lit(key[0])
    last = F.lit(True) if not rest else up_to(rest, key[1:])
    if not rest:
        return F.col(first) <= F.lit(key[0])
    return (F.col(first) < F.lit(key[0])) | (here & last)


@dataclass(frozen=True)
class Ranges:
    """Numbered key ranges, such as shards, that rows of any table can be looked up in."""

    key: str
    label: str
    buckets: Buckets
    starts: DataFrame
    group: tuple[str, ...] = ()

    def assign(self, df: DataFrame, first_key: bool = False) -> DataFrame:
        """Add the ``label`` of the range each row's key falls in, without shuffling ``df``.

        With ``first_key`` also the range's first key.

        ``starts`` has a row per range (group, label 0, 1, 2, ..., ``first_key``) and should be
        staged. A range is listed for each bucket it touches; rows look up their own bucket.
        """
        group = list(self.group)
        starts = self.buckets.tag(self.starts.withColumn(self.key, F.col("first_key"))).drop(self.key)
        nexts = starts.select(
            *group,
            (F.col(self.label) - 1).alias(self.label),
            F.col("first_key").alias("next_key"),
            F.col(BUCKET).alias("_last_bucket"),
        )
        end = len(self.buckets.bounds) - 2
        touched = F.sequence(BUCKET, F.coalesce("_last_bucket", F.lit(end)))
        ranges = starts.join(nexts, [*group, self.label], "left").select(
            *group, self.label, "first_key", "next_key", F.explode(touched).alias(BUCKET)
        )
        # Ranges are far fewer than rows, but grow with the table: check before broadcasting.
        if starts.count() + end <= BROADCAST_ROWS:
            ranges = F.broadcast(ranges)
        rows, ranges = self.buckets.tag(df).alias("_row"), ranges.alias("_range")
        key = F.col(f"_row.{self.key}")
        here = (key >= F.col("first_key")) & (F.col("next_key").isNull() | (key < F.col("next_key")))
        for column in [*group, BUCKET]:
            here &= F.col(f"_row.{column}") == F.col(f"_range.{column}")
        more = ["_range.first_key"] if first_key else []
        return rows.join(ranges, here).select("_row.*", f"_range.{self.label}", *more).drop(BUCKET)


def with_context(df: DataFrame, step: str, back: int, size: int = 10_000) -> DataFrame:
    """Cut groups into chunks of ``size`` steps that also see the ``back`` steps before them.

    Adds ``_chunk`` and ``_context`` (true on the repeated rows, to be dropped at the end),
    so that windows over group and chunk stay bounded however long one group is.
    """
    chunk = div(F.col(step), size)
    tail = F.col(step) % size >= size - back
    return df.withColumn(
        "_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    ).withColumn("_context", F.col("_chunk") != chunk)
