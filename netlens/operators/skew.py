"""Building blocks that keep one hot key from landing in one task.

* ``attach_by_key`` joins per-key facts to a large table: the heaviest keys travel by broadcast
  (their number is fixed, so the size is bounded), every other key by a shuffle join in which
  no key can weigh more than the lightest broadcast one.
* ``running_sum`` and ``previous_value`` are ordered windows cut into blocks of the order column:
  a block is windowed on its own and the state before it comes from one row per earlier block.
  Their key and order columns must not be NULL.
* ``top_per_group`` ranks with ``row_number() <= n``, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1024
BLOCK_BITS = 20


def attach_by_key(
    rows: DataFrame,
    facts: DataFrame,
    key: Sequence[str],
    weight: str,
    spread: Sequence[str],
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Add the columns of ``facts`` (one row per key, NULL where absent) to ``rows``.

    ``weight`` is the fact column that tells how many rows a key has; ``spread`` names columns of
    ``rows`` whose hash scatters the rows of broadcast keys over the shuffle.
    """
    key = list(key)
    names = [name for name in facts.columns if name not in key and name != weight]
    # A NULL key matches nothing; saying so here keeps both uses of the facts on one shuffle.
    known = facts.where(F.expr(" AND ".join(f"`{name}` IS NOT NULL" for name in key)))
    packed = known.select(*key, weight, F.struct(*names).alias("_facts"))
    hot = packed.orderBy(F.desc(weight), *key).limit(hot_keys).select(*key, F.col("_facts").alias("_hot"))
    lane = F.when(
        F.col("_hot").isNotNull(), F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))
    ).otherwise(F.lit(0).cast("bigint"))
    rest = packed.where(F.coalesce(weight, F.lit(0)) >= 0).select(*key, F.lit(0).cast("bigint").alias("_lane"), F.col("_facts").alias("_cold"))
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("_lane", lane).join(rest, key + ["_lane"], "left")
    value = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[value[name].alias(name) for name in names])


def by_block(rows: DataFrame, key: Sequence[str], order: str, bits: int) -> DataFrame:
    """Rows shuffled by key and block. Both the rows and the block totals read this one shuffle.

    The filter states what holds anyway (no NULL keys), so that the later join adds nothing to one side only.
    """
    cut = [*key, "_block"]
    known = F.expr(" AND ".join(f"`{name}` IS NOT NULL" for name in cut))
    return rows.withColumn("_block", F.shiftright(F.col(order), bits)).where(known).repartition(*cut)


def block_totals(blocked: DataFrame, cut: Sequence[str], *totals: Column) -> DataFrame:
    """One row per block of an already shuffled frame.

    The totals need few columns, and a pruned copy of the shuffle could not be reused. So every
    column is touched by a hash that is never NULL: Spark then sees the same shuffle twice and runs
    it once.
    """
    plain, nested = [], []
    for field in blocked.schema.fields:
        kind = field.dataType.simpleString()
        (nested if "map<" in kind or "variant" in kind else plain).append(field.name)
    touched = F.hash(*plain, *[F.col(name).isNull() for name in nested])
    return blocked.groupBy(*cut).agg(*totals, F.min(touched).alias("_touched")).where(F.col("_touched").isNotNull())


def running_sum(
    rows: DataFrame, key: Sequence[str], order: str, sums: Mapping[str, Column], bits: int = BLOCK_BITS
) -> DataFrame:
    """Add inclusive running sums of the given columns per key in ``order`` (a BIGINT, unique per key)."""
    cut = list(key) + ["_block"]
    blocked = by_block(rows.withColumns({"_in_" + name: value for name, value in sums.items()}), key, order, bits)
    inside = Window.partitionBy(*cut).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = block_totals(blocked, cut, *[F.sum("_in_" + name).alias("_sum_" + name) for name in sums]).select(
        *cut, *[F.sum("_sum_" + name).over(earlier).alias("_before_" + name) for name in sums]
    )
    local = blocked.withColumns({"_in_" + name: F.sum("_in_" + name).over(inside) for name in sums})
    return local.join(carried, cut).select(
        *rows.columns,
        *[(F.col("_in_" + name) + F.coalesce("_before_" + name, F.lit(0))).alias(name) for name in sums],
    )


def row_numbers(rows: DataFrame, key: Sequence[str], order: str, name: str = "rn", bits: int = BLOCK_BITS) -> DataFrame:
    """1-based position of each row within its key."""
    return running_sum(rows, key, order, {name: F.lit(1).cast("bigint")}, bits)


def previous_value(
    rows: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_", bits: int = BLOCK_BITS
) -> DataFrame:
    """Add the given columns of the row before, per key in ``order``; NULL on the first row."""
    cut = list(key) + ["_block"]
    packed = F.struct(*columns)
    blocked = by_block(rows, key, order, bits)
    inside = Window.partitionBy(*cut).orderBy(order)
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = block_totals(blocked, cut, F.max_by(packed, F.col(order)).alias("_last")).select(
        *cut, F.last("_last", ignorenulls=True).over(earlier).alias("_before")
    )
    local = blocked.withColumn("_lag", F.lag(packed).over(inside))
    value = F.coalesce("_lag", "_before")
    return local.join(carried, cut).select(
        *rows.columns, *[value[name].alias(prefix + name) for name in columns]
    )


def rolling(
    rows: DataFrame, key: Sequence[str], order: str, values: Mapping[str, Column], width: int, skip: int = 0, size: int = 1 << 16
) -> DataFrame:
    """Add aggregates (``values``: name and aggregate) over the current and the ``width - 1`` rows before it, per key in ``order``.

    The first ``skip`` rows of a key are left out altogether. Rows are numbered first; each block of numbers also
    receives the rows just before it, so a block is windowed on its own and still sees every row it needs.
    """
    size = max(width, size)
    numbered = row_numbers(rows, key, order, "_rn").withColumn("_rn", F.col("_rn") - (1 + skip)).where(F.col("_rn") >= 0)
    own = F.floor(F.col("_rn") / size).cast("bigint")
    tail = F.col("_rn") % size >= size - width + 1
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    halo = numbered.withColumn("_own", own).withColumn("_part", F.explode(copies))
    window = Window.partitionBy(*key, "_part").orderBy("_rn").rowsBetween(1 - width, Window.currentRow)
    rolled = halo.withColumns({name: value.over(window) for name, value in values.items()})
    return rolled.where(F.col("_own") == F.col("_part")).select(*rows.columns, *values)


def rolling_sum(
    rows: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], width: int, prefix: str = "last_",
    size: int = 1 << 16,
) -> DataFrame:
    """Add sums over the current and the ``width - 1`` rows before it."""
    return rolling(rows, key, order, {prefix + name: F.sum(name) for name in columns}, width, size=size)


def top_per_group(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in the given order, numbered from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)
