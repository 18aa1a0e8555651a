"""Exact quantiles by group, by distributed selection.

The bits of a double, turned so that they sort as the number does, are looked
at 16 at a time. A round counts, for each group and rank that is asked for, the
values by their next 16 bits and keeps the bucket in which the rank lies; after
four rounds it holds one value. Counts are summed up before they are shuffled,
so a task sees at most 65,536 buckets of a rank, however large its group.
Equal values are one row with their number in all rounds, and no round tells
the shuffle behind these rows what it looks for: the shuffle is the same for
all, so Spark runs it, and what the values come from, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits of a round.
_BITS = 16


def _ordered_bits(value: str) -> Column:
    """A long that sorts as the double does: -0.0 is 0.0, NaN is above all; null for null."""
    bits = F.expr(f"CAST(java_method('java.lang.Double', 'doubleToLongBits', coalesce({value}, 0D) + 0D) AS BIGINT)")
    return F.when(F.col(value).isNull(), F.lit(None)).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])


def counted_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``value`` and ``__times``: each different value (null too) of a group once, with its number of rows."""
    return rows.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__times"))


def quantiles(rows: DataFrame, keys: list[str], value: str, interpolated: dict[str, float] | None = None, nearest: dict[str, float] | None = None, times: str | None = None) -> DataFrame:
    """``keys`` and one column for each quantile that is asked for, by name: interpolated between its two neighbours, or by nearest rank.

    Null values do not count; groups without values are left out; null keys are
    a group. ``times`` names the column with the number of each value if
    ``rows`` are those of ``counted_values``.
    """
    rows = rows if times else counted_values(rows, keys, value)
    v = rows.select(*keys, F.col(value).alias("__v"), F.when(F.col(value).isNotNull(), F.col(times or "__times")).otherwise(0).alias("__w"))
    n, q = F.col("__n"), {**(interpolated or {}), **(nearest or {})}
    ranks = []
    for name, share in (interpolated or {}).items():
        at = F.lit(float(share)) * (n - 1)
        ranks += [(f"{name}:low", F.floor(at)), (f"{name}:high", F.ceil(at))]
    ranks += [(name, F.greatest(F.ceil(F.lit(float(share)) * n), F.lit(1)) - 1) for name, share in (nearest or {}).items()]
    counts = v.groupBy(*keys).agg(F.sum("__w").alias("__n")).where("__n > 0")
    asked = F.array(*[F.struct(F.lit(name).alias("slot"), rank.cast("long").alias("rank")) for name, rank in ranks])
    asked = counts.select(*keys, n.alias("__size"), F.explode(asked).alias("__s")).select(*keys, "__size", F.col("__s.slot").alias("__slot"), F.col("__s.rank").alias("__rank"), F.lit(0).cast("long").alias("__prefix"))
    v = v.withColumn("__o", _ordered_bits("__v"))
    for shift in range(64 - _BITS, -1, -_BITS):
        ask = asked.select(*[F.col(k).alias(f"__{k}") for k in keys], "__size", "__slot", "__rank", "__prefix").withColumn("__one", F.lit(1))
        fit = _same(v, ask, keys) if keys else F.lit(True)
        if shift < 64 - _BITS:
            fit = fit & F.shiftright(v["__o"], shift + _BITS).eqNullSafe(ask["__prefix"])
        bucket = F.shiftright("__o", shift)  # all bits so far
        groups = [*[f"__{k}" for k in keys], "__size", "__slot", "__rank"]
        found = v.join(ask, fit).groupBy(*groups, bucket.alias("__prefix")).agg(F.sum("__w").alias("__n"), F.min("__v").alias("__v")).where("__n > 0")
        upto = F.sum("__n").over(Window.partitionBy(*groups[: len(keys)], "__slot").orderBy("__prefix"))
        found = found.withColumn("__upto", upto).where("__upto > __rank and __upto - __n <= __rank")
        asked = found.select(*[F.col(f"__{k}").alias(k) for k in keys], "__size", "__slot", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"), "__prefix", "__v")
    of = lambda slot: F.max(F.when(F.col("__slot") == slot, F.col("__v")))
    out = [of(name).alias(name) for name in nearest or {}]
    for name in interpolated or {}:
        at = F.lit(float(q[name])) * (F.max("__size") - 1)
        low, high = of(f"{name}:low"), of(f"{name}:high")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return asked.groupBy(*keys).agg(*out)


def with_quantiles(summary: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``summary`` with the columns of ``found`` (as ``quantiles`` gives them) for the same keys; null where there are no values."""
    other = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    return summary.join(other, _same(summary, other, keys), "left").drop(*[f"__{k}" for k in keys])
