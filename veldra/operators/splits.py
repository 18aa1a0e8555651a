"""Splits by group without leakage, and the checks around them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, functions as F


def shuffled_split(games: DataFrame, counts: dict[str, int], seed: int, most: int = 1_000_000) -> DataFrame:
    """game_id and split: the sorted distinct games, shuffled by seed and cut by counts.

    The seeded shuffle is sequential by definition, so the names of the games
    (not their rows) pass through the driver, ``most`` of them at most.
    """
    names = sorted(r[0] for r in games.select("game_id").distinct().limit(most + 1).collect())
    if len(names) > most or len(names) != sum(counts.values()):
        raise ValueError(f"{len(names)} games for counts {counts}")
    random.Random(seed).shuffle(names)
    rows, at = [], 0
    for split, n in counts.items():
        rows += [(g, split) for g in names[at : at + n]]
        at += n
    return games.sparkSession.createDataFrame(rows, "game_id string, split string")


def seed_split(games: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """split of each row by the range (both ends inside) of its ``seed``; null outside."""
    split = F.lit(None).cast("string")
    for name, (a, b) in ranges.items():
        split = F.when(F.col("seed").between(a, b), name).otherwise(split)
    return games.withColumn("split", split)


def misaligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ between the two sides (equal multisets give none)."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n_left")), right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, keys, "full_outer").where("not n_left <=> n_right").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def unknown(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest, key, "left_anti").select(key).distinct()


def unused(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return manifest.join(rows, key, "left_anti").select(key).distinct()


def leaking(assigned: DataFrame, key: str = "game_id") -> DataFrame:
    """Groups that stand in more than one split."""
    return assigned.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def require_empty(rows: DataFrame, what: str, shown: int = 10) -> None:
    """Fail with the first few offenders, in order."""
    found = [tuple(r) for r in rows.orderBy(*rows.columns).limit(shown).collect()]
    if found:
        raise ValueError(f"{what}: {found}")
