"""Shards of near equal bytes by a k-d tree over document metadata.

Documents are points in three metadata dimensions: logarithm of size, source
and language. A node of the tree is split at the weighted median along its
widest dimension until every leaf is one shard. Medians are distributed: rounds
of histograms, each one aggregation, narrow a 32-bit key (dimension, then a
hash that orders ties), so neither a hot source nor equal metadata unbalances a
split.

Equal texts are one unit, so they stay together. Every unit goes down the tree.
A unit that weighs a notable part of a shard goes to the side of the median on
which it lies; what it brings too much there is made up for by the light units,
whose own cut along the same dimension is moved until both sides have their
shares. A side gets as many shards as its bytes are worth, but no more than it
has units. Only a group that no shard can hold is dealt into smaller units.

All steps are DataFrame functions, and the nodes of the tree are a table: the
driver holds a few numbers, however many shards there are.

Defined results: a null text has size 1 and the checksum of the empty text;
null metadata is a value of its own; rows that repeat an id are rows of their
own, each with its slot; with fewer units than shards some shards are empty; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.llm.store import staged

#: Bits of a round's histogram, rounds, and bits of a key.
DIGIT, ROUNDS = 16, 2
WIDTH = DIGIT * ROUNDS
#: Units heavier than this share of a shard keep to the side of the median; lighter ones even out the sides.
HEAVY = 1 / 8
#: A group that no shard can hold is dealt into units of about this share of a shard.
DEALT = 1 / 512
#: Tables of nodes are broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
DIMS = ("d_size", "d_source", "d_lang")


def _spread(column: Column) -> Column:
    """16 bits from a hash."""
    return F.shiftrightunsigned(F.xxhash64(column), 48)


def _units(rows: DataFrame, leaf: float) -> DataFrame:
    """Units (name, part) with weight, dimensions, tie hash and whether they are heavy."""
    units = rows.groupBy("name", "part").agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.max("size").alias("one"))
    d_size = F.least(F.log2(F.col("one").cast("double")) / 48 * (1 << DIGIT), F.lit((1 << DIGIT) - 1)).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64("name", "part", F.lit(11)), 48)
    heavy = F.col("w") > leaf * HEAVY
    return units.select("name", "part", "w", d_size.alias("d_size"), _spread(F.col("source")).alias("d_source"), _spread(F.col("lang")).alias("d_lang"), tie.alias("tie"), heavy.alias("heavy"), F.lit(0).alias("node"))


def _cuts(keyed: DataFrame, small) -> DataFrame:
    """node and cut: the key below which about the node's ``target`` lies; ``keyed`` has node, target, key and w. Nodes that have less are left out."""
    state = None
    for r in range(ROUNDS):
        shift = WIDTH - DIGIT * (r + 1)
        inside = keyed.withColumn("prefix", F.shiftright("key", shift))
        if state is None:
            inside = inside.withColumn("below", F.lit(0.0))
        else:  # what lies under the prefix that was found
            inside = inside.withColumn("above", F.shiftright("key", shift + DIGIT)).join(small(state), ["node", "above"])
        hist = inside.groupBy("node", "target", "below", "prefix").agg(F.sum("w").alias("w"))  # 65,536 rows a node at most
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("prefix")) + F.col("below")
        first = hist.withColumn("upto", upto).where("upto >= target").groupBy("node").agg(F.min_by(F.struct("prefix", "upto", "w", "target"), "prefix").alias("c"))
        before = F.col("c.upto") - F.col("c.w")
        state = first.select("node", F.col("c.prefix").alias("above"), before.alias("below"), F.when(F.col("c.target") - before <= F.col("c.upto") - F.col("c.target"), F.lit(0)).otherwise(1).alias("more"))
        last, state = state, state.drop("more")
    return last.select("node", (F.col("above") + F.col("more")).alias("cut"))


def _halved(units: DataFrame, nodes: DataFrame, small) -> DataFrame:
    """Units of all open nodes with ``side`` (0 or 1), of closed ones with null."""
    seen = units.join(small(nodes.where("k > 1")), "node").groupBy("node", "k").agg(F.sum("w").alias("all"), *[(F.max(d) - F.min(d)).alias(f"r_{d}") for d in DIMS])
    ranges = F.array(*[F.col(f"r_{d}") for d in DIMS])
    plan = seen.select("node", F.array_position(ranges, F.array_max(ranges)).cast("int").alias("widest"), (F.col("all") * F.floor(F.col("k") / 2) / F.col("k")).alias("target"))
    key = F.shiftleft(F.element_at(F.array(*DIMS), F.coalesce("widest", F.lit(1))), DIGIT).bitwiseOR(F.col("tie"))
    # each step is written, so that no plan holds another one many times
    keyed = staged(units.join(small(plan), "node", "left").withColumn("key", key).drop("widest"), "keyed")
    own = staged(_cuts(keyed.where("target is not null").select("node", "target", "key", "w"), small), "cuts")
    # what heavy units have brought to the lower side is no longer due from light ones
    brought = staged(keyed.where("heavy").join(small(own), "node").where("key < cut").groupBy("node").agg(F.sum("w").alias("brought")), "brought")
    light = keyed.where("not heavy and target is not null").join(small(brought), "node", "left")
    light = light.withColumn("target", F.greatest(F.col("target") - F.coalesce("brought", F.lit(0)), F.lit(0.0))).select("node", "target", "key", "w")
    moved = staged(_cuts(light, small).withColumnRenamed("cut", "light_cut"), "light_cuts")
    full = F.lit(1 << WIDTH)  # fewer light units than are due: all of them
    cut = F.when(F.col("heavy"), F.coalesce("cut", full)).otherwise(F.coalesce("light_cut", full))
    out = keyed.join(small(own), "node", "left").join(small(moved), "node", "left")
    return out.withColumn("side", F.when(F.col("target").isNotNull(), (F.col("key") >= cut).cast("int"))).select("name", "part", "w", *DIMS, "tie", "heavy", "node", "side")


def _children(halved: DataFrame, nodes: DataFrame, small) -> DataFrame:
    """node, side, child and k of the nodes below: closed nodes (side null) are their own; k 0 repeats a child."""
    n = lambda side: F.count_if(F.col("side") == side)
    seen = halved.where("side is not null").groupBy("node").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0)).alias("low"), n(0).alias("n0"), n(1).alias("n1"))
    worth = F.round(F.col("k") * F.col("low") / F.col("all"))
    k0 = F.greatest(F.least(worth, F.col("n0"), F.col("k") - 1), F.lit(1), F.col("k") - F.col("n1"))
    k0 = F.when((F.col("n0") == 0) | (F.col("n1") == 0), F.when(F.col("n0") == 0, 0).otherwise(F.col("k"))).otherwise(F.least(k0, F.col("k") - 1)).cast("int")
    split = seen.join(small(nodes.where("k > 1")), "node").withColumn("k0", k0)
    # a side that holds everything cannot be split any further: what its key has in common is one unit
    stuck = (F.col("n0") == 0) | (F.col("n1") == 0)
    low = F.struct(F.lit(0).alias("side"), F.col("node").alias("child"), F.when(stuck, 1).otherwise(F.col("k0")).alias("k"))
    high = F.struct(F.lit(1).alias("side"), (F.col("node") + F.when(stuck, 0).otherwise(F.col("k0"))).alias("child"), F.when(stuck, 0).otherwise(F.col("k") - F.col("k0")).alias("k"))
    below = split.withColumn("c", F.explode(F.array(low, high))).select("node", "c.side", "c.child", "c.k")
    return below.unionByName(nodes.where("k <= 1").select("node", F.lit(None).cast("int").alias("side"), F.col("node").alias("child"), "k"))


def shards(docs: DataFrame, count: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, in ``count`` shards (or as many as hold ``target_bytes`` each)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("name"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
    ).withColumn("at", F.monotonically_increasing_id()), "sizes")
    total = base.agg(F.sum("size")).first()[0] or 0
    if count is None:
        count = max(1, round(total / target_bytes))
    leaf = max(total / count, 1)
    small = F.broadcast if count <= BROADCAST_ROWS else lambda t: t  # a table of nodes has ``count`` rows at most
    groups = base.groupBy("name").agg(F.sum("size").alias("w")).where(F.col("w") > leaf)  # fewer than ``count``
    dealt = groups.select("name", F.ceil(F.col("w") / (leaf * DEALT)).alias("parts"))
    rows = base.join(small(dealt), "name", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("at"), "parts")).otherwise(F.lit(0)))
    rows = rows.select("name", "part", "doc_id", "size", "text_crc32", "source", "lang")
    units = staged(_units(rows, leaf), "units")
    nodes = spark.range(1).select(F.lit(0).alias("node"), F.lit(count).alias("k"))
    while nodes.where("k > 1").limit(1).count():
        halved = _halved(units, nodes, small)
        below = staged(_children(halved, nodes, small), "nodes")
        units = halved.join(small(below.withColumnRenamed("side", "s").withColumnRenamed("node", "n")), (F.col("node") == F.col("n")) & F.col("side").eqNullSafe(F.col("s"))).select("name", "part", "w", *DIMS, "tie", "heavy", F.col("child").alias("node"))
        nodes = below.where("k > 0").select(F.col("child").alias("node"), "k")
    placed = rows.join(units.select("name", "part", "node"), ["name", "part"])
    return _slots(placed.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")))


def _slots(rows: DataFrame) -> DataFrame:
    """Adds slot, from 0 without gaps in each shard: ranges of (shard, doc_id) are counted apart and shifted by what comes before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id())
    ranged = staged(ranged.withColumn("range", F.shiftright("at", 33)), "ranges")
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row for each range and shard in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("shard", "range", (before - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(shifts), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
