"""The common star-schema tables as tables of the data model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldra.functions.domain import N_PLAYERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str, per_task: int = 20_000) -> DataFrame:
    """``rows`` by ``keys`` over as many tasks as their number asks for. A file of narrow rows has few row groups, and a row group is read by one task, whatever is done with its rows."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / per_task))
    return rows.repartition(n, *keys)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, spread for work inside of each row."""
    return spread(table(spark, sf_dir, "customer"), "c_custkey")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, spread for work inside of each row that takes a millisecond or more."""
    return spread(table(spark, sf_dir, "conversations"), "conv_id", "turn", per_task=2_000)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, game, observer, phase, sample, status from events."""
    status = F.when(F.col("event_type") == "error", "parse_error").when(F.col("event_type") == "signup", "semantic_error").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("game"), (F.col("user_id") % 7 + 1).alias("observer"), F.concat((F.col("event_id") % 3 + 1).cast("string"), F.lit("_day_speech")).alias("phase"), F.floor(F.col("event_id") / 7).alias("sample"), status.alias("status"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, seq, game, category, dispatch, latency_ms, usage_available, input_tokens from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("game"), F.when(F.col("event_type").isin("click", "view"), "gameplay").otherwise("belief").alias("category"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("dispatch"), F.col("value").alias("latency_ms"),
        (F.col("event_id") % 3 == 0).alias("usage_available"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("input_tokens"),
    )


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, voter, target (0 abstains) and a ballot number from lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("round"), F.col("l_linenumber").cast("int").alias("voter"), (F.col("l_partkey") % 8).cast("int").alias("target"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ballot"))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, observer, known, cleared, suspected (arrays of player numbers) from customer."""
    observer = (F.col("c_custkey") % 7 + 1).cast("int")
    wolf = ((F.col("c_custkey") + 2) % 7 + 1).cast("int")
    numbers = F.sequence(F.lit(1), F.lit(N_PLAYERS))
    known = F.when(F.col("c_custkey") % 5 == 0, F.array(wolf)).otherwise(F.array().cast("array<int>"))
    marked = F.filter(numbers, lambda x: F.pmod(F.floor(F.col("c_nationkey") / F.pow(F.lit(2.0), x - 1)), F.lit(2)) == 1)
    rows = customers(spark, sf_dir).select(F.col("c_custkey").alias("report_id"), observer.alias("observer"), known.alias("known"), F.array(observer).alias("cleared"), marked.alias("marked"))
    return rows.withColumn("suspected", F.array_union(F.array_except("marked", "cleared"), "known")).drop("marked")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot, observer, logits and target (21 each) from embeddings."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    raw = F.transform(F.slice(v, 22, 21), F.abs)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("snapshot"), (F.col("vec_id") % 4 + 1).alias("observer"), "vec_id", F.slice(v, 1, 21).alias("logits"), F.transform(raw, lambda x: x / total).alias("target"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, event_idx, speaker, phase (on every third event) and n_tokens from conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("game"), F.col("turn").alias("event_idx"), (F.col("turn") % 7 + 1).alias("speaker"), F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit("_day_speech"))).alias("phase"), F.length("text").cast("long").alias("n_tokens"), "text")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot, observer, speaker, public_only, status, error, known, cleared, suspected from customer: seven observers each."""
    key = F.col("c_custkey")
    o = (key % N_PLAYERS + 1).cast("int")
    snapshot = F.floor(key / N_PLAYERS)
    status = F.when(F.col("c_nationkey") % 4 == 2, "semantic_error").when(F.col("c_nationkey") % 4 == 3, "parse_error").otherwise("ok")
    seat = lambda k: ((o + k) % N_PLAYERS + 1).cast("int")
    none = F.array().cast("array<int>")
    rows = customers(spark, sf_dir).select(snapshot.alias("snapshot"), o.alias("observer"), (snapshot % N_PLAYERS + 1).cast("int").alias("speaker"), (snapshot % 5 == 0).alias("public_only"), status.alias("status"), F.when(key % 3 == 0, F.array(seat(0), seat(2))).otherwise(none).alias("known"), F.array(o).alias("cleared"), seat(3).alias("soft"))
    suspected = F.when(F.size("known") > 0, F.col("known")).otherwise(F.array("soft"))
    return rows.withColumn("error", F.when(F.col("status") != "ok", F.col("status"))).withColumn("suspected", F.when(F.col("status") == "ok", suspected)).drop("soft")


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, observer, identity, event, target, checked, team from events; the wolves sit one and three seats on from the observer."""
    o = (F.col("user_id") % N_PLAYERS + 1).cast("int")
    first, second = (o % N_PLAYERS + 1).cast("int"), ((o + 2) % N_PLAYERS + 1).cast("int")
    t = (F.col("event_id") % (N_PLAYERS + 1)).cast("int")
    identity = F.element_at(F.array(*map(F.lit, ("Werewolf", "Seer", "Witch", "Villager"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), o.alias("observer"), identity.alias("identity"), F.col("event_type").alias("type"), t.alias("target"), t.isin(first, second).alias("hit"), F.array(o, first).alias("team"))
    event = F.when(F.col("identity") == "Werewolf", "werewolf_team_info").when(F.col("type") == "click", "skill_seer").when(F.col("type") == "view", "kill_decision").otherwise("vote")
    checked = F.when(F.col("target") > 0, F.when(F.col("hit"), "bad").otherwise("good"))
    return rows.withColumn("event", event).withColumn("checked", checked).withColumn("target", F.when((F.col("event") == "kill_decision") & F.col("hit"), 0).otherwise(F.col("target"))).drop("type", "hit")
