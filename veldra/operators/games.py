"""Game logs: votes, nights, outcomes, prefixes and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exile(ballots: DataFrame) -> DataFrame:
    """round, exiled (null without a majority), tied candidates, and abstentions: plurality without target 0."""
    votes = ballots.groupBy("round", "target").agg(F.count("*").alias("n"))
    top = votes.where("target <> 0").withColumn("rank", F.rank().over(Window.partitionBy("round").orderBy(F.desc("n")))).where("rank = 1")
    top = top.groupBy("round").agg(F.array_sort(F.collect_list("target")).alias("leaders"))  # seven players at most
    all_ = votes.groupBy("round").agg(F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0)).alias("abstained"))
    out = all_.join(top, "round", "left").withColumn("leaders", F.coalesce("leaders", F.array().cast("array<int>")))
    return out.select("round", F.when(F.size("leaders") == 1, F.col("leaders")[0]).alias("exiled"), F.size("leaders").alias("n_leaders"), "abstained")


def runoff(ballots: DataFrame, alive: DataFrame) -> DataFrame:
    """The exile vote with its second round: round, outcome, exiled, candidates and voters of the second round, abstentions of the first.

    ``ballots``: round, stage (``vote`` or ``vote_pk``), voter, target (0 abstains); ``alive``: round and the array ``alive``.
    A tie sends its leaders into a second round in which all others that are
    alive vote (the leaders themselves if there are no others); a second tie, or
    no vote, exiles nobody. Ballots of a second round that is not due, for
    players who do not stand in it, or by others than its voters do not count.
    """
    first = exile(ballots.where("stage = 'vote'"))
    top = ballots.where("stage = 'vote' and target <> 0").groupBy("round", "target").agg(F.count("*").alias("n"))
    top = top.withColumn("rank", F.rank().over(Window.partitionBy("round").orderBy(F.desc("n")))).where("rank = 1").groupBy("round").agg(F.array_sort(F.collect_list("target")).alias("leaders"))  # seven at most
    rows = alive.join(first, "round", "left").join(top.where("size(leaders) > 1"), "round", "left").withColumnRenamed("leaders", "candidates")
    others = F.array_sort(F.array_except("alive", "candidates"))
    rows = rows.withColumn("voters", F.when(F.col("candidates").isNotNull(), F.when(F.size(others) > 0, others).otherwise(F.col("candidates"))))
    second = ballots.where("stage = 'vote_pk'").join(rows.where("candidates is not null").select("round", "candidates", "voters"), "round")
    second = second.where(F.array_contains("voters", F.col("voter")) & ((F.col("target") == 0) | F.array_contains("candidates", F.col("target"))))
    second = exile(second).select("round", F.col("exiled").alias("__exiled"), F.col("n_leaders").alias("__leaders"))
    rows = rows.join(second, "round", "left")
    outcome_ = (
        F.when(F.coalesce("n_leaders", F.lit(0)) == 0, "all abstention").when(F.col("n_leaders") == 1, "exiled").when(F.coalesce("__leaders", F.lit(0)) == 0, "all abstention in pk")
        .when(F.col("__leaders") == 1, "exiled in pk").otherwise("draw in pk")
    )
    return rows.select("round", outcome_.alias("outcome"), F.coalesce("exiled", "__exiled").alias("exiled"), "candidates", "voters", F.coalesce("abstained", F.lit(0)).alias("abstained"))


def kill(ballots: DataFrame) -> DataFrame:
    """Plurality of the night's votes without passes (target 0); a tie goes to the last voter's choice."""
    rows = ballots.where("target <> 0")
    counts = rows.groupBy("round", "target").agg(F.count("*").alias("n"))
    top = counts.withColumn("rank", F.rank().over(Window.partitionBy("round").orderBy(F.desc("n")))).where("rank = 1").groupBy("round").agg(F.count("*").alias("ties"), F.min("target").alias("leader"))
    last = rows.groupBy("round").agg(F.max_by("target", F.struct("voter", "ballot")).alias("last_choice"))
    return top.join(last, "round").select("round", F.when(F.col("ties") == 1, F.col("leader")).otherwise(F.col("last_choice")).alias("killed"))


def night(kill_target: Column, guarded: Column, healed: Column, poisoned: Column) -> Column:
    """Players that die in a night: guard or heal saves, both together do not; poison always kills."""
    saved = (F.coalesce(guarded == kill_target, F.lit(False))) != F.coalesce(healed, F.lit(False))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(~saved, kill_target), poisoned))))


def outcome(alive: DataFrame) -> DataFrame:
    """-1 if no wolf is left, 1 if no villager or no god is left, else 0, for each game."""
    n = lambda camp: F.count_if(F.col("camp") == camp)
    return alive.groupBy("game").agg(F.when(n("wolf") == 0, -1).when((n("villager") == 0) | (n("god") == 0), 1).otherwise(0).alias("outcome"))


def wins(log: DataFrame) -> DataFrame:
    """Games whose last row has outcome 1 (wolves), and the others."""
    last = log.groupBy("game").agg(F.max_by("outcome", "log_idx").alias("outcome"))
    return last.agg(F.count_if(F.col("outcome") == 1).alias("wolf"), F.count_if(~F.coalesce(F.col("outcome") == 1, F.lit(False))).alias("villager"))


def discontinuities(events: DataFrame) -> DataFrame:
    """Events whose index is not their place in the game."""
    place = F.row_number().over(Window.partitionBy("game").orderBy("event_idx")) - 1
    return events.withColumn("place", place).where("place <> event_idx").select("game", "event_idx", "place")


def prefix_chain(events: Column) -> Column:
    """For each prefix of an array two hashes (h, g), each made from the one before and the next element; null elements and fields count."""
    each = F.transform(events, lambda e: F.to_json(F.struct(e.alias("e")), {"ignoreNullFields": "false"}))
    link = "struct<h:bigint,g:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.array().cast(f"array<{link}>").alias("chain"))

    def step(s: Column, e: Column) -> Column:
        h, g = F.xxhash64(s["h"], e), F.xxhash64(F.lit(7), s["g"], e)
        return F.struct(h.alias("h"), g.alias("g"), F.array_append(s["chain"], F.struct(h.alias("h"), g.alias("g"))).alias("chain"))

    return F.aggregate(F.coalesce(each, F.array().cast("array<string>")), start, step, lambda s: s["chain"])


def broken_prefixes(snapshots: DataFrame) -> DataFrame:
    """Snapshots that do not extend the one before: not longer, or the former is no exact prefix. Null events are none.

    What is shuffled is 16 bytes for each prefix, not the events.
    """
    rows = snapshots.select("game", "row_idx", prefix_chain(F.col("events")).alias("chain"))
    w = Window.partitionBy("game").orderBy("row_idx")
    rows = rows.withColumn("n", F.lag(F.size("chain")).over(w)).withColumn("end", F.lag(F.try_element_at("chain", F.lit(-1))).over(w)).where("n is not null")
    fine = (F.size("chain") > F.col("n")) & ((F.col("n") == 0) | (F.get("chain", F.col("n") - 1) == F.col("end")))
    return rows.where(~F.coalesce(fine, F.lit(False))).select("game", "row_idx")


def latest_phase(events: DataFrame) -> DataFrame:
    """Each event with the phase that holds then."""
    w = Window.partitionBy("game").orderBy("event_idx").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("current_phase", F.last("phase", ignorenulls=True).over(w))


def newest_groups(groups: DataFrame, limit: int) -> DataFrame:
    """The newest whole groups with ``limit`` tokens at most together; if the newest alone is longer, its first token and its last limit - 1."""
    back = Window.partitionBy("game").orderBy(F.desc("event_idx"))
    rows = groups.withColumn("up_to", F.sum("n_tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("age", F.row_number().over(back))
    kept = F.when(F.col("up_to") <= limit, F.col("n_tokens")).when(F.col("age") == 1, F.lit(limit).cast("long"))
    return rows.withColumn("kept_tokens", kept).where("kept_tokens is not null").select("game", "event_idx", "kept_tokens")


#: Kinds of log rows that hold a public speech.
SPEECHES = ("speech", "speech_pk")


def visible(log: DataFrame, observer: Column) -> DataFrame:
    """Log rows whose ``viewer`` array has the observer."""
    return log.where(F.array_contains("viewer", observer))


def speeches(log: DataFrame) -> DataFrame:
    return log.where(F.col("event").isin(*SPEECHES))


def public_votes(ballots: DataFrame) -> DataFrame:
    """For each round the votes (voter, target) in the order of voters; target 0 is null."""
    vote = F.struct("voter", F.when(F.col("target") != 0, F.col("target")).alias("target"))
    return ballots.groupBy("round").agg(F.array_sort(F.collect_list(vote)).alias("votes"))  # seven voters


def public_state(log: DataFrame) -> DataFrame:
    """What everybody knows of each game (game, day, event, players): the present day, exiles so far with their day, the last night with its day and its dead (null if there was none), and who is alive.

    ``players`` are those that a row of event ``end_vote`` or ``end_night`` takes out; a game has seven at most.
    """
    day = F.max("day").over(Window.partitionBy("game"))
    rows = log.withColumn("__now", day)
    exiles = F.array_sort(F.flatten(F.collect_list(F.when(F.col("event") == "end_vote", F.transform("players", lambda p: F.struct(F.col("day"), p.alias("player")))))))
    last = (F.col("event") == "end_night") & (F.col("day") == F.col("__now") - 1) & F.col("players").isNotNull()
    night = F.max_by(F.when(last, F.struct("day", F.col("players").alias("dead"))), F.when(last, F.col("log_idx")))
    out = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("event").isin("end_vote", "end_night"), F.col("players")))))
    everyone = F.sequence(F.lit(1), F.lit(7))
    return rows.groupBy("game").agg(F.max("day").alias("__day"), exiles.alias("prior_exiles"), night.alias("last_night"), F.array_except(everyone, out).alias("alive")).withColumnRenamed("__day", "day")


def legal_actions(state: DataFrame) -> DataFrame:
    """``legal``: what the actor of each row may do, as (action, target) with target 0 for nothing.

    Columns: phase, actor, alive, wolves, checked (by the seer), last_guard, poison_used, heal_used, victim (0 or null: none), suggestible, pk_pool.
    """
    alive = F.col("alive")
    none = F.lit(0)

    def acts(name: str, targets: Column) -> Column:
        return F.transform(F.concat(F.array(none), targets.cast("array<int>")), lambda t: F.struct(F.lit(name).alias("action"), t.alias("target")))

    one = lambda name, target: F.array(F.struct(F.lit(name).alias("action"), target.cast("int").alias("target")))
    no = F.array().cast("array<struct<action:string,target:int>>")
    poison = F.when(F.coalesce("poison_used", F.lit(False)), no).otherwise(F.transform(alive, lambda t: F.struct(F.lit("witch_poison").alias("action"), t.cast("int").alias("target"))))
    heal = F.when(F.coalesce("heal_used", F.lit(False)) | (F.coalesce("victim", F.lit(0)) == 0), no).otherwise(one("witch_heal", F.col("victim")))
    legal = (
        F.when(F.col("phase") == "skill_wolf", acts("kill", F.array_except(alive, F.col("wolves")))).when(F.col("phase") == "skill_seer", acts("check", F.array_except(alive, F.col("checked"))))
        .when(F.col("phase") == "skill_guard", F.filter(acts("guard", alive), lambda a: (a["target"] == 0) & F.col("last_guard").isNull() | ~F.coalesce(a["target"] == F.col("last_guard"), F.lit(False))))
        .when(F.col("phase") == "skill_witch", F.concat(one("witch_pass", none), poison, heal)).when(F.col("phase") == "vote", acts("vote", F.col("suggestible")))
        .when(F.col("phase") == "vote_pk", acts("vote_pk", F.filter("pk_pool", lambda p: p != F.col("actor")))).when(F.col("phase").isin(*SPEECHES), F.array(F.struct(F.col("phase").alias("action"), none.alias("target"))))
    )
    return state.withColumn("legal", F.coalesce(legal.cast("array<struct<action:string,target:int>>"), no))


def rendered(log: DataFrame) -> DataFrame:
    """The log of each game as text, a line for each row in order: ``day 1 night | event | players``; one game's log is short by nature."""
    line = F.format_string("day %d %s | %s | %s", F.col("day").cast("int"), F.when(F.col("is_night"), "night").otherwise("day"), F.col("event"), F.coalesce(F.array_join(F.col("players").cast("array<string>"), ","), F.lit("-")))
    return log.groupBy("game").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("log_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
