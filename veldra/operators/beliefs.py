"""Suspicions as distributions over the 21 pairs: projection, marginals, metrics, audits.

Everything about one report is computed inside its row; only statistics over
many reports are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions.domain import N_PLAYERS, PAIRS, let
from veldra.operators.quantiles import counted_values, quantiles, with_quantiles
from veldra.operators.snapshots import compatible, player_bits, turned

_UNIFORM = 1 / len(PAIRS)
#: Reports whose pairs are compared, or targets that are summed up, in one task (about).
REPORTS_PER_TASK = 20_000


def _tasks(reports: DataFrame) -> int:
    """How many tasks the reports (or targets) ask for; a count of what a file holds reads no rows."""
    return max(reports.sparkSession.sparkContext.defaultParallelism, math.ceil(reports.count() / REPORTS_PER_TASK))


def distribution(known: Column, cleared: Column, suspected: Column) -> Column:
    """Array of (a, b, p): each pair that the knowledge allows with 2 to the number of its soft suspects, normalised."""
    def weighed(x: Column) -> Column:
        soft = lambda i: F.call_function("getbit", x["soft"], i - 1)
        return F.transform(x["pairs"], lambda p: F.struct(p[0].alias("a"), p[1].alias("b"), F.pow(F.lit(2.0), soft(p[0]) + soft(p[1])).alias("w")))

    # both once for a row, not once for a pair
    given = F.struct(compatible(known, cleared).alias("pairs"), player_bits(suspected).bitwiseAND(F.bitwise_not(player_bits(known))).alias("soft"))
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x["w"])
    return let(let(given, weighed), lambda d: let(total(d), lambda t: F.transform(d, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), (x["w"] / t).alias("p")))))


def targets(reports: DataFrame) -> DataFrame:
    """Each report (arrays ``known``, ``cleared``, ``suspected``) with every pair that its knowledge allows (a, b) and its probability p: 21 rows at most for each."""
    each = reports.withColumn("__d", F.explode(distribution(F.col("known"), F.col("cleared"), F.col("suspected"))))
    return each.select(*reports.columns, "__d.a", "__d.b", "__d.p")


def vector(dist: Column) -> Column:
    """The 21 probabilities in the order of all pairs, 0 for those that are not allowed."""
    sides = lambda d: F.struct(F.transform(d, lambda x: x["a"] * 8 + x["b"]).alias("pairs"), F.transform(d, lambda x: x["p"]).alias("p"))
    at = lambda s, a, b: F.coalesce(F.get(s["p"], (F.array_position(s["pairs"], a * 8 + b) - 1).cast("int")), F.lit(0.0))
    return let(let(dist, sides), lambda s: F.array(*[at(s, a, b) for a, b in PAIRS]))


def player_marginals(p: Column) -> Column:
    """Probability that each of the seven players is in the pair, from the 21 of the pairs (they sum up to 2)."""
    return let(p, lambda q: F.array(*[reduce(lambda x, y: x + y, [q[i] for i, pair in enumerate(PAIRS) if k in pair]) for k in range(1, N_PLAYERS + 1)]))


def marginals(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, player and marginal, for the players that some allowed pair holds."""
    numbers = F.sequence(F.lit(1), F.lit(N_PLAYERS))
    of = lambda k: F.aggregate(F.filter("__d", lambda x: (x["a"] == k) | (x["b"] == k)), F.lit(0.0), lambda s, x: s + x["p"])
    rows = reports.withColumn("__d", distribution(F.col("known"), F.col("cleared"), F.col("suspected")))
    each = rows.select(*keys, F.explode(F.transform(numbers, lambda k: F.struct(k.alias("player"), of(k).alias("marginal")))).alias("m"))
    return each.select(*keys, "m.player", "m.marginal").where("marginal > 0")


def most_suspected(reports: DataFrame) -> DataFrame:
    """Reports with each player whose marginal is as good as the largest (relative 1e-5, absolute 1e-8)."""
    m = let(player_marginals(vector(distribution(F.col("known"), F.col("cleared"), F.col("suspected")))), lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda x, i: F.when(F.abs(x - top) <= 1e-8 + 1e-5 * top, i + 1))))
    return reports.withColumn("player", F.explode(F.array_compact(m)))


def log_softmax(logits: Column) -> Column:
    """Stable log-softmax of an array."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(logits, lambda x: x - top - F.log(total))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def entropy(p: Column) -> Column:
    """Entropy of an array of probabilities, in natural units."""
    return -_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def margin(p: Column) -> Column:
    """What the largest value is ahead of the second."""
    return let(F.sort_array(p, asc=False), lambda top: top[0] - top[1])


def spread(values: Column) -> Column:
    return let(values, lambda v: F.array_max(v) - F.array_min(v))


def row_metrics(rows: DataFrame, observer: str | None = None) -> DataFrame:
    """Adds what arrays ``logits`` and ``target`` (both of 21) have in common and apart.

    q, cross_entropy, kl, tv, entropy, margin, marginal_mae, row_sum_error,
    predicted_spread, target_spread, target_entropy, target_margin and, with an
    ``observer`` (a player's number), the marginals of the observer itself.
    """
    rows = rows.withColumn("__lp", log_softmax(F.col("logits"))).withColumn("q", F.transform("__lp", F.exp))
    rows = rows.withColumn("__qm", player_marginals(F.col("q"))).withColumn("__tm", player_marginals(F.col("target")))
    ce = -_sum(F.zip_with("target", "__lp", lambda t, l: t * l))
    new = {
        "cross_entropy": ce, "kl": ce - entropy(F.col("target")), "tv": 0.5 * _sum(F.zip_with("target", "q", lambda t, q: F.abs(t - q))), "entropy": -_sum(F.zip_with("q", "__lp", lambda q, l: q * l)),
        "margin": margin(F.col("q")), "marginal_mae": _sum(F.zip_with("__qm", "__tm", lambda x, y: F.abs(x - y))) / N_PLAYERS, "row_sum_error": F.abs(_sum(F.col("__qm")) - 2),
        "predicted_spread": spread(F.col("__qm")), "target_spread": spread(F.col("__tm")), "target_entropy": entropy(F.col("target")), "target_margin": margin(F.col("target")),
    }
    if observer:
        new |= {f"{name}_diagonal": F.get(F.col(c), (F.col(observer) - 1).cast("int")) for name, c in (("predicted", "__qm"), ("target", "__tm"))}
    return rows.withColumns(new).drop("__lp", "__qm", "__tm")


def target_fault(target: Column, valid: Column) -> Column:
    """What makes a target (21 probabilities) unfit for a loss: null, size, not_finite, negative, sum; of a row that is not ``valid``: not_zero. Null if nothing does."""
    finite = F.forall(target, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    fault = F.when(target.isNull(), "null").when(F.size(target) != len(PAIRS), "size").when(~finite, "not_finite").when(F.exists(target, lambda x: x < 0), "negative")
    return fault.when(~F.coalesce(valid, F.lit(False)) & F.exists(target, lambda x: x != 0), "not_zero").when(F.coalesce(valid, F.lit(False)) & (F.abs(_sum(target) - 1) > 1e-6 + 1e-5), "sum")


def target_rows(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Seven rows for each snapshot: observer 1 to 7, ``valid`` and ``target`` (all zero where there is no available decision)."""
    rows = decided.where("kind <> 'unavailable'").withColumn("target", vector(distribution(F.col("known"), F.col("cleared"), F.col("target"))))
    seats = decided.select(*keys).distinct().withColumn("observer", F.explode(F.sequence(F.lit(1), F.lit(N_PLAYERS))))
    out = seats.join(rows.select(*keys, "observer", "target"), [*keys, "observer"], "left")
    return out.withColumn("valid", F.col("target").isNotNull()).withColumn("target", F.coalesce("target", F.array_repeat(F.lit(0.0), len(PAIRS))))


def effective(valid: Column, observer: Column, speaker: Column) -> Column:
    """Valid rows of observers other than the one who speaks next."""
    return F.coalesce(valid & (observer != speaker), F.lit(False))


def eligible(rows: DataFrame, snapshot: str) -> DataFrame:
    """Snapshots at a speech boundary with an effective row (columns boundary, valid, observer, speaker)."""
    fit = F.col("boundary") & effective(F.col("valid"), F.col("observer"), F.col("speaker"))
    return rows.where(fit).select(snapshot).distinct()


def summaries(values: DataFrame, keys: list[str]) -> DataFrame:
    """count, min, mean, median (exact) and max of ``value`` by ``keys``, 0 where a group has none."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    counted = counted_values(values, keys, "value")
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("__times"))
    mean = F.try_divide(F.sum(v * F.col("__times")), F.sum(n))
    out = counted.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias("count"), zero(F.min(v)).alias("min"), zero(mean).alias("mean"), zero(F.max(v)).alias("max"))
    return with_quantiles(out, quantiles(counted, keys, "value", {"median": 0.5}, times="__times"), keys).withColumn("median", zero(F.col("median")))


def audit_values(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Distribution of each statistic of the targets, over all rows and by ``groups``, for all valid rows and the supervised ones.

    ``rows``: snapshot, groups, observer, speaker, boundary, valid, target (21).
    Pairwise differences are means of each snapshot with two such rows or more.
    Groups of the summary over all are null.
    """
    valid = rows.where("valid").withColumn("supervised", F.coalesce("boundary", F.lit(False)) & effective(F.col("valid"), F.col("observer"), F.col("speaker")))
    # one shuffle by snapshot for all that follows, over as many tasks as the rows ask for
    valid = valid.select("snapshot", *groups, "supervised", "target").repartition(_tasks(rows), "snapshot")
    stats = lambda t: {
        "pair_entropy": entropy(t), "max_probability": F.array_max(t), "top1_top2_margin": margin(t), "tv_from_uniform": 0.5 * _sum(F.transform(t, lambda x: F.abs(x - _UNIFORM))),
        "entropy_gap_from_uniform": F.log(F.lit(float(len(PAIRS)))) - entropy(t), "marginal_spread": spread(player_marginals(t)),
    }
    long = valid.select("snapshot", *groups, "supervised", F.explode(let(F.col("target"), lambda t: F.array(*[F.struct(F.lit(n).alias("statistic"), v.alias("value")) for n, v in stats(t).items()]))).alias("s")).select(*groups, "supervised", "s.*")
    # seven observers at most in each snapshot
    seats = valid.groupBy("snapshot", *groups).agg(F.collect_list(F.struct("supervised", "target")).alias("all"))
    both = seats.select(*groups, F.explode(F.array(*[F.struct(F.lit(s).alias("supervised"), (F.filter("all", lambda x: x["supervised"]) if s else F.col("all")).alias("seats")) for s in (False, True)])).alias("x")).select(*groups, "x.*").where("size(seats) > 1")
    tv = lambda x, y: 0.5 * _sum(F.zip_with(x["target"], y["target"], lambda p, q: F.abs(p - q)))
    pairs = F.flatten(F.transform("seats", lambda x, i: F.transform(F.slice("seats", i + 2, F.size("seats")), lambda y: tv(x, y))))
    pairwise = both.select(*groups, "supervised", F.lit("observer_pairwise_tv").alias("statistic"), let(pairs, lambda all: _sum(all) / F.size(all)).alias("value"))
    scope = F.explode(F.when(F.col("supervised"), F.array(F.lit("all"), F.lit("supervised"))).otherwise(F.array(F.lit("all"))))
    values = long.withColumn("scope", scope).drop("supervised").unionByName(pairwise.withColumn("scope", F.when(F.col("supervised"), "supervised").otherwise("all")).drop("supervised"))
    # each value counts for its group and for all
    values = values.withColumn("__all", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({g: F.when(~F.col("__all"), F.col(g)) for g in groups})
    return summaries(values, ["__all", "scope", "statistic", *groups]).drop("__all")


def audit_counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Numbers of snapshots and rows, over all and by ``groups``: snapshots, boundaries, supervised ones and their share, valid and supervised rows, how many of these each snapshot has."""
    sup = F.coalesce("boundary", F.lit(False)) & effective(F.col("valid"), F.col("observer"), F.col("speaker"))
    per = rows.groupBy("snapshot", *groups).agg(F.count_if("valid").alias("v"), F.count_if(sup).alias("s"), F.bool_or(F.coalesce("boundary", F.lit(False))).alias("boundary"))
    out = per.groupingSets([[], [F.col(g) for g in groups]], *groups).agg(
        F.count("*").alias("snapshots"), F.count_if("boundary").alias("boundaries"), F.count_if(F.col("s") > 0).alias("supervised_snapshots"), F.sum("v").alias("valid_rows"), F.sum("s").alias("supervised_rows"),
        *[F.count_if(F.col("s") == k).alias(f"with_{k}") for k in range(N_PLAYERS + 1)],
    )
    out = out.withColumn("non_boundaries", F.col("snapshots") - F.col("boundaries")).withColumn("filtered_snapshots", F.col("snapshots") - F.col("supervised_snapshots"))
    return out.withColumn("boundary_fraction", F.col("boundaries") / F.col("snapshots")).withColumn("supervised_fraction", F.col("supervised_snapshots") / F.col("snapshots"))


def _player_sums(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, player and what ``audit_players`` shows of it, as sums: supervised_rows, marginals, their number n, top_count."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    sup = F.coalesce("boundary", F.lit(False)) & effective(F.col("valid"), F.col("observer"), F.col("speaker"))
    m = F.when(valid, player_marginals(F.col("target")))
    top = let(F.array_max(F.col("__m")), lambda t: F.transform("__m", lambda x: F.abs(x - t) <= 1e-8 + 1e-5 * F.abs(t)))
    seats = F.transform(F.sequence(F.lit(1), F.lit(N_PLAYERS)), lambda k: F.struct(k.alias("player"), F.get("__m", k - 1).alias("marginal"), F.coalesce(F.get("__top", k - 1), F.lit(False)).alias("top"), (F.col("__sup") & (F.col("observer") == k)).alias("sup")))
    each = rows.withColumn("__m", m).withColumn("__top", F.when(F.col("__m").isNotNull(), top)).withColumn("__sup", sup).select(*groups, F.explode(seats).alias("s")).select(*groups, "s.*")
    return each.groupBy(*groups, "player").agg(F.count_if("sup").alias("supervised_rows"), F.sum("marginal").alias("marginals"), F.count("marginal").alias("n"), F.count_if("top").alias("top_count"))


def _with_gap(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of the same ``keys`` and player together, their means and the gap between these."""
    out = sums.groupBy(*keys, "player").agg(F.sum("supervised_rows").alias("supervised_rows"), F.coalesce(F.try_divide(F.sum("marginals"), F.sum("n")), F.lit(0.0)).alias("mean_marginal"), F.sum("top_count").alias("top_count"))
    by = Window.partitionBy(*keys)  # seven rows
    return out.withColumn("gap", F.max("mean_marginal").over(by) - F.min("mean_marginal").over(by))


def audit_players(rows: DataFrame, groups: list[str]) -> DataFrame:
    """By player, over all and by ``groups``: supervised rows of the player as observer, mean target marginal, how often it is among the most suspected (ties count for each), and the ``gap`` between the largest and least mean of its group.

    Columns as in ``audit_values``; groups of the summary over all are null. A
    group without a valid row has means 0.
    """
    sums = _player_sums(rows, groups)  # seven for each group; these, not the rows, count for the group and for all
    sums = sums.withColumn("__all", F.explode(F.array(F.lit(False), F.lit(True)) if groups else F.array(F.lit(True)))).withColumns({g: F.when(~F.col("__all"), F.col(g)) for g in groups})
    return _with_gap(sums, ["__all", *groups]).drop("__all")


def turned_targets(rows: DataFrame, shift: Column) -> DataFrame:
    """Rows of targets (observer, speaker, target of 21) with all players ``shift`` seats on."""
    place = {pair: i for i, pair in enumerate(PAIRS)}
    # for each shift, where the probability of each pair comes from
    origin = [[place[tuple(sorted((x - 1 - s) % N_PLAYERS + 1 for x in pair))] for pair in PAIRS] for s in range(N_PLAYERS)]
    table = F.array(*[F.array(*map(F.lit, o)) for o in origin])
    of = F.get(table, F.pmod(shift, F.lit(N_PLAYERS)).cast("int"))
    return rows.withColumns({"observer": turned(F.col("observer"), shift), "speaker": turned(F.col("speaker"), shift), "target": F.when(F.col("target").isNotNull(), F.transform(of, lambda i: F.get("target", i)))})


def audit_orbit(rows: DataFrame) -> DataFrame:
    """``audit_players`` over the seven turns of every row; each turn is a snapshot of its own.

    A turn moves what is found of a player to another one, so only the seven sums are turned.
    """
    sums = _player_sums(turned_targets(rows, F.lit(0)), [])
    turns = sums.withColumn("__shift", F.explode(F.sequence(F.lit(0), F.lit(N_PLAYERS - 1)))).withColumn("player", turned(F.col("player"), F.col("__shift")))
    return _with_gap(turns.withColumn("__all", F.lit(True)), ["__all"]).drop("__all")


def require_coverage(counts: DataFrame, least: float = 0.05) -> None:
    """Fail if fewer snapshots than ``least`` are supervised, over all; ``counts`` as ``audit_counts`` gives them."""
    low = counts.where(F.col("supervised_fraction") < least).agg(F.min("supervised_fraction")).first()[0]
    if low is not None:
        raise ValueError(f"only {low:.6f} of the snapshots are supervised")


def weighted_means(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Mean of each value by weight; rows of weight 0 and null values do not count; 0 where nothing does."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))
    return rows.groupBy(*keys).agg(*[mean(c).alias(c) for c in values])


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean where the mask holds, 0 where it never does."""
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def observer_tv(rows: DataFrame, snapshot: str, observer: str, q: str = "q") -> DataFrame:
    """Mean total variation between the observers of a snapshot, for snapshots with two or more (at most 21 pairs of 7 observers)."""
    a = rows.select(snapshot, F.col(observer).alias("o1"), F.col(q).alias("q1"))
    b = rows.select(snapshot, F.col(observer).alias("o2"), F.col(q).alias("q2"))
    tv = 0.5 * _sum(F.zip_with("q1", "q2", lambda x, y: F.abs(x - y)))
    return a.join(b, snapshot).where("o1 < o2").groupBy(snapshot).agg(F.avg(tv).alias("pairwise_tv"))


def tampered(stored: DataFrame, reports: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Pairs whose ``stored`` probability (keys, a, b, p) is not what the report gives: missing, of no legal pair, null, or off by more than ``tolerance``.

    Probability 0 may be stored or left out for a pair that is not legal. Rows
    stored twice are counted in ``n_stored`` and are wrong even if equal. A
    report that is given twice is one; if its two forms differ, one is missed.
    A row with a null key belongs to no report.
    """
    no = lambda name, kind: F.lit(None).cast(kind).alias(name)
    due = targets(reports).select(*keys, "a", "b", F.col("p").alias("due"), no("p", "double"), F.lit(0).cast("long").alias("stored"))
    have = stored.select(*keys, "a", "b", no("due", "double"), F.col("p").cast("double").alias("p"), F.lit(1).cast("long").alias("stored"))
    # one shuffle by report, over as many tasks as the reports ask for; what a task holds does not grow with the table
    nameless = F.when(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]), F.col("stored"))
    both = have.unionByName(due).repartition(_tasks(reports), *keys).groupBy(*keys, "a", "b", nameless.alias("__nameless"))
    out = both.agg(F.min("due").alias("__least"), F.max("due").alias("due"), F.min("p").alias("low"), F.max("p").alias("high"), F.sum("stored").alias("n_stored"), F.count("p").alias("n_known"))
    near = lambda c: F.abs(F.col("low") - F.coalesce(c, F.lit(0.0))) <= tolerance
    right = (F.col("n_stored") == 1) & (F.col("n_known") == 1) & near("__least") & near("due")
    return out.where(~F.coalesce(right, F.lit(False))).select(*keys, "a", "b", F.when(near("due"), F.col("__least")).otherwise(F.col("due")).alias("due"), "low", "high", "n_stored")
