"""Report quality: counters, streaks, running rates, the first stop, call audits and budgets.

A null status is a failure of its own kind (``missing``); reports without a
``seq`` have no place in the order and are left out. Runs and totals are
computed by block of ``seq`` and carried over from block to block, so neither
one observer nor the whole batch is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.operators.quantiles import quantiles, with_quantiles

#: Limits of the monitor.
STREAK, OBSERVER_LEAST, OBSERVER_RATE, TOTAL_LEAST, TOTAL_RATE, PARSE_RATE = 3, 10, 0.20, 100, 0.05, 0.01
#: Calls of a game that its budget allows.
BUDGET = {"gameplay": 192, "belief": 448, "total": 640}
#: Rows of a block, and most blocks (beyond, blocks grow).
BLOCK_ROWS, MAX_BLOCKS = 200_000, 10_000


def _failed() -> Column:
    return F.col("status") != "ok"


def _blocked(reports: DataFrame, blocks: int | None) -> DataFrame:
    """Reports with a place, their ``block`` by even shares of all rows in order of ``seq``, and no null status.

    The cuts between blocks, ``MAX_BLOCKS`` at most, are a constant of the plan
    that every use of it shares; a row finds its block by halving.
    """
    rows = reports.where("seq is not null").withColumn("status", F.coalesce("status", F.lit("missing")))
    blocks = blocks or max(1, -(-rows.count() // BLOCK_ROWS))
    if blocks == 1:
        return rows.withColumn("block", F.lit(0))
    blocks = min(blocks, MAX_BLOCKS)
    cuts = rows.agg(F.percentile_approx("seq", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] or []
    constant = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    below = lambda at, step: F.coalesce(F.get(constant, at + step - 1) < F.col("seq"), F.lit(False))
    return rows.withColumn("block", F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at)))


def counters(reports: DataFrame) -> DataFrame:
    """Counts overall, by status, observer, observer and status, game and phase, and these and status, in one pass, with the shares of failures and parse errors of each."""
    names = ("game", "phase", "observer", "status")
    sets = [[], ["status"], ["observer"], ["observer", "status"], ["game", "phase"], ["game", "phase", "status"]]
    rows = reports.withColumn("status", F.coalesce("status", F.lit("missing"))).select(*names, _failed().alias("__bad"), (F.col("status") == "parse_error").alias("__parse"))
    n = F.count("*")
    return rows.groupingSets(sets, *names).agg(n.alias("n"), (F.count_if("__bad") / n).alias("invalid_rate"), (F.count_if("__parse") / n).alias("parse_error_rate"), F.grouping_id(*names).alias("level"))


def streaks(reports: DataFrame, blocks: int | None = None) -> DataFrame:
    """Length so far of each observer's run of one error (0 for ok); runs go on across games and blocks."""
    return _streaks(_blocked(reports, blocks)).drop("block")


def _streaks(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("observer", "block").orderBy("seq")
    of = Window.partitionBy("observer", "block", "status").orderBy("seq")
    rows = rows.withColumn("__island", F.row_number().over(by) - F.row_number().over(of))
    rows = rows.withColumn("__run", F.row_number().over(Window.partitionBy("observer", "block", "status", "__island").orderBy("seq")))
    # one row for each observer and block: its last run, and whether it is all of it
    ends = rows.groupBy("observer", "block").agg(F.count("*").alias("n"), F.max_by(F.struct("status", F.col("__run").cast("long").alias("run")), "seq").alias("end"))
    order = Window.partitionBy("observer").orderBy("block")
    ends = ends.withColumn("new", F.when((F.col("end.run") == F.col("n")) & (F.col("end.status") == F.lag("end.status").over(order)), 0).otherwise(1))
    ends = ends.withColumn("chain", F.sum("new").over(order))
    ends = ends.withColumn("out", F.sum("end.run").over(Window.partitionBy("observer", "chain").orderBy("block")))
    carried = ends.select("observer", "block", F.lag("end.status").over(order).alias("__status"), F.lag("out").over(order).alias("__carry"))
    rows = rows.join(carried, ["observer", "block"])
    # the first run of a block goes on with the last one before it
    more = F.when((F.col("__island") == 0) & (F.col("status") == F.col("__status")), F.col("__carry")).otherwise(0)
    return rows.withColumn("streak", F.when(~_failed(), 0).otherwise(F.col("__run") + more)).drop("__island", "__run", "__status", "__carry")


def _running(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds running sums of ``values`` in order of ``seq`` within ``keys``; ``rows`` have a block."""
    sums = rows.groupBy(*keys, "block").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    ahead = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "block", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__{n}") for n in values])
    here = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(before, [*keys, "block"])
    return rows.withColumns({n: F.sum(v).over(here) + F.col(f"__{n}") for n, v in values.items()}).drop(*[f"__{n}" for n in values])


def observer_rates(reports: DataFrame, blocks: int | None = None) -> DataFrame:
    """Running number of reports and share of failures of each observer."""
    return _observer_rates(_blocked(reports, blocks)).drop("block")


def _observer_rates(rows: DataFrame) -> DataFrame:
    rows = _running(rows, ["observer"], {"seen": F.lit(1), "__bad": _failed().cast("int")})
    return rows.withColumn("invalid_rate", F.col("__bad") / F.col("seen")).drop("__bad")


def total_rates(reports: DataFrame, blocks: int | None = None) -> DataFrame:
    """Running totals and shares over all reports in order of ``seq``."""
    return _total_rates(_blocked(reports, blocks)).drop("block")


def _total_rates(rows: DataFrame) -> DataFrame:
    rows = _running(rows, [], {"total": F.lit(1), "__bad": _failed().cast("int"), "__parse": (F.col("status") == "parse_error").cast("int")})
    rows = rows.withColumn("total_invalid_rate", F.col("__bad") / F.col("total")).withColumn("total_parse_rate", F.col("__parse") / F.col("total"))
    return rows.drop("__bad", "__parse")


def first_stop(reports: DataFrame, blocks: int | None = None) -> DataFrame:
    """seq and rule of the first report at which a rule fires; the first rule of the list wins."""
    rows = _total_rates(_observer_rates(_streaks(_blocked(reports, blocks))))
    rule = (
        F.when(F.col("streak") >= STREAK, "1_streak")
        .when((F.col("seen") >= OBSERVER_LEAST) & (F.col("invalid_rate") > OBSERVER_RATE), "2_observer_rate")
        .when((F.col("total") >= TOTAL_LEAST) & (F.col("total_invalid_rate") > TOTAL_RATE), "3_total_rate")
        .when((F.col("total") >= TOTAL_LEAST) & (F.col("total_parse_rate") > PARSE_RATE), "4_parse_rate")
    )
    hit = rows.withColumn("rule", rule).where("rule is not null").agg(F.min(F.struct("seq", "rule")).alias("x"))
    return hit.select("x.seq", "x.rule").where("seq is not null")


def until_stop(reports: DataFrame, sample: str = "sample", blocks: int | None = None) -> DataFrame:
    """Reports up to the first stop; the sample in which it falls is completed, later ones are cut off."""
    stop = first_stop(reports, blocks)
    last = reports.join(stop.select("seq"), "seq", "left_semi").select(sample)
    end = reports.join(last, sample, "left_semi").agg(F.max("seq").alias("__end"))  # one row
    return reports.crossJoin(F.broadcast(end)).where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__end")


def call_violations(calls: DataFrame) -> DataFrame:
    """Audit records with the names of the rules that they break: call_category, dispatch_status, latency_ms."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {"call_category": no(F.col("category").isin("gameplay", "belief")), "dispatch_status": no(F.col("dispatch").isin("ok", "error")), "latency_ms": F.col("latency_ms").isNull() | F.isnan(F.col("latency_ms").cast("double"))}
    return calls.withColumn("violations", F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()])))


def call_audit(calls: DataFrame) -> DataFrame:
    """Counts, token sums and latency statistics by category and (category null) over all calls: interpolated median, nearest-rank 95th percentile, both exact."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens") if c in calls.columns]
    usage = [F.count_if("usage_available").alias("usage_available")] if "usage_available" in calls.columns else []
    # each call counts for its category and for all
    rows = calls.withColumn("__all", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("category", F.when(~F.col("__all"), F.col("category")))
    out = rows.groupBy("__all", "category").agg(F.count("*").alias("calls"), F.count_if(F.col("dispatch") == "error").alias("errors"), *usage, *tokens, F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))
    return with_quantiles(out, quantiles(rows, ["__all", "category"], "latency_ms", {"median_ms": 0.5}, {"p95_ms": 0.95}), ["__all", "category"]).drop("__all")


def refused(calls: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """game, seq and budget of the first call of each game that one of its budgets (by category, and ``total``) does not allow; the earliest one stops the game."""
    order = Window.partitionBy("game").orderBy("seq")
    of = Window.partitionBy("game", "category").orderBy("seq")
    rows = calls.withColumn("__total", F.row_number().over(order)).withColumn("__n", F.row_number().over(of))
    over = F.lit(None).cast("string")
    for name, most in (limits or BUDGET).items():
        over = F.when(F.col("__total") > most if name == "total" else (F.col("category") == name) & (F.col("__n") > most), name).otherwise(over)
    hit = rows.withColumn("budget", over).where("budget is not null").groupBy("game").agg(F.min(F.struct("seq", "budget")).alias("x"))
    return hit.select("game", "x.seq", "x.budget")


def over_total(calls: DataFrame, most: int, blocks: int | None = None) -> DataFrame:
    """The first call of all games together that is beyond ``most``."""
    rows = _running(_blocked(calls.withColumn("status", F.lit("ok")), blocks), [], {"__total": F.lit(1)})
    return rows.where(F.col("__total") == most + 1).select("game", "seq", F.col("__total").alias("n"))


def run_summaries(calls: DataFrame, finished: DataFrame) -> DataFrame:
    """Each game's calls by category, in all and failed, and its state: completed (in ``finished``), else partial."""
    n = lambda c: F.count_if(F.col("category") == c).alias(c)
    out = calls.groupBy("game").agg(n("gameplay"), n("belief"), F.count("*").alias("total"), F.count_if(F.col("dispatch") == "error").alias("failed"))
    done = finished.select("game").distinct().withColumn("__done", F.lit(True))
    return out.join(done, "game", "left").withColumn("state", F.when(F.col("__done"), "completed").otherwise("partial")).drop("__done")
