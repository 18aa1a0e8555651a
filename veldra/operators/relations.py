"""Checks and joins between tables: assignments, overlaps, homogeneity, duplicates, contamination, role tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions.domain import ACTIONS, PLAYERS


def assigned(rows: DataFrame, manifest: DataFrame, key: str = "game_id") -> DataFrame:
    """Rows whose group the manifest (key, split) assigns, with the split; the rest is left out (see ``splits.unknown``)."""
    return rows.join(manifest.select(key, "split"), key)


def overlapping(left: DataFrame, right: DataFrame, key: str = "game_id") -> DataFrame:
    """Groups that stand on both sides (training and evaluation must have none)."""
    return left.select(key).intersect(right.select(key))


def united(*tables: DataFrame) -> DataFrame:
    """Distinct rows of all tables together."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def uncovered(all_groups: DataFrame, assignments: DataFrame, key: str = "game_id") -> DataFrame:
    """Groups without an assignment, and assigned ones that do not exist, with the ``side`` that has them."""
    missing = all_groups.select(key).distinct().join(assignments, key, "left_anti").withColumn("side", F.lit("unassigned"))
    extra = assignments.select(key).distinct().join(all_groups, key, "left_anti").withColumn("side", F.lit("nonexistent"))
    return missing.unionByName(extra)


def misaligned_maps(rows: DataFrame, observers: str, maps: list[str]) -> DataFrame:
    """Rows with ``misaligned``, the names of the maps whose keys are not exactly the observers (numbers) by canonical name."""
    names = F.array_sort(F.transform(observers, lambda x: F.get(F.array(*map(F.lit, PLAYERS)), (x - 1).cast("int"))))
    bad = [F.when(~F.coalesce(F.array_sort(F.map_keys(m)) == names, F.lit(False)), m) for m in maps]
    return rows.withColumn("misaligned", F.array_compact(F.array(*bad)))


def homogeneous(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: how many different values the ``fields`` have together, and whether it is one at most. Nulls are a value."""
    one = F.count_distinct(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return rows.agg(one.alias("n_values")).withColumn("homogeneous", F.col("n_values") <= 1)


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exact numbers of different values of each column, null left out."""
    return rows.agg(*[F.count_distinct(c).alias(c) for c in columns])


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str], what: str) -> None:
    """Fail with the first few keys that stand in more than one row."""
    found = [tuple(r) for r in duplicates(rows, keys).orderBy(*keys).limit(10).collect()]
    if found:
        raise ValueError(f"{what}: {found}")


def contaminated(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """Reports whose ``nonce`` or ``response`` comes back in the same actor's next request (game, actor, seq, text).

    One sort by (game, actor): each report is a row among the requests, and
    what follows it is the nearest request behind.
    """
    left = reports.select("game", "actor", "seq", "nonce", "response", F.lit(None).cast("string").alias("text"))
    right = requests.select("game", "actor", "seq", F.lit(None).cast("string").alias("nonce"), F.lit(None).cast("string").alias("response"), F.col("text"))
    after = Window.partitionBy("game", "actor").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = left.unionByName(right).withColumn("following", F.first("text", ignorenulls=True).over(after)).where("text is null and following is not null")
    has = lambda c: F.coalesce((F.col(c) != "") & F.contains("following", F.col(c)), F.lit(False))
    return rows.withColumn("nonce_leaks", has("nonce")).withColumn("response_leaks", has("response")).where("nonce_leaks or response_leaks").select("game", "actor", "seq", "nonce_leaks", "response_leaks")


def role_faults(roles: DataFrame, due: dict[str, int]) -> DataFrame:
    """game, role, n and due of the roles whose number in a game (game, role) is not what the setup asks for."""
    want = F.create_map(*[F.lit(x) for pair in due.items() for x in pair])
    have = roles.groupBy("game").agg(F.collect_list("role").alias("all"))  # seven roles at most
    names = F.array_distinct(F.concat(F.array(*map(F.lit, due)), "all"))
    each = have.select("game", F.explode(names).alias("role"), "all").select("game", "role", F.size(F.filter("all", lambda r: r == F.col("role"))).alias("n"), F.coalesce(want[F.col("role")], F.lit(0)).alias("due"))
    return each.where("n <> due")


def bad_weights(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose sampling weights (column ``weight``) are not all at least 0 (and known), or of which none is above 0."""
    fine = F.bool_and(F.coalesce(F.col("weight") >= 0, F.lit(False))) & F.bool_or(F.coalesce(F.col("weight") > 0, F.lit(False)))
    return weights.groupBy(*keys).agg(fine.alias("fine")).where("not fine").drop("fine")


def best_epochs(losses: DataFrame, run: str = "run") -> DataFrame:
    """Epochs (run, epoch, loss) with ``is_best``: a loss below all before it; the first one wins ties."""
    before = F.min("loss").over(Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return losses.withColumn("is_best", F.coalesce(F.col("loss") < before, before.isNull() & F.col("loss").isNotNull()))


def request_label(request: Column) -> Column:
    """Kind of answer that a request (JSON text) asks for: its response format's type, ``json_schema:name`` for a named schema, ``text`` for none."""
    kind, name = F.get_json_object(request, "$.response_format.type"), F.get_json_object(request, "$.response_format.json_schema.name")
    return F.when((kind == "json_schema") & name.isNotNull(), F.concat(F.lit("json_schema:"), name)).otherwise(F.coalesce(kind, F.lit("text")))


def reparse_summary(events: DataFrame) -> DataFrame:
    """The counters of a reparse in one row, in one pass.

    ``events``: one row for each speech with ``old`` and ``new`` (arrays of
    subject, action, object; null is none), ``called`` (whether a parser was
    asked) and ``failed``. An action is invalid if one of its parts is no
    canonical name. Coverages are 0 without speeches.
    """
    none = F.array().cast("array<struct<subject:string,action:string,object:string>>")
    old, new = (F.coalesce(F.col(c), none) for c in ("old", "new"))
    names = lambda c, where: F.coalesce(c.isin(*where), F.lit(False))
    invalid = lambda acts: F.size(F.filter(acts, lambda a: ~(names(a["subject"], PLAYERS) & names(a["action"], ACTIONS) & names(a["object"], PLAYERS))))
    some_old, some_new, same = F.size(old) > 0, F.size(new) > 0, old == new
    n = F.count("*")
    share = lambda test: F.coalesce(F.count_if(test) / n, F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return events.agg(
        n.alias("speeches"), F.count_if(F.col("called")).alias("parser_calls"), F.count_if(F.col("failed")).alias("parser_errors"), F.count_if(some_old).alias("old_nonempty"), F.count_if(some_new).alias("new_nonempty"), share(some_old).alias("old_coverage"), share(some_new).alias("new_coverage"),
        total(F.size(old)).alias("old_actions"), total(F.size(new)).alias("new_actions"), F.count_if(~same).alias("changed"), F.count_if(same).alias("identical"), F.count_if(~some_old & some_new).alias("gained"), F.count_if(some_old & ~some_new).alias("lost"), total(invalid(old)).alias("invalid_old"), total(invalid(new)).alias("invalid_new"),
    )


def action_counts(events: DataFrame) -> DataFrame:
    """action, old and new: how often each action stands among the old and the new ones of a reparse."""
    sides = []
    for c in ("old", "new"):
        sides.append(events.select(F.explode(c).alias("a")).select(F.col("a.action").alias("action"), F.lit(c).alias("side")))
    return sides[0].unionByName(sides[1]).groupBy("action").agg(F.count_if(F.col("side") == "old").alias("old"), F.count_if(F.col("side") == "new").alias("new"))
