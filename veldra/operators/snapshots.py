"""Snapshots of what observers suspect: checks, decisions, training rows of both orders, rotations, hard knowledge.

A report is one row for each snapshot and observer, with ``status``,
``known``, ``cleared`` and ``suspected`` (arrays of player numbers). Nulls in
``known`` and ``cleared`` count as empty; a null status is no ``ok``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veldra.functions.domain import N_PLAYERS, PAIRS, STATUSES, canonical_json, digest, let, phase_parts

#: Players of each set of bits (player i is bit i - 1), pairs by their bits, and the pairs that such a set leaves when its players are known, or cleared: one bit for each pair.
_SETS = [[x + 1 for x in range(N_PLAYERS) if bits >> x & 1] for bits in range(1 << N_PLAYERS)]
_PAIR_BITS = [1 << a - 1 | 1 << b - 1 for a, b in PAIRS]
_HOLDING = [sum(1 << i for i, p in enumerate(_PAIR_BITS) if bits & ~p == 0) for bits in range(1 << N_PLAYERS)]
_POWERS = [0] + [1 << x for x in range(N_PLAYERS)]
_SPARING = [sum(1 << i for i, p in enumerate(_PAIR_BITS) if bits & p == 0) for bits in range(1 << N_PLAYERS)]


def _empty() -> Column:
    return F.array().cast("array<int>")


def _table(values: list) -> Column:
    """A constant array, of numbers or of arrays of numbers."""
    shown = lambda v: f"array({', '.join(map(shown, v))})" if isinstance(v, list) else str(v)
    none = "CAST(array() AS array<int>)"
    return F.expr(f"array({', '.join(shown(v) if v != [] else none for v in values)})")


def player_bits(players: Column) -> Column:
    """The set of the players 1 to 7 in an array, as bits; whatever else it holds does not count."""
    return reduce(lambda x, y: x + y, [F.when(F.array_contains(players, i + 1), 1 << i).otherwise(0) for i in range(N_PLAYERS)])


def compatible(known: Column, cleared: Column) -> Column:
    """Array of the pairs that hold all known players and none that is cleared."""
    everything = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in PAIRS])

    def left(k: Column, c: Column) -> Column:
        # what is no player is in no pair; a null may stand for any
        strange = (F.size(F.array_except(k, F.array(*map(F.lit, range(1, N_PLAYERS + 1))))) > 0) | F.exists(c, lambda x: x.isNull())
        return F.when(strange, 0).otherwise(F.get(_table(_HOLDING), player_bits(k)).bitwiseAND(F.get(_table(_SPARING), player_bits(c))))

    sets = F.struct(F.coalesce(known, _empty()).alias("k"), F.coalesce(cleared, _empty()).alias("c"))
    return let(let(sets, lambda x: left(x["k"], x["c"])), lambda bits: F.filter(everything, lambda _, i: F.call_function("getbit", bits, i) == 1))


def closure(pairs: Column) -> Column:
    """known and cleared: players in all of the pairs, and in none; null if there is no pair (a contradiction)."""
    state = F.struct(F.lit((1 << N_PLAYERS) - 1).alias("all"), F.lit(0).alias("some"))

    def step(s: Column, p: Column) -> Column:
        pair = F.get(_table(_POWERS), p[0]) + F.get(_table(_POWERS), p[1])
        return let(pair, lambda b: F.struct(s["all"].bitwiseAND(b).alias("all"), s["some"].bitwiseOR(b).alias("some")))

    def end(s: Column) -> Column:
        players = lambda bits: F.get(_table(_SETS), bits)
        return F.when(s["some"] > 0, F.struct(players(s["all"]).alias("known"), players(F.lit((1 << N_PLAYERS) - 1) - s["some"]).alias("cleared")))

    return F.aggregate(pairs, state, step, end)


def report_violations(reports: DataFrame) -> DataFrame:
    """Reports with ``violations``, the names of the rules that they break, in this order."""
    reports = reports.withColumn("__shut", closure(compatible(F.col("known"), F.col("cleared"))))
    shut = F.col("__shut")  # a column of its own, so that it is worked out once
    same = lambda name: F.sort_array(F.coalesce(F.col(name), _empty())) == shut[name]
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    suspected = F.coalesce("suspected", _empty())
    rules = {
        "unknown_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "contradiction": shut.isNull(),
        "not_closed": shut.isNotNull() & ~(same("known") & same("cleared")),
        "suspicion_against_status": ok != F.col("suspected").isNotNull(),
        "error_against_status": ok != F.col("error").isNull(),
        "known_not_suspected": ok & (F.size(F.array_except(F.coalesce("known", _empty()), suspected)) > 0),
        "cleared_suspected": ok & F.arrays_overlap(suspected, F.coalesce("cleared", _empty())),
    }
    return reports.withColumn("violations", F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())).drop("__shut")


def raw_samples(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each snapshot (at most seven reports each) with its observers and maps by observer; for reports without violations."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("observer", c)))).alias(c)
    return reports.groupBy(*keys).agg(F.array_sort(F.collect_list("observer")).alias("observers"), *[by(c) for c in ("status", "error", "known", "cleared", "suspected")])


def decisions(reports: DataFrame) -> DataFrame:
    """Reports with ``kind``, ``target`` and ``n_compatible``: valid reports count as they stand, nothing is guessed.

    A semantic error is replaced by hard knowledge only where that leaves one
    pair; a report from a ``public_only`` source never is.
    """
    pairs = compatible(F.col("known"), F.col("cleared"))
    ok, public = F.coalesce(F.col("status") == "ok", F.lit(False)), F.coalesce("public_only", F.lit(False))
    counted = F.when(~public & (F.col("status") == "semantic_error"), F.size(pairs))
    kind = F.when(ok, "source").when(counted == 1, "deterministic_hard_knowledge").otherwise("unavailable")
    target = F.when(ok, F.col("suspected")).when(counted == 1, pairs[0])
    return reports.withColumn("n_compatible", counted).withColumn("kind", kind).withColumn("target", target)


def first_order(decided: DataFrame) -> DataFrame:
    """The speaker's own available decision: at most one row for each snapshot."""
    return decided.where("observer = speaker and kind <> 'unavailable'")


def second_order(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots with an available observer; observers and maps hold these alone (at most seven each)."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("observer", c)))).alias(c)
    return decided.where("kind <> 'unavailable'").groupBy(*keys).agg(F.array_sort(F.collect_list("observer")).alias("observers"), by("kind"), by("target"))


def turned(player: Column, shift: Column) -> Column:
    """The player ``shift`` seats on; null and 0 (nobody) stay."""
    return F.when(player.isNull() | (player == 0), player).otherwise(F.pmod(player - 1 + shift, F.lit(N_PLAYERS)) + 1)


def rotated_rows(rows: DataFrame, shift: Column, players: tuple[str, ...] = (), seats: tuple[str, ...] = (), lists: tuple[str, ...] = (), maps: tuple[str, ...] = (), list_maps: tuple[str, ...] = (), votes: tuple[str, ...] = ()) -> DataFrame:
    """Every player number in the named columns moved by ``shift`` seats.

    ``players``: numbers; ``seats``: arrays whose order stays; ``lists``: arrays, sorted anew; ``maps``: keyed by
    player; ``list_maps``: the same with arrays as values; ``votes``: arrays of
    (voter, target), sorted anew by voter. Other columns stay; digests are to be
    taken from the result.
    """
    move = lambda x: turned(x, shift)
    each = lambda a: F.array_sort(F.transform(a, move))
    new = {c: move(F.col(c)) for c in players} | {c: each(F.col(c)) for c in lists}
    new |= {c: F.transform(F.col(c), move) for c in seats}
    new |= {c: F.transform_keys(c, lambda k, _: move(k)) for c in maps}
    new |= {c: F.transform_values(F.transform_keys(c, lambda k, _: move(k)), lambda _, v: each(v)) for c in list_maps}
    new |= {c: F.array_sort(F.transform(c, lambda v: F.struct(move(v["voter"]).alias("voter"), move(v["target"]).alias("target")))) for c in votes}
    return rows.withColumns(new)


def orbit(rows: DataFrame) -> DataFrame:
    """Each row seven times, with ``shift`` 0 to 6."""
    return rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(N_PLAYERS - 1))))


def orbit_marginals(marginals: DataFrame, key: str) -> DataFrame:
    """Mean marginal of each player over the seven rotations of all reports (``key``); equal for all where every report's sum up to 2.

    A player missing from a report counts as 0. Sums go by player first: only
    seven rows are rotated.
    """
    n = marginals.select(F.countDistinct(key).alias("n"))  # one row
    sums = marginals.groupBy("player").agg(F.sum("marginal").alias("s"))
    turns = orbit(sums).groupBy(turned(F.col("player"), F.col("shift")).alias("player")).agg(F.sum("s").alias("s"))
    return turns.crossJoin(F.broadcast(n)).select("player", (F.col("s") / F.col("n") / N_PLAYERS).alias("mean_marginal"))


def hard_knowledge(log: DataFrame, keys: list[str]) -> DataFrame:
    """What an observer knows for certain from the log that it may see: ``known``, ``cleared`` and ``n_compatible``.

    ``log``: keys, observer, identity, event, target, checked, team. A wolf
    knows its team and clears the rest; others clear themselves, a seer adds its
    checks, a witch the nightly victims. Sets of players hold seven values at
    most. A contradiction has 0 compatible pairs and null knowledge.
    """
    wolf = F.col("identity") == "Werewolf"
    checks = (F.col("identity") == "Seer") & (F.col("event") == "skill_seer")
    team = F.when(wolf & (F.col("event") == "werewolf_team_info"), F.col("team"))
    known = F.when(checks & (F.col("checked") == "bad"), F.array("target"))
    cleared = F.when(checks & (F.col("checked") == "good"), F.array("target")).when((F.col("identity") == "Witch") & (F.col("event") == "kill_decision") & (F.col("target") > 0), F.array("target"))
    own = F.when(~wolf, F.array("observer"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    facts = log.groupBy(*keys).agg(flat(F.coalesce(team, known)).alias("k"), flat(F.coalesce(F.when(wolf, F.array_except(F.sequence(F.lit(1), F.lit(N_PLAYERS)), team)), cleared)).alias("c"), flat(own).alias("o"))
    pairs = compatible(F.col("k"), F.array_union("c", "o"))
    return facts.withColumn("pairs", pairs).withColumn("shut", closure(F.col("pairs"))).select(*keys, "shut.known", "shut.cleared", F.size("pairs").alias("n_compatible"))


EVENTS = "array<struct<event_idx:long,event_type:string,phase:string,speaker:string,sp_actions:array<array<string>>>>"


def frozen(snapshots: DataFrame, triggers: tuple[str, ...]) -> DataFrame:
    """Snapshots with ``violations``, the digest of their events, their actions in order, the number of these and the label's cutoff.

    A snapshot has game_id, step_idx, phase, speaker (a number), report_trigger
    and ``events`` (see ``EVENTS``): what all observers saw before the speech,
    which must end with the speaker's turn.
    """
    last = F.try_element_at(F.filter("events", lambda e: e["event_type"] == "phase_change"), F.lit(-1))["phase"]
    end = F.try_element_at("events", F.lit(-1))
    numbered = F.forall(F.transform("events", lambda e, i: e["event_idx"] == i), lambda x: F.coalesce(x, F.lit(False)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "game_id": no(F.trim("game_id") != ""),
        "step_idx": no(F.col("step_idx") >= 0),
        "phase": phase_parts(F.col("phase")).isNull(),
        "speaker": no(F.col("speaker").between(1, N_PLAYERS)),
        "report_trigger": no(F.col("report_trigger").isin(*triggers)),
        "no_events": no(F.size("events") > 0),
        "event_idx": no(numbered),
        "not_at_turn_start": no((end["event_type"] == "turn_start") & (end["speaker"] == F.concat(F.lit("player"), F.col("speaker").cast("string")))),
        "latest_phase": no(last == F.col("phase")),
    }
    acts = F.flatten(F.transform(F.filter("events", lambda e: (e["event_type"] == "public_speech") & e["sp_actions"].isNotNull()), lambda e: e["sp_actions"]))
    out = snapshots.withColumn("violations", F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull()))
    return out.withColumns({"public_event_digest": digest(F.to_json("events")), "sp_actions": acts, "public_action_count": F.size(F.coalesce(acts, F.array().cast("array<array<string>>"))), "label_cutoff_step_idx": F.col("step_idx")})


def field_names(json: Column) -> Column:
    """Distinct lower-cased names of the fields of a JSON text, at any depth, sorted; null if it is no JSON."""
    bare = F.regexp_replace(canonical_json(json), r"\\.", "")  # without escapes a quote ends its string
    strings = F.regexp_extract_all(bare, F.lit('"[^"]*":?'), F.lit(0))
    names = F.filter(strings, lambda s: s.endswith(":"))
    return F.array_sort(F.array_distinct(F.transform(names, lambda s: F.lower(F.substring_index(F.substring(s, 2, 1 << 30), '":', 1)))))


def private_fields(json: Column, names: tuple[str, ...]) -> Column:
    """The private ``names`` (lower case) that stand as a field anywhere in a JSON text."""
    return F.array_intersect(field_names(json), F.array(*map(F.lit, names)))


def key_paths(rows: DataFrame, json: str, names: tuple[str, ...]) -> DataFrame:
    """Columns of ``rows`` with ``path`` (``root.field[0].field``) and ``kind`` of every field of a JSON text that is called one of ``names``.

    Texts are walked down level by level, to any depth, by a recursive query;
    only those that have such a name anywhere are. No JSON, null and texts
    without such fields give no rows; repeated rows give their fields each.
    """
    spark = rows.sparkSession
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(limit, "-1")  # depth and size are those of the texts
    wanted = F.array(*map(F.lit, sorted({n.lower() for n in names})))
    rows = rows.where(F.arrays_overlap(field_names(F.col(json)), wanted))
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    found = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    return spark.sql(
        f"""WITH RECURSIVE walk AS (
          SELECT {columns}, 'root' AS path, CAST(NULL AS STRING) AS __name, try_parse_json(`{json}`) AS __value FROM {{rows}}
          UNION ALL
          SELECT {columns}, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END, e.key, e.value FROM walk, LATERAL variant_explode(walk.__value) e
        ) SELECT {columns}, path, regexp_extract(schema_of_variant(__value), '^[A-Z]+', 0) AS kind FROM walk WHERE __name IN ({found})""",
        rows=rows,
    )
