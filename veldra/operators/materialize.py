"""From raw samples to training rows of both orders, in one pass, with its counters.

A raw sample holds what ``events.raw_violations`` reads: maps by canonical name,
``observer_ids``, events as JSON text. Decisions are made inside a row, so
nothing is shuffled. Each sample is read once; what becomes of it, the rows,
the snapshots that give none of order 1, the observers that are left out, and
the counters, comes from the job that writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from veldra.functions.domain import let, lineage, player
from veldra.operators import events as E
from veldra.operators.snapshots import closure, compatible

#: Where a decision comes from, and how sure it is.
PROVENANCE = {"source": "original_self_report", "deterministic_hard_knowledge": "deterministic_unique_hard_knowledge_pair_v1"}
CONFIDENCE = {"source": "source", "deterministic_hard_knowledge": "exact"}
#: Parts of the output.
PARTS = ("tom1", "tom2", "removed_tom1", "filtered_tom2")
_MAPS = {m: "map<string,array<string>>" if m in ("suspected_werewolves", "known_werewolves", "known_non_werewolves") else "map<string,string>" for m in E.FORMAL_MAPS}
#: Columns of a formal row, with their types; events are JSON text.
FORMAL = {
    "schema_version": "string", "label_prompt_version": "string", "label_provenance": "string", "game_id": "string", "step_idx": "long", "label_cutoff_step_idx": "long", "phase": "string", "speaker_id": "int", "report_trigger": "string", "observer_ids": "array<int>",
    "public_action_count": "long", "events": "string", "public_event_digest": "string", "structured_input_digest": "string", **_MAPS, "source_schema_version": "string", "annotation_schema_version": "string", "source_label_provenance": "string", "tom_order": "int",
    "model_input_scope": "string", "private_fields_usage": "string", "current_action_used": "boolean", "expert_labels_used_as_later_evidence": "boolean", "future_information_used": "boolean",
}


def _numbers(names: Column) -> Column:
    return F.transform(names, lambda x: F.substring(x, 7, 1).cast("int"))


def decided(raw: DataFrame) -> DataFrame:
    """Raw samples with ``scope`` (their lineage) and ``decisions``: who (name), id, kind, target (names) for each observer, in the order of ``observer_ids``."""
    scope = lineage(E.SOURCES, F.col("schema_version"), F.col("label_prompt_version"), F.col("label_provenance"))
    raw = raw.withColumn("scope", scope)
    public = F.coalesce(F.col("scope") == "public_events_only", F.lit(False))

    def of(i: Column) -> Column:
        return let(player(i), lambda who: by_name(i, who))

    def by_name(i: Column, who: Column) -> Column:
        status = F.col("belief_status")[who]
        pairs = compatible(_numbers(F.col("known_werewolves")[who]), _numbers(F.col("known_non_werewolves")[who]))
        one = ~public & (status == "semantic_error") & (F.size(pairs) == 1)
        kind = F.when(status == "ok", "source").when(F.coalesce(one, F.lit(False)), "deterministic_hard_knowledge").otherwise("unavailable")
        closed = F.transform(closure(pairs)["known"], lambda n: F.concat(F.lit("player"), n.cast("string")))
        target = F.when(kind == "source", F.col("suspected_werewolves")[who]).when(kind == "deterministic_hard_knowledge", closed)
        return F.struct(who.alias("who"), i.alias("id"), status.alias("status"), kind.alias("kind"), target.alias("target"))

    return raw.withColumn("decisions", F.transform("observer_ids", of))


def _formal(order: int, kept: Column) -> Column:
    """The formal row (struct of ``FORMAL``) of an order with the ``kept`` decisions."""
    public = F.col("scope") == "public_events_only"
    by = lambda value: F.map_from_arrays(F.transform(kept, lambda d: d["who"]), F.transform(kept, value))
    raw = lambda name: by(lambda d: F.col(name)[d["who"]])
    hard = lambda d: d["kind"] == "deterministic_hard_knowledge"
    named = lambda values: lambda d: F.coalesce(*[F.when(d["kind"] == k, v) for k, v in values.items()])
    scoped = lambda pair: F.when(public, pair[1]).otherwise(pair[0])
    own = {
        "observer_ids": F.transform(kept, lambda d: d["id"]), "suspected_werewolves": by(lambda d: d["target"]), "known_werewolves": raw("known_werewolves"), "known_non_werewolves": raw("known_non_werewolves"),
        "belief_status": by(lambda d: F.when(hard(d), "ok").otherwise(d["status"])), "belief_errors": by(lambda d: F.when(~hard(d), F.col("belief_errors")[d["who"]])), "agent_backend_ids": raw("agent_backend_ids"),
        "observer_annotation_confidence": by(named(CONFIDENCE)), "observer_label_provenance": by(named(PROVENANCE)), "source_belief_errors": raw("belief_errors"), "source_belief_status": raw("belief_status"),
        "source_schema_version": F.col("schema_version"), "source_label_provenance": F.col("label_provenance"), "tom_order": F.lit(order), "current_action_used": F.lit(False), "expert_labels_used_as_later_evidence": F.lit(False), "future_information_used": F.lit(False),
        "annotation_schema_version": scoped([E.ANNOTATIONS[s][0] for s in E.SOURCES]), "label_provenance": scoped([E.ANNOTATIONS[s][1] for s in E.SOURCES]),
        "model_input_scope": scoped((E.INPUT_SCOPES[order], "public_events_only")), "private_fields_usage": scoped((E.PRIVATE_USAGE[order], "none")),
    }
    return F.struct(*[(own[c] if c in own else F.col(c)).cast(t).alias(c) for c, t in FORMAL.items()])


def parts(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """part (see ``PARTS``), row (a formal row of tom1 and tom2), game_id, step_idx, phase, player (whom a removed snapshot or a filtered observer is about), and the columns of the sample to ``keep``."""
    fit = F.filter("decisions", lambda d: d["kind"] != "unavailable")
    out = F.filter("decisions", lambda d: d["kind"] == "unavailable")
    own = F.filter(fit, lambda d: d["id"] == F.col("speaker_id"))
    row_type = "struct<" + ",".join(f"{c}:{t}" for c, t in FORMAL.items()) + ">"
    none = F.lit(None).cast(row_type)
    each = lambda part, row, who: F.struct(F.lit(part).alias("part"), row.cast(row_type).alias("row"), who.cast("int").alias("player"))
    entries = F.concat(
        F.array(F.when(F.size(own) > 0, each("tom1", _formal(1, own), F.lit(None))).otherwise(each("removed_tom1", none, F.col("speaker_id")))),
        F.when(F.size(fit) > 0, F.array(each("tom2", _formal(2, fit), F.lit(None)))).otherwise(F.array().cast(f"array<struct<part:string,row:{row_type},player:int>>")),
        F.transform(out, lambda d: each("filtered_tom2", none, d["id"])),
    )
    return decided(raw).select("game_id", "step_idx", "phase", *keep, F.explode(entries).alias("e")).select("e.part", "e.row", "game_id", "step_idx", "phase", "e.player", *keep)


def counted(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """``raw`` as it is, and an observation that holds, once it has been written, the counters over it: snapshots, lineages, semantic errors, recovered and unresolved observers, and raw samples that break a rule."""
    seen = Observation()
    n = lambda test: F.coalesce(F.sum(F.size(F.filter("decisions", test))), F.lit(0))
    rows = E.raw_violations(decided(raw))
    rows = rows.observe(
        seen, F.count(F.lit(1)).alias("snapshots"), F.min("scope").alias("first_scope"), F.max("scope").alias("last_scope"), n(lambda d: d["status"] == "semantic_error").alias("semantic_errors"),
        n(lambda d: d["kind"] == "deterministic_hard_knowledge").alias("recovered"), n(lambda d: d["kind"] == "unavailable").alias("unresolved"), F.count_if(F.size("violations") > 0).alias("bad_samples"), F.min(F.when(F.size("violations") > 0, F.concat_ws(" ", "game_id", F.col("step_idx").cast("string"), F.array_join("violations", ",")))).alias("first_bad"),
    )
    return rows.drop("violations", "decisions", "scope"), seen


def from_lines(lines: DataFrame) -> DataFrame:
    """Raw samples of JSON lines (column ``value``), with the events as JSON text."""
    kinds = {c: t for c, t in FORMAL.items() if c in ("schema_version", "label_prompt_version", "label_provenance", "game_id", "step_idx", "label_cutoff_step_idx", "phase", "speaker_id", "report_trigger", "observer_ids", "public_action_count", "public_event_digest", "structured_input_digest", *E.MAPS)}
    row = F.from_json("value", ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", public_events string")
    return lines.select(row.alias("r")).select("r.*").withColumnRenamed("public_events", "events")


def lines(rows: DataFrame) -> DataFrame:
    """part and value (a JSON line) of what ``parts`` gives; events stand as an array under ``public_events``."""
    fields = [F.when(F.col("row.events").isNotNull(), F.try_parse_json("row.events")).alias("public_events") if c == "events" else F.col(f"row.{c}").alias(c) for c in FORMAL]
    keep_nulls = {"ignoreNullFields": "false"}
    about = F.struct("game_id", "step_idx", "phase", F.col("player").alias("player_id"))
    return rows.select("part", F.when(F.col("row").isNotNull(), F.to_json(F.struct(*fields), keep_nulls)).otherwise(F.to_json(about, keep_nulls)).alias("value"))


def formal_from_lines(text: DataFrame) -> DataFrame:
    """Formal rows of JSON lines (column ``value``)."""
    row = F.from_json("value", ", ".join(f"{'public_events' if c == 'events' else c} {t}" for c, t in FORMAL.items()))
    return text.select(row.alias("r")).select("r.*").withColumnRenamed("public_events", "events")
