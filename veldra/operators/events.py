"""Public events of a game: contract, tokens, digests, boundary, features and contracts of whole rows.

``events`` is a JSON array (text) of event objects. ``parsed`` reads it; all
else works on what ``parsed`` gives, one row at a time, without a shuffle. A
null text, or one that is no array, has no events and the violation
``not_an_array``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions.domain import ACTIONS, PLAYERS, STATUSES, action, let, lineage, number_of, phase_parts, player
from veldra.operators.snapshots import closure, compatible

#: Fields of each kind of event, besides its place and kind.
FIELDS = {
    "phase_change": ("phase",), "turn_start": ("speaker",), "public_speech": ("speaker", "raw_text", "sp_actions"), "vote_result": ("votes",),
    "exile_result": ("exiled_players",), "death_announcement": ("dead_players",),
}
#: Kinds of tokens and phases by number, from 1.
TOKENS = ("phase_change", "turn_start", "public_speech", "speech_action", "vote_result", "vote", "exile_result", "exiled_player", "death_announcement", "dead_player")
PHASES = ("day_speech", "day_speech_pk", "day_vote", "day_vote_pk", "night_skill_wolf")
EVENT = "struct<event_idx:long,event_type:string,phase:string,speaker:string,raw_text:string,sp_actions:array<array<string>>,votes:array<struct<voter:string,target:string>>,exiled_players:array<string>,dead_players:array<string>>"
TOKEN = "struct<action:string,day:long,object:string,phase:string,subject:string,token_type:string>"


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def parsed(events: Column) -> Column:
    """Array of events (see ``EVENT``) of a JSON text."""
    return F.from_json(events, f"array<{EVENT}>")


def _ordered(names: Column) -> Column:
    """Whether an array holds distinct canonical players in order."""
    return F.forall(names, lambda x: F.coalesce(x.isin(*PLAYERS), F.lit(False))) & (F.array_sort(F.array_distinct(names)) == names)


def event_violations(events: Column) -> Column:
    """``place:rule`` of every event of a JSON text that breaks the contract, with the first rule that it breaks."""
    raws = F.from_json(events, "array<string>")

    def of(raw: Column, i: Column) -> Column:
        read = F.struct(F.from_json(raw, EVENT).alias("e"), F.array_sort(F.json_object_keys(raw)).alias("keys"), F.try_parse_json(raw).alias("v"))
        return let(read, lambda x: judged(raw, i, x["e"], x["keys"], x["v"]))

    def judged(raw: Column, i: Column, e: Column, keys: Column, value: Column) -> Column:
        kind = e["event_type"]
        expected = functools.reduce(lambda c, k: c.when(kind == k, F.array(*map(F.lit, sorted((*FIELDS[k], "event_idx", "event_type"))))), FIELDS, F.when(F.lit(False), F.array().cast("array<string>")))
        is_text = F.schema_of_variant(F.try_variant_get(value, "$.raw_text", "variant")) == "STRING"
        is_number = F.schema_of_variant(F.try_variant_get(value, "$.event_idx", "variant")) == "BIGINT"
        acts_fit = F.forall(e["sp_actions"], lambda a: (F.size(a) == 3) & F.coalesce(player(a[0]).isNotNull() & action(a[1]).isNotNull() & player(a[2]).isNotNull(), F.lit(False)))
        voters = F.transform(e["votes"], lambda v: v["voter"])
        vote_keys = F.forall(F.from_json(F.get_json_object(raw, "$.votes"), "array<string>"), lambda v: F.coalesce(F.array_sort(F.json_object_keys(v)) == F.array(F.lit("target"), F.lit("voter")), F.lit(False)))
        rule = F.when(_no(kind.isin(*FIELDS)), "event_type").when(_no(keys == expected), "fields").when(_no(is_number & (e["event_idx"] == i)), "event_idx")
        rule = rule.when((kind == "phase_change") & phase_parts(e["phase"]).isNull(), "phase").when(kind.isin("turn_start", "public_speech") & _no(e["speaker"].isin(*PLAYERS)), "speaker")
        rule = rule.when((kind == "public_speech") & _no(is_text), "raw_text").when((kind == "public_speech") & _no(acts_fit), "sp_actions")
        rule = rule.when((kind == "vote_result") & _no(vote_keys), "votes").when((kind == "vote_result") & _no(_ordered(voters)), "voter_order")
        rule = rule.when((kind == "vote_result") & _no(F.forall(e["votes"], lambda v: v["target"].isNull() | v["target"].isin(*PLAYERS))), "vote_target")
        rule = rule.when((kind == "exile_result") & _no(_ordered(e["exiled_players"])), "exiled_players").when((kind == "death_announcement") & _no(_ordered(e["dead_players"])), "dead_players")
        return F.concat_ws(":", i.cast("string"), rule)

    each = F.filter(F.transform(raws, of), lambda x: F.contains(x, F.lit(":")))
    return F.coalesce(each, F.array(F.lit("not_an_array")))


def speech_actions(events: Column) -> Column:
    """All (subject, action, object) of the speeches in order, in canonical names."""
    said = F.flatten(F.transform(F.filter(events, lambda e: e["event_type"] == "public_speech"), lambda e: e["sp_actions"]))
    return F.transform(said, lambda a: F.array(player(a[0]), action(a[1]), player(a[2])))


def token_groups(events: Column) -> Column:
    """For each event the array of its tokens: one for the event, then one for each detail."""

    def token(kind: Column, subject=None, act=None, object_=None, phase=None, day=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct((act if act is not None else null).alias("action"), (day if day is not None else F.lit(0)).cast("long").alias("day"), (object_ if object_ is not None else null).alias("object"), (phase if phase is not None else null).alias("phase"), (subject if subject is not None else null).alias("subject"), kind.alias("token_type"))

    def of(e: Column) -> Column:
        kind, parts = e["event_type"], phase_parts(e["phase"])
        head = token(kind, subject=F.when(kind.isin("turn_start", "public_speech"), e["speaker"]), phase=F.when(kind == "phase_change", F.concat_ws("_", parts["time"], parts["kind"])), day=F.when(kind == "phase_change", parts["day"]).otherwise(F.lit(0)))
        none = F.array().cast(f"array<{TOKEN}>")
        details = (
            F.when(kind == "public_speech", F.transform(e["sp_actions"], lambda a: token(F.lit("speech_action"), player(a[0]), action(a[1]), player(a[2]))))
            .when(kind == "vote_result", F.transform(e["votes"], lambda v: token(F.lit("vote"), v["voter"], None, v["target"])))
            .when(kind == "exile_result", F.transform(e["exiled_players"], lambda p: token(F.lit("exiled_player"), object_=p)))
            .when(kind == "death_announcement", F.transform(e["dead_players"], lambda p: token(F.lit("dead_player"), object_=p)))
        )
        return F.concat(F.array(head), F.coalesce(details.cast(f"array<{TOKEN}>"), none))

    return F.transform(events, of)


def structured_tokens(events: Column) -> Column:
    """All tokens (see ``TOKEN``) of the events, without raw text."""
    return F.flatten(token_groups(events))


def structured_digest(events: Column) -> Column:
    """SHA-256 of the tokens' canonical JSON (null fields are in it)."""
    return F.sha2(F.to_json(structured_tokens(events), {"ignoreNullFields": "false"}), 256)


def event_digest(events: Column) -> Column:
    """SHA-256 of the canonical JSON of the events; actions in canonical names, vote targets even if null, absent fields left out. Null as soon as one event lacks a field of its kind or is of no known kind."""
    return F.sha2(canonical_events(events), 256)


def canonical_events(events: Column) -> Column:
    """Canonical JSON of the events; null as soon as one of them has none."""
    each = F.transform(events, _event_json)
    return let(each, lambda all: F.when(~F.exists(all, lambda x: x.isNull()), F.concat(F.lit("["), F.array_join(all, ","), F.lit("]"))))


def _event_json(e: Column) -> Column:
    def quoted(c: Column) -> Column:
        return let(F.to_json(F.struct(c.alias("x"))), lambda j: F.substr(j, F.lit(6), F.length(j) - 6))  # what stands between {"x": and }

    acts = F.transform(e["sp_actions"], lambda a: F.array(player(a[0]), action(a[1]), player(a[2])))
    votes = F.to_json(F.transform(e["votes"], lambda v: F.struct(v["target"].alias("target"), v["voter"].alias("voter"))), {"ignoreNullFields": "false"})
    field = lambda name, json: F.concat(F.lit(f',"{name}":'), json)
    kind = e["event_type"]
    head = lambda k: F.concat(F.lit('"event_idx":'), e["event_idx"].cast("string"), F.lit(f',"event_type":"{k}"'))
    fields = {
        "phase_change": lambda h: F.concat(h, field("phase", quoted(e["phase"]))), "turn_start": lambda h: F.concat(h, field("speaker", quoted(e["speaker"]))),
        "public_speech": lambda h: F.concat(h, field("raw_text", quoted(e["raw_text"])), field("sp_actions", F.to_json(acts)), field("speaker", quoted(e["speaker"]))),
        "vote_result": lambda h: F.concat(h, field("votes", votes)), "exile_result": lambda h: F.concat(h, field("exiled_players", F.to_json(e["exiled_players"]))),
        "death_announcement": lambda h: F.concat(F.lit('"dead_players":'), F.to_json(e["dead_players"]), F.lit(","), h),
    }
    body = functools.reduce(lambda c, k: c.when(kind == k, fields[k](head(k))), fields, F.when(F.lit(False), F.lit("")))
    return F.concat(F.lit("{"), body, F.lit("}"))


def at_boundary(events: Column, speaker: Column) -> Column:
    """Whether a speech has just ended and the speaker (a number) is next; null if the events do not end with that player's turn (fewer than two: false)."""
    last, former = F.try_element_at(events, F.lit(-1)), F.try_element_at(events, F.lit(-2))
    own = (last["event_type"] == "turn_start") & (last["speaker"] == player(speaker))
    return F.when(F.size(events) < 2, F.lit(False)).when(own, former["event_type"] == "public_speech")


def newest_tokens(events: Column, limit: int) -> Column:
    """The tokens of the newest whole events that fit into ``limit``; of the newest one, if it alone is longer, the first and the last limit - 1."""
    groups = F.reverse(token_groups(events))
    state = F.struct(F.lit(limit).alias("left"), F.lit(True).alias("open"), F.array().cast(f"array<{TOKEN}>").alias("kept"))

    def step(s: Column, g: Column) -> Column:
        fits = s["open"] & (F.size(g) <= s["left"])
        cut = s["open"] & ~fits & (F.size(s["kept"]) == 0)
        tail = F.concat(F.slice(g, 1, 1), F.slice(g, F.size(g) - (limit - 2), limit - 1)) if limit > 1 else F.slice(g, 1, 1)
        kept = F.when(fits, F.concat(g, s["kept"])).when(cut, tail).otherwise(s["kept"])
        return F.struct(F.when(fits, s["left"] - F.size(g)).otherwise(F.lit(0)).alias("left"), fits.alias("open"), kept.alias("kept"))

    return F.aggregate(groups, state, step, lambda s: s["kept"])


def features(rows: DataFrame, events: str = "events", limit: int = 256, batch: list[str] | None = None) -> DataFrame:
    """Adds the arrays subject_ids, action_ids, object_ids, event_type_ids, phase_ids, day_values and attention_mask; within a batch (columns) all are padded with 0 to the longest, at least 1."""
    rows = rows.withColumn("__tokens", newest_tokens(F.col(events), limit))
    n = F.greatest(F.size("__tokens"), F.lit(1))
    rows = rows.withColumn("__length", F.max(n).over(Window.partitionBy(*batch)) if batch else n)
    ids = {
        "subject_ids": lambda t: number_of(t["subject"], PLAYERS), "action_ids": lambda t: number_of(t["action"], ACTIONS), "object_ids": lambda t: number_of(t["object"], PLAYERS),
        "event_type_ids": lambda t: number_of(t["token_type"], TOKENS), "phase_ids": lambda t: number_of(t["phase"], PHASES), "day_values": lambda t: t["day"].cast("double"), "attention_mask": lambda t: F.lit(1).cast("long"),
    }

    def padded(of) -> Column:
        values = F.transform("__tokens", of)
        return F.concat(values, F.array_repeat(F.lit(0), F.col("__length") - F.size(values)))

    return rows.withColumns({name: padded(of) for name, of in ids.items()}).drop("__tokens", "__length")


#: What rows of each lineage and order say about themselves.
SOURCES = {
    "private_conditioned": ("classic7_pre_speech_player_suspicion_v2", "classic7_pre_speech_player_suspicion_prompt_v2", "alive_observer_readonly_pre_speech_report_v1"),
    "public_events_only": ("classic7_pre_speech_public_only_player_suspicion_v1", "classic7_pre_speech_public_only_player_suspicion_prompt_v1", "alive_observer_public_only_pre_speech_report_v1"),
}
ANNOTATIONS = {
    "private_conditioned": ("classic7_pre_speech_v27_valid_only_no_guess_v1", "v27_valid_source_report_and_deterministic_hard_knowledge_v1"),
    "public_events_only": ("classic7_pre_speech_public_only_valid_only_no_guess_v1", "public_only_valid_source_report_v1"),
}
INPUT_SCOPES = {1: "public_events_plus_current_observer_private_knowledge", 2: "public_events_only"}
PRIVATE_USAGE = {1: "first_order_model_input_and_label", 2: "label_construction_and_audit_only"}
TRIGGERS = ("pre_public_speech", "pre_public_speech_pk")
MAPS = ("suspected_werewolves", "known_werewolves", "known_non_werewolves", "belief_status", "belief_errors", "agent_backend_ids")
FORMAL_MAPS = (*MAPS, "observer_annotation_confidence", "observer_label_provenance", "source_belief_errors", "source_belief_status")


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def with_facts(rows: DataFrame) -> DataFrame:
    """Adds ``event_facts``, what the rules ask about ``events`` (JSON text) whatever the rest of the row holds; of rows that are made of one another it is worked out once."""
    parsed_ = F.col("__parsed")
    end = F.try_element_at(parsed_, F.lit(-1))
    facts = {
        "broken": (F.size(event_violations(F.col("events"))) > 0) | _no(F.size(parsed_) > 0), "end_type": end["event_type"], "end_speaker": end["speaker"],
        "phase": F.try_element_at(F.filter(parsed_, lambda e: e["event_type"] == "phase_change"), F.lit(-1))["phase"], "n_actions": F.size(speech_actions(parsed_)),
        "event_digest": event_digest(parsed_), "structured_digest": structured_digest(parsed_),
    }
    return rows.withColumn("__parsed", parsed(F.col("events"))).withColumn("event_facts", F.struct(*[c.alias(n) for n, c in facts.items()])).drop("__parsed")


def _shared_rules(maps: tuple[str, ...]) -> dict[str, Column]:
    """Rules of raw and formal rows; maps are keyed by canonical names, lists hold such names, ``__names`` those of the observers and ``event_facts`` what ``with_facts`` finds."""
    names, facts, ids = F.col("__names"), F.col("event_facts"), F.col("observer_ids")

    def numbers(column: str, who: Column) -> Column:
        return F.transform(F.col(column)[who], lambda x: F.substring(x, 7, 1).cast("int"))

    def each(test) -> Column:
        """Whether some observer breaks a rule."""
        return F.exists(names, lambda who: _no(test(who)))

    ok = lambda who: F.col("belief_status")[who] == "ok"
    shut = lambda who: closure(compatible(numbers("known_werewolves", who), numbers("known_non_werewolves", who)))
    rules = {
        "observer_ids": _no((F.size(ids) > 0) & F.forall(ids, lambda x: x.between(1, 7)) & (F.size(F.array_distinct(ids)) == F.size(ids))),
        "speaker_id": _no(F.col("speaker_id").between(1, 7)),
    }
    rules |= {f"{m}:observers": _no(F.array_sort(F.map_keys(m)) == names) for m in maps}
    rules |= {
        "hard_knowledge_not_closed": each(lambda w: let(shut(w), lambda x: (x["known"] == numbers("known_werewolves", w)) & (x["cleared"] == numbers("known_non_werewolves", w)))),
        "belief_status": each(lambda w: F.col("belief_status")[w].isin(*STATUSES)),
        "error_against_status": each(lambda w: F.when(ok(w), F.col("belief_errors")[w].isNull()).otherwise(_filled(F.col("belief_errors")[w]))),
        "suspicion_against_status": each(lambda w: F.when(ok(w), F.col("suspected_werewolves")[w].isNotNull()).otherwise(F.col("suspected_werewolves")[w].isNull())),
        "suspicion_order": each(lambda w: ~ok(w) | _ordered(F.col("suspected_werewolves")[w])),
        "suspicion_against_knowledge": each(lambda w: ~ok(w) | (F.size(F.array_except(F.col("known_werewolves")[w], F.col("suspected_werewolves")[w])) == 0) & ~F.arrays_overlap(F.col("suspected_werewolves")[w], F.col("known_non_werewolves")[w])),
        "agent_backend_ids": each(lambda w: _filled(F.col("agent_backend_ids")[w])),
        "public_events": facts["broken"],
        "not_at_turn_start": _no((facts["end_type"] == "turn_start") & (facts["end_speaker"] == player(F.col("speaker_id")))),
        "step_idx": _no(F.col("step_idx") >= 0),
        "label_cutoff_step_idx": _no(F.col("label_cutoff_step_idx") == F.col("step_idx")),
        "phase": phase_parts(F.col("phase")).isNull() | _no(facts["phase"] == F.col("phase")),
        "game_id": ~_filled(F.col("game_id")),
        "report_trigger": _no(F.col("report_trigger").isin(*TRIGGERS)),
        "public_action_count": _no(F.col("public_action_count") == facts["n_actions"]),
        "public_event_digest": _no(F.col("public_event_digest") == facts["event_digest"]),
        "structured_input_digest": _no(F.col("structured_input_digest") == facts["structured_digest"]),
    }
    return rules


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with what many rules ask, each as a column of its own."""
    rows = rows if "event_facts" in rows.columns else with_facts(rows)
    return rows.withColumn("__names", F.array_sort(F.transform("observer_ids", player)))


def _checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))).drop("event_facts", "__names", "__scope")


def _knows_nothing() -> Column:
    empty = lambda m: F.forall(F.map_values(m), lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0)
    return empty("known_werewolves") & empty("known_non_werewolves")


def raw_violations(rows: DataFrame) -> DataFrame:
    """Raw rows (``events`` as JSON text) with the names of the rules that they break."""
    rows = _prepared(rows).withColumn("__scope", lineage(SOURCES, F.col("schema_version"), F.col("label_prompt_version"), F.col("label_provenance")))
    rules = {"lineage": F.col("__scope").isNull(), "public_only_knows": (F.col("__scope") == "public_events_only") & ~_knows_nothing()}
    return _checked(rows, rules | _shared_rules(MAPS))


def formal_violations(rows: DataFrame, order: int | Column) -> DataFrame:
    """Formal rows of an order (1 or 2, or a column with the order of each; ``events`` as JSON text, ``event_facts`` from ``with_facts`` if they are known) with the names of the rules that they break."""
    order = order if isinstance(order, Column) else F.lit(order)
    first = F.coalesce(order == 1, F.lit(False))
    of = lambda values: F.when(first, values[1]).otherwise(values[2])
    scope = F.col("__scope")
    rows = _prepared(rows).withColumn("__scope", lineage(SOURCES, F.col("schema_version"), F.col("label_prompt_version"), F.col("source_label_provenance")))
    by = lambda values: functools.reduce(lambda c, s: c.when(scope == s, values(s)), SOURCES, F.when(F.lit(False), ""))
    private = lambda s: s == "private_conditioned"
    rules = {
        "lineage": scope.isNull(), "source_schema_version": _no(F.col("source_schema_version") == F.col("schema_version")), "tom_order": _no(F.col("tom_order") == order),
        "model_input_scope": _no(F.col("model_input_scope") == by(lambda s: of(INPUT_SCOPES) if private(s) else F.lit("public_events_only"))),
        "private_fields_usage": _no(F.col("private_fields_usage") == by(lambda s: of(PRIVATE_USAGE) if private(s) else F.lit("none"))),
        "annotation_schema_version": _no(F.col("annotation_schema_version") == by(lambda s: ANNOTATIONS[s][0])), "label_provenance": _no(F.col("label_provenance") == by(lambda s: ANNOTATIONS[s][1])),
    }
    rules |= {c: _no(~F.col(c)) for c in ("current_action_used", "expert_labels_used_as_later_evidence", "future_information_used")}
    names = F.col("__names")
    rules |= {"public_only_knows": (scope == "public_events_only") & ~_knows_nothing()}
    rules["first_order_observer"] = first & _no(F.col("observer_ids") == F.array("speaker_id"))
    blank = lambda m: F.exists(names, lambda w: ~_filled(F.col(m)[w]))
    rules |= {m: blank(m) for m in ("observer_annotation_confidence", "observer_label_provenance")}
    rules["source_belief_status"] = F.exists(names, lambda w: _no(F.col("source_belief_status")[w].isin(*STATUSES)))
    return _checked(rows, rules | _shared_rules(FORMAL_MAPS))
