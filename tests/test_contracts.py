"""Contracts of whole rows, files and streams, by cases that break one rule each."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veldra.operators import beliefs, events, relations
from veldra.sources import jsonl
from veldra.streaming import monitor as stream

EVENTS = [
    {"event_idx": 0, "event_type": "phase_change", "phase": "1_day_speech"}, {"event_idx": 1, "event_type": "turn_start", "speaker": "player2"},
    {"event_idx": 2, "event_type": "public_speech", "speaker": "player2", "raw_text": 'é "x"\n', "sp_actions": [["player2", "point_as_seer", "player2"]]},
    {"event_idx": 3, "event_type": "vote_result", "votes": [{"voter": "player1", "target": None}, {"voter": "player2", "target": "player3"}]}, {"event_idx": 4, "event_type": "exile_result", "exiled_players": ["player3"]},
    {"event_idx": 5, "event_type": "death_announcement", "dead_players": []}, {"event_idx": 6, "event_type": "turn_start", "speaker": "player1"},
]


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def of_events(spark, value, column):
    text = value if value is None or isinstance(value, str) else json.dumps(value)
    return spark.createDataFrame([(text,)], "e string").withColumn("p", events.parsed(F.col("e"))).select(column.alias("r")).first().r


def test_events(spark):
    faults = lambda v: of_events(spark, v, events.event_violations(F.col("e")))
    assert faults(EVENTS) == [] and faults("no json") == faults(None) == ["not_an_array"] and faults([]) == []
    for i, change, rule in [
        (0, {"phase": "0_day_speech"}, "phase"), (0, {"event_type": "party"}, "event_type"), (1, {"speaker": "2"}, "speaker"), (1, {"event_idx": 5}, "event_idx"), (1, {"x": 1}, "fields"), (2, {"raw_text": 5}, "raw_text"), (2, {"sp_actions": [["player1", "fly", "player2"]]}, "sp_actions"),
        (3, {"votes": EVENTS[3]["votes"][::-1]}, "voter_order"), (3, {"votes": [{"voter": "player1"}]}, "votes"), (3, {"votes": [{"voter": "player1", "target": "x"}]}, "vote_target"), (4, {"exiled_players": ["player4", "player3"]}, "exiled_players"), (5, {"dead_players": ["player1", "player1"]}, "dead_players"),
    ]:
        assert faults([e | change if k == i else e for k, e in enumerate(EVENTS)]) == [f"{i}:{rule}"]
    assert of_events(spark, EVENTS, events.event_digest(F.col("p"))) == hashlib.sha256(canonical(EVENTS).encode()).hexdigest()
    tokens = [t.asDict() for t in of_events(spark, EVENTS, events.structured_tokens(F.col("p")))]
    assert len(tokens) == 11 and of_events(spark, EVENTS, events.structured_digest(F.col("p"))) == hashlib.sha256(canonical(tokens).encode()).hexdigest()
    newest = lambda n: [t.token_type for t in of_events(spark, EVENTS[:4], events.newest_tokens(F.col("p"), n))]
    assert newest(3) == ["vote_result", "vote", "vote"] and newest(2) == ["vote_result", "vote"] and newest(1) == ["vote_result"] and newest(4) == newest(3) and len(newest(5)) == 5
    at = lambda v, k: of_events(spark, v, events.at_boundary(F.col("p"), F.lit(k)))
    assert at(EVENTS, 1) is False and at([*EVENTS[:3], EVENTS[1]], 2) is True and at(EVENTS, 2) is None and at(EVENTS[:1], 2) is False


BASE = {
    "schema_version": "classic7_pre_speech_player_suspicion_v2", "label_prompt_version": "classic7_pre_speech_player_suspicion_prompt_v2", "label_provenance": "alive_observer_readonly_pre_speech_report_v1", "game_id": "g", "step_idx": 6, "label_cutoff_step_idx": 6,
    "phase": "1_day_speech", "speaker_id": 1, "report_trigger": "pre_public_speech", "observer_ids": [1, 2], "public_action_count": 1, "events": json.dumps(EVENTS), "suspected_werewolves": {"player1": ["player4"], "player2": None},
    "known_werewolves": {"player1": [], "player2": []}, "known_non_werewolves": {"player1": ["player1"], "player2": ["player2"]}, "belief_status": {"player1": "ok", "player2": "parse_error"}, "belief_errors": {"player1": None, "player2": "bad"}, "agent_backend_ids": {"player1": "a", "player2": "b"},
}
FORMAL = {
    "source_schema_version": BASE["schema_version"], "source_label_provenance": BASE["label_provenance"], "label_provenance": "v27_valid_source_report_and_deterministic_hard_knowledge_v1", "annotation_schema_version": "classic7_pre_speech_v27_valid_only_no_guess_v1", "tom_order": 2,
    "model_input_scope": "public_events_only", "private_fields_usage": "label_construction_and_audit_only", "current_action_used": False, "expert_labels_used_as_later_evidence": False, "future_information_used": False, "observer_annotation_confidence": {"player1": "source", "player2": "source"},
    "observer_label_provenance": {"player1": "x", "player2": "x"}, "source_belief_errors": {"player1": None, "player2": "bad"}, "source_belief_status": {"player1": "ok", "player2": "parse_error"},
}
LISTS = ("suspected_werewolves", "known_werewolves", "known_non_werewolves")


def kind(name, value):
    if name in LISTS:
        return "map<string,array<string>>"
    return "map<string,string>" if isinstance(value, dict) else "array<int>" if isinstance(value, list) else "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "string"


def broken(spark, base, changes, check):
    """Violations of the base row and of the base row with each change, in one job."""
    digests = {"public_event_digest": hashlib.sha256(canonical(EVENTS).encode()).hexdigest(), "structured_input_digest": of_events(spark, EVENTS, events.structured_digest(F.col("p")))}
    base = base | digests
    schema = "n int, " + ", ".join(f"{k} {kind(k, v)}" for k, v in base.items())
    rows = [(i, *(base | c).values()) for i, c in enumerate([{}, *changes])]
    return [r.violations for r in check(spark.createDataFrame(rows, schema)).orderBy("n").collect()]


SHARED = [
    ({"observer_ids": [1, 1]}, "observer_ids"), ({"agent_backend_ids": {"player1": "a"}}, "agent_backend_ids:observers"), ({"known_werewolves": {"player1": ["player4", "player5"], "player2": []}}, "hard_knowledge_not_closed"), ({"belief_errors": {"player1": "x", "player2": "bad"}}, "error_against_status"),
    ({"suspected_werewolves": {"player1": None, "player2": None}}, "suspicion_against_status"), ({"suspected_werewolves": {"player1": ["player5", "player4"], "player2": None}}, "suspicion_order"), ({"suspected_werewolves": {"player1": ["player1"], "player2": None}}, "suspicion_against_knowledge"),
    ({"step_idx": -1}, "step_idx"), ({"label_cutoff_step_idx": 7}, "label_cutoff_step_idx"), ({"phase": "2_day_speech"}, "phase"), ({"speaker_id": 2}, "not_at_turn_start"), ({"game_id": " "}, "game_id"), ({"report_trigger": "x"}, "report_trigger"), ({"public_action_count": 2}, "public_action_count"),
    ({"public_event_digest": "x"}, "public_event_digest"), ({"structured_input_digest": None}, "structured_input_digest"), ({"events": "[]"}, "public_events"), ({"schema_version": "x"}, "lineage"), ({"belief_status": {"player1": "ok", "player2": "odd"}}, "belief_status"),
]


def test_raw_rows(spark):
    good, *bad = broken(spark, BASE, [c for c, _ in SHARED], events.raw_violations)
    assert good == [] and all(rule in found for found, (_, rule) in zip(bad, SHARED))
    public = dict(zip(("schema_version", "label_prompt_version", "label_provenance"), events.SOURCES["public_events_only"]))
    assert broken(spark, BASE | public, [{"known_non_werewolves": {"player1": [], "player2": []}}], events.raw_violations) == [["public_only_knows"], []]


def test_formal_rows(spark):
    own = [({"tom_order": 1}, "tom_order"), ({"model_input_scope": "x"}, "model_input_scope"), ({"private_fields_usage": None}, "private_fields_usage"), ({"future_information_used": True}, "future_information_used"), ({"current_action_used": None}, "current_action_used"), ({"observer_label_provenance": {"player1": " ", "player2": "x"}}, "observer_label_provenance"), ({"source_belief_status": {"player1": "x", "player2": "ok"}}, "source_belief_status"), ({"annotation_schema_version": "x"}, "annotation_schema_version")]
    cases = own + [s for s in SHARED if "schema_version" not in s[0]]
    good, *bad = broken(spark, BASE | FORMAL, [c for c, _ in cases], lambda d: events.formal_violations(d, 2))
    assert good == [] and all(rule in found for found, (_, rule) in zip(bad, cases))
    first = broken(spark, BASE | FORMAL, [], lambda d: events.formal_violations(d, 1))[0]
    assert first == ["tom_order", "model_input_scope", "private_fields_usage", "first_order_observer"]


def test_typed_lines(spark, tmp_path):
    for name, body, error in [("a", '{"seed": "oops"}\n', "type:seed"), ("b", "", "empty"), ("c", '{"seed": 1}\n{"seed": 2}\n', "mixes 2"), ("d", '{"seed": 1.5}', "type:seed")]:
        (tmp_path / name).write_text(body)
        with pytest.raises(ValueError, match=error):
            jsonl.read_strict(spark, str(tmp_path / name), "seed long", ["seed"], ["seed"])
    (tmp_path / "e").write_text('{"seed": 1}\n{"seed": null}\n')
    assert [r.seed for r in jsonl.read_strict(spark, str(tmp_path / "e"), "seed long", ["seed"]).orderBy("line_no").collect()] == [1, None]


def test_arrays_and_folders(spark, tmp_path):
    for game, body in {"g1": '[{"a": 1}, 2]', "g2": '{"a": 1}'}.items():
        (tmp_path / game).mkdir()
        (tmp_path / game / "game_log.json").write_text(body)
    (tmp_path / "g3").mkdir()
    (tmp_path / "g3" / "other.txt").write_text("x")
    logs, missing = jsonl.game_logs(spark, str(tmp_path))
    assert sorted((r.place, r.value) for r in logs.where("place is not null").collect()) == [(0, '{"a":1}'), (1, "2")] and logs.where("place is null").count() == 1
    assert [r.folder.endswith("g3") for r in missing.collect()] == [True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.5)], "game_id string, event_idx long, p double")
    jsonl.write_predictions(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(FileExistsError):
        jsonl.write_staged(df, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="repeated"):
        jsonl.write_predictions(df.unionByName(df), str(tmp_path / "new"))
    with pytest.raises(Exception):
        jsonl.write_staged(df.withColumn("x", F.raise_error(F.lit("stop"))), str(tmp_path / "new"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    jsonl.write_roles(spark.createDataFrame([("g", 1, "seer", "m", "secret")], "game_id string, player int, role string, model string, more string"), str(tmp_path / "roles"))
    assert spark.read.json(str(tmp_path / "roles")).columns == ["game_id", "model", "player", "role"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, "parse_error" if i % 50 == 7 else "semantic_error" if i in (110, 111, 112, 113, 114) else "ok") for i in range(200)], "seq long, observer long, status string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = stream.total_flags(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    want, bad, parse = set(), 0, 0
    for r in rows.orderBy("seq").collect():
        bad, parse = bad + (r.status != "ok"), parse + (r.status == "parse_error")
        if r.seq >= 99:
            want |= {(r.seq, "total_rate")} if bad / (r.seq + 1) > 0.05 else {(r.seq, "parse_rate")} if parse / (r.seq + 1) > 0.01 else set()
    assert {(r.seq, r.rule) for r in spark.table("totals").collect()} == want and {r for _, r in want} == {"total_rate", "parse_rate"}


def test_small_checks(spark):
    counts = spark.createDataFrame([(0.5,), (0.01,)], "supervised_fraction double")
    with pytest.raises(ValueError, match="0.01"):
        beliefs.require_coverage(counts)
    beliefs.require_coverage(counts.where("supervised_fraction > 0.1"))
    with pytest.raises(ValueError, match="twice"):
        relations.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "twice")
    labels = {'{"response_format": {"type": "json_object"}}': "json_object", '{"response_format": {"type": "json_schema", "json_schema": {"name": "plan"}}}': "json_schema:plan", "{}": "text"}
    assert {r.j: r.r for r in spark.createDataFrame([(k,) for k in labels], "j string").select("j", relations.request_label(F.col("j")).alias("r")).collect()} == labels
