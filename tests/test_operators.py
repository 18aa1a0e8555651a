"""Hand-computed cases of the operators and sources."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from veldra.functions import domain, text
from veldra.operators import beliefs, games, monitor, snapshots, splits
from veldra.plans import adapters, catalog
from veldra.sources import jsonl

def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] or [(1,)], list(values) or ["x"]).select(column.alias("r")).first()["r"]


def targets(spark, suspected, known, cleared):
    rows = spark.createDataFrame([(1, known, cleared, suspected)], "report_id int, known array<int>, cleared array<int>, suspected array<int>")
    return {(r.a, r.b): r.p for r in beliefs.targets(rows).collect()}


def test_projection_goldens(spark):
    assert set(targets(spark, [], [], []).values()) == {1 / 21}
    none = targets(spark, [], [], [1])
    assert len(none) == 15 and set(none.values()) == {1 / 15}
    soft = targets(spark, [2, 3], [], [1])
    assert soft[2, 3] == 2 * soft[2, 4] == 4 * soft[4, 5]
    wolf = targets(spark, [2], [2], [1])
    assert len(wolf) == 5 and set(wolf.values()) == {1 / 5}
    assert targets(spark, [2, 3], [2, 3], [1, 4, 5, 6, 7]) == {(2, 3): 1.0}


def test_metric_goldens(spark):
    rows = spark.createDataFrame([([0.0] * 21, [1.0] + [0.0] * 20)], "logits array<double>, target array<double>")
    r = beliefs.row_metrics(rows).first()
    assert r.kl == pytest.approx(math.log(21)) and r.cross_entropy == pytest.approx(math.log(21)) and r.tv == pytest.approx(20 / 21) and r.margin == 0


def reports(spark, statuses, observer=1):
    return spark.createDataFrame([(i, 1, observer, s) for i, s in enumerate(statuses)], "seq long, game long, observer long, status string")


def test_streaks_and_stops(spark):
    p, s, r = "parse_error", "semantic_error", "reporter_error"
    assert [x.streak for x in monitor.streaks(reports(spark, [p, p, p])).orderBy("seq").collect()] == [1, 2, 3]
    assert max(x.streak for x in monitor.streaks(reports(spark, [p, p, s, p, r, r])).collect()) == 2
    assert monitor.first_stop(reports(spark, [p, p, p])).first().rule == "1_streak"
    assert not monitor.first_stop(reports(spark, [p, "ok"] + ["ok"] * 3 + [s] + ["ok"] * 4)).collect()  # 20 % of ten
    assert monitor.first_stop(reports(spark, [p, "ok", s, "ok", p] + ["ok"] * 5)).first().rule == "2_observer_rate"


def test_running_totals_follow_a_loop(spark):
    rng = random.Random(1)
    statuses = [rng.choice(["ok", "ok", "parse_error", "semantic_error"]) for _ in range(300)]
    bad = parse = 0
    for i, row in enumerate(monitor.total_rates(reports(spark, statuses)).orderBy("seq").collect()):
        bad, parse = bad + (statuses[i] != "ok"), parse + (statuses[i] == "parse_error")
        assert (row.total, row.total_invalid_rate, row.total_parse_rate) == (i + 1, bad / (i + 1), parse / (i + 1))


def test_call_audit(spark):
    calls = spark.createDataFrame([(1, "gameplay", "ok", 1.0), (2, "gameplay", "error", 9.0)], "call_id long, category string, dispatch string, latency_ms double")
    r, total = monitor.call_audit(calls).orderBy(F.col("category").desc()).collect()
    assert r.category == "gameplay" and total.category is None and tuple(r)[1:] == tuple(total)[1:]
    assert (r.mean_ms, r.median_ms, r.p95_ms, r.max_ms, r.errors) == (5, 5, 9, 9, 1)


def test_names_phases_json(spark):
    for given, want in [("3", "player3"), ("Player_3", "player3"), ("player 3", "player3"), ("8", None), ("", None), (None, None), ("x3", None)]:
        assert spark.createDataFrame([(given,)], "x string").select(domain.player(F.col("x"))).first()[0] == want
    phase = lambda p: one(spark, domain.phase_parts(F.col("p")), p=p)
    assert phase("2_day_speech_pk").kind == "speech_pk" and phase("0_night_skill_wolf").day == 0
    assert phase("0_day_speech") is None and phase("1_night_vote") is None and phase("x") is None
    raw = '{"b": [1, {"z": "猫", "a": null}], "a": 1}'
    assert one(spark, domain.canonical_json(F.col("j")), j=raw) == json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, domain.seed_of(F.col("g")), g="run_seed_12") == 12


def test_decision_and_rotation(spark):
    assert one(spark, domain.decision(F.col("r")), r=0.99).choice == "P" and one(spark, domain.decision(F.col("r")), r=0.01).choice == "N"
    assert one(spark, domain.rotated(F.col("a"), F.lit(3)), a=[1, 2, 3, 4]) == [3, 4, 1, 2]
    assert one(spark, domain.learning_rate(F.col("s"), 10, 110, 1.0), s=5) == 0.5


def triples(acts):
    return [tuple(x) for x in acts]


def test_text_actions(spark):
    said = "```\n- Player 1 | point_as_werewolf | 4\nplayer1｜CHECK_AS_WEREWOLF｜ player 4\n2 | fly | 3\n\"3 | support | 3\",\nplayer_2 | save | 1\nnone\n```"
    raw = one(spark, text.triplets(F.col("t")), t=said)
    assert triples(raw) == [("Player 1", "point_as_werewolf", "4"), ("player1", "CHECK_AS_WEREWOLF", "player 4"), ("2", "fly", "3"), ("3", "support", "3")]
    acts = text.normalised(text.triplets(F.col("t")), F.lit(5))
    assert triples(one(spark, acts, t=said)) == [("player5", "point_as_werewolf", "player4"), ("player5", "check_as_werewolf", "player4"), ("player5", "support", "player3")]
    assert [x.action for x in one(spark, text.without_superseded(acts), t=said)] == ["check_as_werewolf", "support"]
    assert one(spark, text.rejected_lines(F.col("t")), t="1 | save | 2\nNONE\nx") == ["NONE", "x"] and one(spark, text.rejected_lines(F.col("t")), t="a\nb") == []
    for marker, want in [("None.", True), (" `NO  ACTION`! ", True), ("[]", True), ("没有动作。", True), ("n/a", False), ("-", False), ("", False)]:
        assert one(spark, text.is_empty_marker(F.col("t")), t=marker) == want
    merged_ = one(spark, text.merged(text.normalised(text.triplets(F.col("t")), F.lit(1)), text.normalised(text.triplets(F.col("u")), F.lit(1))), t="1|save|2\n1|guard|3", u="1|guard|3\n1|save|4")
    assert [(x.action, x.object) for x in merged_] == [("save", "player2"), ("guard", "player3"), ("save", "player4")]


def test_claims_and_references(spark):
    claims = lambda t, k=4: [x.action for x in one(spark, text.role_claims(F.col("t"), F.col("k")), t=t, k=k)]
    assert claims("我是 3号玩家，身份是预言家。我的身份：一名女巫；我是女巫") == ["point_as_seer", "point_as_witch"]
    assert claims("他说我是狼人") == [] and claims("我不是狼人") == [] and claims("我是好人") == [] and claims("我是狼人", 9) == []
    refs = lambda t, k=0: one(spark, text.references(F.col("t"), F.col("k")), t=t, k=k)
    assert refs("player 3 和 1、二，5号玩家, 玩家六, 第7号, 12号") == [1, 2, 3, 5, 6, 12]
    assert refs("我自己", 2) == [2] and refs("他自己", 2) == [] and refs("nobody", 2) == []


def test_speech_and_plan_faults(spark):
    fault = lambda t, why="stop", who=1, plan=None: spark.createDataFrame([(t, why, who, plan)], "t string, w string, k int, p array<int>").select(text.speech_fault(F.col("t"), F.col("w"), F.col("k"), F.col("p"))).first()[0]
    assert fault(" \n") == "empty" and fault("x", "length") == "truncated" and fault("9号") == "bad_reference" and fault(" {1}") == "structured" and fault("the game_log") == "control_text"
    assert fault("我投2号", plan=[2]) is None and fault("3号", plan=[2]) == "unplanned" and fault("hm", plan=[2]) == "missing" and fault(None) == "empty"
    plan = lambda acts, role="Seer": spark.createDataFrame([(acts, [2, 3], 1, role)], "p array<struct<action:string,target:int>>, s array<int>, k int, r string").select(text.plan_fault(F.col("p"), F.col("s"), F.col("k"), F.col("r"))).first()[0]
    assert plan([("save", 2)]) is None and plan(None) == "no_plan" and plan([("fly", 2)]) == "action" and plan([("save", 8)]) == "target" and plan([("vote_intent", 4)]) == "not_suggestible"
    assert plan([("oppose", 1)]) == "opposes_itself" and plan([("point_as_werewolf", 1)], "Werewolf") == "discloses_itself" and plan([("point_as_werewolf", 1)]) is None


def test_votes_and_choices(spark):
    cases = {"{'投票': '3'}": 3, '{"投票玩家": 5}': 5, "- {'投票': '否'}": 0, "投票：4号。": 4, "投票: abstain": 0, "none": None, '{"投票": -1}': None, None: None, "```json\n{\"投票\": \"player 6\"}\n```": 6}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.vote_target(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    picks = {'{"action_index": 1}': "b", "{'action_index': 0}": "a", '{"action_index": 2}': None, '{"action_index": true}': None, '{"action_index": 0, "x": 1}': None, "[0]": None, '{"action_index": -1}': None}
    rows = spark.createDataFrame([(k,) for k in picks], "t string").select("t", text.chosen_action(F.col("t"), F.array(F.lit("a"), F.lit("b"))).alias("r")).collect()
    assert {r.t: r.r for r in rows} == picks


def test_night(spark):
    dead = lambda k, g, h, p: spark.range(1).select(games.night(*[F.lit(x).cast("int") for x in (k, g)], F.lit(h), F.lit(p).cast("int"))).first()[0]
    assert dead(3, None, False, None) == [3] and dead(3, 3, False, None) == [] and dead(3, 3, True, 5) == [3, 5] and dead(None, 2, False, None) == []


def test_splits(spark):
    games_ = spark.createDataFrame([(f"g{i:02d}",) for i in range(12)], "game_id string")
    want = sorted(f"g{i:02d}" for i in range(12))
    random.Random(3).shuffle(want)
    got = splits.shuffled_split(games_, {"train": 8, "validation": 2, "test": 2}, 3)
    assert {r.game_id for r in got.where("split = 'train'").collect()} == set(want[:8])
    splits.require_empty(splits.leaking(got), "leaks")
    with pytest.raises(ValueError):
        splits.shuffled_split(games_, {"train": 1}, 3)
    with pytest.raises(ValueError):
        splits.require_empty(got, "rows")


def test_strict_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a":1,"b":"x"}\n{"b":"y","a":2}\n')
    rows = jsonl.read_strict(spark, str(good), "a long, b string", ["a", "b"]).orderBy("line_no").collect()
    assert [(r.line_no, r.a, r.b) for r in rows] == [(1, 1, "x"), (2, 2, "y")] and rows[1].raw == '{"b":"y","a":2}'
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a":1,"b":"x"}\n\n{"a":1,"c":2}\n[1]\n')
    found = {r.line_no: r.violations for r in jsonl.violations(jsonl.numbered(spark, str(bad)), ["a", "b"]).collect()}
    assert found == {1: [], 2: ["blank"], 3: ["missing:b", "unknown:c"], 4: ["not_an_object"]}
    with pytest.raises(ValueError, match="line 2"):
        jsonl.read_strict(spark, str(bad), "a long, b string", ["a", "b"])
    with pytest.raises(ValueError):
        jsonl.write_audit(spark.createDataFrame([(1,)], "secret int"), str(tmp_path / "audit"))


def test_stream_equals_batch(spark, tmp_path):
    from veldra.streaming.monitor import observer_flags

    statuses = ["parse_error"] * 3 + ["ok"] * 9 + ["semantic_error", "parse_error"] * 2
    rows = reports(spark, statuses)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = observer_flags(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("flags").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.seq, r.rule) for r in spark.table("flags").collect()}
    batch = monitor.observer_rates(monitor.streaks(rows))
    want = {(r.seq, "streak" if r.streak >= 3 else "observer_rate") for r in batch.where("streak >= 3 or (seen >= 10 and invalid_rate > 0.2)").collect()}
    assert got == want


REPORT = "snapshot long, observer int, speaker int, public_only boolean, status string, error string, known array<int>, cleared array<int>, suspected array<int>"


def test_decisions_and_orders(spark):
    rows = [
        (1, 1, 1, False, "ok", None, [], [1], [3]),
        (1, 2, 1, False, "semantic_error", "e", [4, 5], [2], None),
        (1, 3, 1, False, "semantic_error", "e", [], [3], None),
        (1, 4, 1, None, "parse_error", "e", [4, 5], None, None),
        (2, 5, 5, True, "semantic_error", "e", [1, 2], [5], None),
        (3, 6, 6, False, "semantic_error", "e", [1, 2, 3], [6], None),
        (3, 7, 6, None, None, None, None, None, None),
    ]
    decided = snapshots.decisions(spark.createDataFrame(rows, REPORT))
    got = {(r.snapshot, r.observer): (r.kind, r.target, r.n_compatible) for r in decided.collect()}
    assert got[1, 1] == ("source", [3], None)
    assert got[1, 2] == ("deterministic_hard_knowledge", [4, 5], 1)
    assert got[1, 3] == ("unavailable", None, 15) and got[1, 4][0] == "unavailable"
    assert got[2, 5] == ("unavailable", None, None)
    assert got[3, 6] == ("unavailable", None, 0) and got[3, 7] == ("unavailable", None, None)
    assert [(r.snapshot, r.observer) for r in snapshots.first_order(decided).collect()] == [(1, 1)]
    second = snapshots.second_order(decided, ["snapshot"]).collect()
    assert [(r.snapshot, r.observers, r.target) for r in second] == [(1, [1, 2], {1: [3], 2: [4, 5]})]
    assert not snapshots.second_order(decided.where("false"), ["snapshot"]).collect()


def test_report_violations(spark):
    rows = [
        (1, 1, 1, False, "ok", None, [], [1], [3]),
        (2, 1, 1, False, "ok", "e", [3], [1], [1]),
        (3, 1, 1, False, "lost", None, [1, 2, 3], [], None),
        (4, 1, 1, False, "parse_error", "e", [2, 3], [1, 4, 5, 6, 7], None),
    ]
    found = snapshots.report_violations(spark.createDataFrame(rows, REPORT)).orderBy("snapshot").collect()
    assert [r.violations for r in found] == [[], ["error_against_status", "known_not_suspected", "cleared_suspected"], ["unknown_status", "contradiction", "error_against_status"], []]
    samples = snapshots.raw_samples(spark.createDataFrame(rows, REPORT), ["snapshot"]).orderBy("snapshot").collect()
    assert samples[0].observers == [1] and samples[0].suspected == {1: [3]} and samples[3].suspected == {1: None}


def test_rotation(spark):
    row = [(6, [6, 1], [7, 2], {7: "x"}, {1: [7, 3], 2: None}, [(6, 7), (7, None)])]
    df = spark.createDataFrame(row, "speaker int, observers array<int>, dead array<int>, status map<int,string>, suspected map<int,array<int>>, votes array<struct<voter:int,target:int>>")
    turn = lambda k: snapshots.rotated_rows(df, F.lit(k), ("speaker",), ("observers",), ("dead",), ("status",), ("suspected",), ("votes",)).first()
    r = turn(2)
    assert (r.speaker, r.observers, r.dead, r.status, r.suspected) == (1, [1, 3], [2, 4], {2: "x"}, {3: [2, 5], 4: None})
    assert [tuple(v) for v in r.votes] == [(1, 2), (2, None)]
    assert turn(7).speaker == 6 and turn(0).votes == turn(7).votes
    assert snapshots.orbit(df).count() == 7


def test_hard_knowledge_cases(spark):
    log = [
        (1, 2, "Werewolf", "werewolf_team_info", None, None, [2, 5]), (1, 2, "Werewolf", "vote", 3, None, None),
        (2, 1, "Seer", "skill_seer", 4, "bad", None), (2, 1, "Seer", "skill_seer", 5, "good", None), (2, 1, "Seer", "skill_seer", 6, None, None), (2, 1, "Seer", "kill_decision", 7, None, None),
        (3, 1, "Witch", "kill_decision", 3, None, None), (3, 1, "Witch", "kill_decision", 0, None, None), (3, 1, "Witch", "skill_seer", 4, "bad", None),
        (4, 1, "Villager", None, None, None, None), (5, 1, "Seer", "skill_seer", 1, "bad", None),
    ]
    df = spark.createDataFrame(log, "game long, observer int, identity string, event string, target int, checked string, team array<int>")
    got = {r.game: (r.known, r.cleared, r.n_compatible) for r in snapshots.hard_knowledge(df, ["game"]).collect()}
    assert got == {1: ([2, 5], [1, 3, 4, 6, 7], 1), 2: ([4], [1, 5], 4), 3: ([], [1, 3], 10), 4: ([], [1], 15), 5: (None, None, 0)}


def test_json_in_free_text(spark):
    cases = {
        '["\\ud800"]': None, "[NaN]": None,         " [1, 2] ": "[1,2]", '{"a": [1]}': "[1]", "x ```json\n[3]\n``` [4]": "[3]", "```\n{}\n``` then [bad] [5, [6]] [7]": "[5,[6]]", "none": None, "": None, "[" * 5000: None, '["é"]': '["é"]',
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", text.first_json_array("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases | {None: None}
    like = {"{'b': (1, 2), 'a': None}": '{"a":null,"b":[1,2]}', '```json\n{"b": 1}\n```': '{"b":1}', "open(1)": None, "": None, "{1, 2}": None}
    rows = spark.createDataFrame([(k,) for k in like] + [(None,)], "t string").select("t", text.json_like("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == like | {None: None}


def test_manifest(spark, tmp_path):
    good = {"schema_version": "s", "projection_version": "p", "total_game_count": 4, "splits": {}}
    for name, ids in {"train": ["a", "b"], "validation": ["c"], "test": ["d"]}.items():
        good["splits"][name] = {"game_ids": ids, "game_count": len(ids)}
        good[f"{name}_game_count"] = len(ids)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(good, indent=1))
    assert sorted(map(tuple, jsonl.read_manifest(spark, str(path), "s", "p").collect())) == [("a", "train"), ("b", "train"), ("c", "validation"), ("d", "test")]
    good["splits"]["test"]["game_ids"] = ["a", "a", " "]
    path.write_text(json.dumps(good))
    assert jsonl.manifest_violations(spark, str(path), "x", "p") == ["schema_version", "test:invalid_id", "test:duplicates", "test:game_count", "test:test_game_count", "overlap"]
    with pytest.raises(ValueError, match="overlap"):
        jsonl.read_manifest(spark, str(path), "s", "p")
    path.write_text("no json")
    assert "split_names" in jsonl.manifest_violations(spark, str(path), "s", "p")


def test_private_field_names(spark):
    cases = {'{"a":{"Memory":[{"x":1}]}}': ["a", "memory", "x"], '{"a":"\\"memory\\":1","b\\\\":["memory",":"]}': ["a", "b"], "[]": [], "no json": None, None: None, '{"k":"' + '\\"' * 20000 + '"}': ["k"]}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", snapshots.field_names(F.col("j")).alias("r")).collect()
    assert {r.j: r.r for r in rows} == cases


def test_frozen_snapshot(spark):
    rows = [
        ("g", 3, "1_day_speech", 2, "t", [(0, "phase_change", "1_day_speech", None, None), (1, "turn_start", None, "player2", None)]),
        (" ", -1, "0_day_speech", 9, None, []),
        (None, None, None, None, "t", None),
        ("g", 0, "1_day_speech", 2, "t", [(0, "phase_change", "1_day_vote", None, None), (2, "public_speech", None, "player2", [["player2", "a", "player3"]])]),
    ]
    df = spark.createDataFrame(rows, f"game_id string, step_idx long, phase string, speaker int, report_trigger string, events {snapshots.EVENTS}")
    good, bare, null, late = snapshots.frozen(df, ("t",)).collect()
    assert good.violations == [] and good.public_action_count == 0 and good.label_cutoff_step_idx == 3
    assert bare.violations == ["game_id", "step_idx", "phase", "speaker", "report_trigger", "no_events", "not_at_turn_start", "latest_phase"]
    assert null.violations == ["game_id", "step_idx", "phase", "speaker", "no_events", "event_idx", "not_at_turn_start", "latest_phase"] and null.public_event_digest is None
    assert late.violations == ["event_idx", "not_at_turn_start", "latest_phase"] and late.sp_actions == [["player2", "a", "player3"]]


def test_tampered_projection(spark):
    reports = spark.createDataFrame([(1, [], [1], [2]), (2, [2, 3], [1, 4, 5, 6, 7], [2, 3])], "k int, known array<int>, cleared array<int>, suspected array<int>")
    true = beliefs.targets(reports).select("k", "a", "b", "p")
    assert not beliefs.tampered(true, reports, ["k"]).collect()
    extra = spark.createDataFrame([(1, 1, 2, 0.0), (1, 1, 3, 0.5), (2, 2, 3, 1.0)], "k int, a int, b int, p double")
    found = beliefs.tampered(true.where("not (k = 1 and a = 6)").unionByName(extra), reports, ["k"]).collect()
    assert sorted((r.k, r.a, r.b, r.n_stored) for r in found) == [(1, 1, 3, 1), (1, 6, 7, 0), (2, 2, 3, 2)]


def test_tampered_odd_rows(spark):
    # a row without a key is of no report, even if there is a report without one
    bare = spark.createDataFrame([(None, [2, 3], [1], [2])], "k int, known array<int>, cleared array<int>, suspected array<int>")
    stored = spark.createDataFrame([(None, 2, 3, 1.0), (None, 1, 2, 0.0)], "k int, a int, b int, p double")
    assert sorted((r.due is None, r.n_stored) for r in beliefs.tampered(stored, bare, ["k"]).collect()) == [(False, 0), (True, 1)]
    twice = spark.createDataFrame([(1, [2, 3], [1], [2]), (1, [2, 4], [1], [2])], "k int, known array<int>, cleared array<int>, suspected array<int>")
    stored = spark.createDataFrame([(1, 2, 3, 1.0)], "k int, a int, b int, p double")
    assert [(r.a, r.b, r.n_stored) for r in beliefs.tampered(stored, twice, ["k"]).collect()] == [(2, 4, 0)]


def test_tampered_pairs_are_spread(spark, monkeypatch):
    """No task holds more than its share of the reports, however few row groups they come from, and pairs are neither sorted nor joined."""
    monkeypatch.setattr(beliefs, "REPORTS_PER_TASK", 10)
    reports = spark.range(0, 400, 1, 1).select("id", *[F.array().cast("array<int>").alias(c) for c in ("known", "cleared", "suspected")])
    found = beliefs.tampered(spark.createDataFrame([], "id long, a int, b int, p double"), reports, ["id"])
    assert found.count() == 400 * 21
    per_task = found.groupBy(F.spark_partition_id()).agg(F.countDistinct("id").alias("n")).collect()
    assert len(per_task) > 30 and max(r.n for r in per_task) < 40
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["knowledge_closure", "report_violations", "pair_targets"])
def test_rows_of_one_file_are_many_tasks(spark, name):
    """The table is one file of one row group; the work inside of its rows is not left to one task."""
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_orbit_turns_sums(spark):
    """The seven turns of the audit are those of every row, but only seven rows are turned."""
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 2, 5, 7, 8, None]), r.choice([1, 4, 7, 9, None]), r.random() < 0.8, r.random() < 0.7, r.choice([None, [r.random() for _ in range(21)], [1.0] + [0.0] * 20])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, observer int, speaker int, boundary boolean, valid boolean, target array<double>")
    turns = df.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(6))))
    each = beliefs.audit_players(beliefs.turned_targets(turns, F.col("shift")), [])
    shown = lambda x: sorted((y.player, y.supervised_rows, round(y.mean_marginal, 9), y.top_count, round(y.gap, 9)) for y in x.collect())
    orbit = beliefs.audit_orbit(df)
    assert shown(orbit) == shown(each)
    plan = orbit._jdf.queryExecution().optimizedPlan().toString().splitlines()
    turned = next(i for i, x in enumerate(plan) if "Generate" in x)  # the last step that makes rows
    assert any("Aggregate" in x for x in plan[turned:])


def test_pairs_are_found_once_for_a_closure(spark):
    """The pairs are an argument of the walk over them, not of each of its steps."""
    rows = spark.createDataFrame([([2], [1])], "k array<int>, c array<int>")
    plan = rows.select(snapshots.closure(snapshots.compatible(F.col("k"), F.col("c"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except(") == 1


def test_narrow_rows_are_spread(spark):
    few = adapters.spread(spark.range(0, 1000, 1, 1), "id", per_task=20)
    assert few.rdd.getNumPartitions() == 50 and few.count() == 1000


def test_reparsed(spark):
    a, b = ("player1", "point_as_werewolf", "player2"), ("player1", "check_as_werewolf", "player2")
    rows = [(None, [a]), ("None", [a]), ("what?", [a]), ("1 | check_as_werewolf | 2\n\n", [a]), ("1 | point_as_werewolf | 2", [a]), ("1 | check_as_werewolf | 2", None)]
    df = spark.createDataFrame(rows, "t string, old array<struct<subject:string,action:string,object:string>>").select(text.reparsed(F.col("t"), F.col("old"), F.lit(1)).alias("r"))
    got = [(r.r.status, triples(r.r.actions), triples(r.r.added), triples(r.r.removed)) for r in df.collect()]
    assert got == [("missing", [a], [], []), ("empty", [], [], [a]), ("failed", [a], [], []), ("parsed", [b], [b], [a]), ("parsed", [a], [], []), ("parsed", [b], [b], [])]


def test_blocks_follow_a_loop(spark):
    """Streaks and rates by blocks against one pass in order, nulls included."""
    rng = random.Random(2)
    rows = [(i, 1, rng.randint(1, 3), rng.choice(["ok", "ok", "parse_error", "parse_error", "semantic_error", None])) for i in range(400)]
    rows += [(None, 1, 1, "ok")]
    df = spark.createDataFrame(rows, "seq long, game long, observer long, status string")
    for blocks in (1, 7, 60):
        got = {r.seq: (r.streak, r.seen, r.invalid_rate) for r in monitor.observer_rates(monitor.streaks(df, blocks), blocks).collect()}
        runs, seen, bad = {}, {}, {}
        for seq, _, o, status in rows[:-1]:
            last, n = runs.get(o, ("ok", 0))
            n = 0 if status == "ok" else n + 1 if status == last else 1
            runs[o] = (status, n)
            seen[o], bad[o] = seen.get(o, 0) + 1, bad.get(o, 0) + (status != "ok")
            assert got[seq] == (n, seen[o], bad[o] / seen[o])
        assert len(got) == 400


def test_budgets_and_stops(spark):
    calls = spark.createDataFrame([(i, 1, "gameplay" if i % 2 else "belief", "ok", 1.0) for i in range(10)] + [(20, 2, "belief", "error", 1.0)], "seq long, game long, category string, dispatch string, latency_ms double")
    assert [tuple(r) for r in monitor.refused(calls, {"gameplay": 3, "total": 9}).collect()] == [(1, 7, "gameplay")] and not monitor.refused(calls).collect()
    assert [tuple(r) for r in monitor.over_total(calls, 9, 3).collect()] == [(1, 9, 10)]
    assert sorted(map(tuple, monitor.run_summaries(calls, calls.where("game = 2")).collect())) == [(1, 5, 5, 10, 0, "partial"), (2, 0, 1, 1, 1, "completed")]
    bad = calls.withColumn("category", F.when(F.col("seq") == 0, "x").otherwise(F.col("category"))).withColumn("latency_ms", F.when(F.col("seq") != 1, F.col("latency_ms")))
    assert {r.seq: r.violations for r in monitor.call_violations(bad).where("size(violations) > 0 and seq < 2").collect()} == {0: ["call_category"], 1: ["latency_ms"]}
    p = "parse_error"
    rows = spark.createDataFrame([(i, 1, 1, s, i // 2) for i, s in enumerate([p, p, p, "ok", "ok"])], "seq long, game long, observer long, status string, sample long")
    assert [r.seq for r in monitor.until_stop(rows).orderBy("seq").collect()] == [0, 1, 2, 3] and monitor.until_stop(rows.where("seq > 2")).count() == 2
