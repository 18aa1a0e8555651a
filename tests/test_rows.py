"""Whole rows: materialization, committed splits, turns around the seats, key paths, prefix chains, quantiles, answers."""

import hashlib
import json
import math
import random
import re
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veldra.functions import responses
from veldra.functions.domain import player
from veldra.operators import beliefs, events, games, materialize, quantiles, rotation, snapshots
from veldra.plans import catalog, rows as row_plans
from veldra.sources import commit, jsonl


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sample(game, step, speaker=1, statuses=("ok", "semantic_error", "parse_error"), scope="private_conditioned", **change):
    """A raw sample of three observers: the second knows both wolves."""
    names = ["player1", "player2", "player3"]
    public = scope == "public_events_only"
    schema, prompt, provenance = events.SOURCES[scope]
    said = [{"event_idx": 0, "event_type": "phase_change", "phase": f"{step + 1}_day_speech"}, {"event_idx": 1, "event_type": "vote_result", "votes": [{"target": None, "voter": "player2"}, {"target": "player7", "voter": "player6"}]},
            {"event_idx": 2, "event_type": "public_speech", "raw_text": "player2 é", "sp_actions": [["player2", "support", "player5"]], "speaker": "player2"}, {"event_idx": 3, "event_type": "turn_start", "speaker": f"player{speaker}"}]
    rest = [f"player{i}" for i in (1, 2, 3, 4, 7)]
    return {
        "schema_version": schema, "label_prompt_version": prompt, "label_provenance": provenance, "game_id": game, "step_idx": step, "label_cutoff_step_idx": step, "phase": f"{step + 1}_day_speech", "speaker_id": speaker, "report_trigger": "pre_public_speech", "observer_ids": [1, 2, 3],
        "public_action_count": 1, "public_events": said, "suspected_werewolves": {n: ["player4"] if s == "ok" else None for n, s in zip(names, statuses)}, "known_werewolves": {"player1": [], "player2": [] if public else ["player5", "player6"], "player3": []},
        "known_non_werewolves": {"player1": [], "player2": [] if public else rest, "player3": []}, "belief_status": dict(zip(names, statuses)), "belief_errors": {n: None if s == "ok" else "bad" for n, s in zip(names, statuses)}, "agent_backend_ids": dict.fromkeys(names, "m"),
    } | change


def with_digests(spark, samples):
    texts = spark.createDataFrame([(i, json.dumps(s["public_events"])) for i, s in enumerate(samples)], "i int, e string").withColumn("p", events.parsed(F.col("e")))
    found = {r.i: r for r in texts.select("i", events.event_digest(F.col("p")).alias("d"), events.structured_digest(F.col("p")).alias("s")).collect()}
    return [s | {"public_event_digest": found[i].d, "structured_input_digest": found[i].s} for i, s in enumerate(samples)]


def put(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))
    return str(path)


def lines(folder):
    return [x for p in sorted(Path(folder).glob("part-*")) for x in p.read_text().splitlines()]


@pytest.mark.parametrize("scope", list(events.SOURCES))
def test_materialize(spark, tmp_path, scope):
    private = scope == "private_conditioned"
    raw = [sample("g1", 0, 1, scope=scope), sample("g1", 1, 2, scope=scope), sample("g2", 0, 3, scope=scope), sample("g3", 0, 1, ("parse_error",) * 3, scope=scope)]
    folders = {p: str(tmp_path / "out" / p) for p in materialize.PARTS}
    got = commit.materialize(spark, put(tmp_path / "raw", with_digests(spark, raw)), folders)
    assert got == {"snapshots": 4, "first_scope": scope, "semantic_errors": 3, "recovered": 3 if private else 0, "unresolved": 6 if private else 9}
    rows = {p: [json.loads(x) for x in lines(f)] for p, f in folders.items()}
    assert sorted((r["game_id"], r["step_idx"], *r["observer_ids"]) for r in rows["tom1"]) == [("g1", 0, 1)] + ([("g1", 1, 2)] if private else [])
    assert sorted((r["game_id"], r["step_idx"], *r["observer_ids"]) for r in rows["tom2"]) == [(g, s, 1, 2)[: 4 if private else 3] for g, s in (("g1", 0), ("g1", 1), ("g2", 0))]
    assert sorted((r["game_id"], r["player_id"]) for r in rows["removed_tom1"]) == ([] if private else [("g1", 2)]) + [("g2", 3), ("g3", 1)]
    assert len(rows["filtered_tom2"]) == got["unresolved"]
    if private:
        hard = next(r for r in rows["tom2"] if r["step_idx"] == 1)
        assert hard["suspected_werewolves"] == {"player1": ["player4"], "player2": ["player5", "player6"]} and hard["belief_status"] == {"player1": "ok", "player2": "ok"} and hard["belief_errors"] == {"player1": None, "player2": None}
        assert hard["source_belief_status"]["player2"] == "semantic_error" and hard["observer_annotation_confidence"] == {"player1": "source", "player2": "exact"}
    for order in (1, 2):
        text = spark.read.text(folders[f"tom{order}"])
        found = events.formal_violations(materialize.formal_from_lines(text), order).select("violations").collect()
        assert found and all(r.violations == [] for r in found)
    with pytest.raises(FileExistsError):
        commit.materialize(spark, str(tmp_path / "raw"), folders)


def test_materialize_leaves_nothing(spark, tmp_path):
    good = with_digests(spark, [sample("g1", 0)])
    for name, rows, what in [("bad", [good[0] | {"public_action_count": 5}], "public_action_count"), ("two", good + with_digests(spark, [sample("g2", 0, scope="public_events_only")]), "two lineages"), ("null", ["no json"], "break a rule")]:
        folders = {p: str(tmp_path / name / p) for p in materialize.PARTS}
        with pytest.raises(ValueError, match=what):
            commit.materialize(spark, put(tmp_path / f"{name}.jsonl", rows), folders)
        assert not (tmp_path / name).exists() or not list((tmp_path / name).iterdir())


def test_all_or_nothing(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "x int")
    bad = good.withColumn("x", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        commit.write_all({str(tmp_path / "a"): good, str(tmp_path / "b"): bad})
    assert not list(tmp_path.iterdir())
    with pytest.raises(FileExistsError):  # the second place is taken while the first is renamed
        with commit.Outputs(spark, str(tmp_path / "a"), str(tmp_path / "b")) as out:
            for n in ("a", "b"):
                staged = out.staging(str(tmp_path / n))
                good.write.json(staged)
                out.move(staged, str(tmp_path / n))
            (tmp_path / "b").mkdir()
    assert [p.name for p in tmp_path.iterdir()] == ["b"]
    with pytest.raises(ValueError, match="differ"):
        commit.Outputs(spark, str(tmp_path / "c"), str(tmp_path / "c"))
    commit.write_all({str(tmp_path / "c"): good, str(tmp_path / "d"): good.limit(0)})
    assert spark.read.json(str(tmp_path / "c")).count() == 1 and (tmp_path / "d").is_dir()


def test_splits_keep_lines(spark, tmp_path):
    r = random.Random(2)
    rows = {k: [f'{{ "n": {i}, "game_id":"g{r.randrange(9)}" ,"t": "é{k}" }}' for i in range(300)] + [f'{{"game_id": "g{g}"}}' for g in range(9)] for k in (1, 2)}
    paths = [put(tmp_path / f"in{k}", v) for k, v in rows.items()]
    stats = commit.split_by_seed(spark, *paths, {"train": 5, "validation": 2, "test": 2}, 3, str(tmp_path / "out"))
    split = {}
    for k, v in rows.items():
        for s in ("train", "validation", "test"):
            kept = lines(tmp_path / "out" / f"tom{k}" / s)
            own = {json.loads(x)["game_id"] for x in kept}
            assert kept == [x for x in v if json.loads(x)["game_id"] in own]  # byte for byte, in order
            assert stats[f"tom{k}", s] == {"assigned": len(own), "represented": len(own), "lines": len(kept)}
            assert split.setdefault(s, own) == own
    assert sorted(map(len, split.values())) == [2, 2, 5] and len(set().union(*split.values())) == 9
    manifest = spark.createDataFrame([(f"g{g}", "train" if g else "test") for g in range(8)], "game_id string, split string")
    table = jsonl.numbered(spark, paths[0]).withColumn("game_id", F.get_json_object("value", "$.game_id"))
    with pytest.raises(ValueError, match="absent"):
        commit.split_by_manifest({"a": table}, manifest, str(tmp_path / "no"), ("train", "test"))
    with pytest.raises(ValueError, match="twice"):
        commit.split_by_manifest({"a": table}, manifest.unionByName(manifest), str(tmp_path / "no"), ("train", "test"))
    assert not (tmp_path / "no").exists() or not list((tmp_path / "no").iterdir())
    put(tmp_path / "in3", ['{"game_id": "other"}'])
    with pytest.raises(ValueError, match="only one order"):
        commit.split_by_seed(spark, paths[0], str(tmp_path / "in3"), {"train": 9}, 1, str(tmp_path / "no"))


def test_formal_split(spark, tmp_path):
    raw = with_digests(spark, [sample(f"g{g}", s, 1 + s % 2) for g in range(4) for s in range(3)])
    folders = {p: str(tmp_path / p) for p in materialize.PARTS}
    commit.materialize(spark, put(tmp_path / "raw", raw), folders)
    manifest = spark.createDataFrame([("g0", "train"), ("g1", "train"), ("g2", "validation"), ("g3", "train"), ("g9", "test")], "game_id string, split string")
    stats = commit.split_formal(spark, folders["tom1"], folders["tom2"], manifest, str(tmp_path / "split"))
    assert stats["tom2", "train"] == {"assigned": 3, "represented": 3, "lines": 9} and stats["tom1", "test"] == {"assigned": 1, "represented": 0, "lines": 0} and (tmp_path / "split/tom1/test").is_dir()
    with pytest.raises(ValueError, match="order 1"):
        commit.split_formal(spark, folders["tom2"], folders["tom2"], manifest, str(tmp_path / "no"))


def plain_turn(v, s):
    if isinstance(v, str):
        return f"player{(int(v[6]) - 1 + s) % 7 + 1}" if re.fullmatch("player[1-7]", v) else v
    if isinstance(v, dict):
        return {plain_turn(k, s): x if k in ("raw_text", "game_id") else plain_turn(x, s) for k, x in v.items()}
    if isinstance(v, list):
        out = [plain_turn(x, s) for x in v]
        if out and all(isinstance(x, str) and re.fullmatch("player[1-7]", x) for x in v):
            return sorted(out)
        return sorted(out, key=lambda x: x["voter"]) if out and all(isinstance(x, dict) and "voter" in x for x in out) else out
    return v


def test_turns(spark):
    raw = with_digests(spark, [sample("player3", 1, 2), sample("g", 0, 1)])
    rows = materialize.from_lines(spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in raw], "value string"))
    formal = materialize.parts(rows).where("part = 'tom2'").select("row.*")
    before = {r.game_id: r.asDict() for r in formal.collect()}
    for s in range(1, 8):
        turned = rotation.turned_samples(formal, F.lit(s))
        assert all(r.violations == [] for r in events.formal_violations(turned, 2).select("violations").collect())  # digests fit, too
        for r in turned.collect():
            old = before[r.game_id]
            assert json.loads(r.events) == plain_turn(json.loads(old["events"]), s) and r.events == canonical(json.loads(r.events))
            assert r.observer_ids == [(x - 1 + s) % 7 + 1 for x in old["observer_ids"]] and r.speaker_id == (old["speaker_id"] - 1 + s) % 7 + 1
            for m in events.FORMAL_MAPS:
                assert getattr(r, m) == plain_turn(old[m], s)
            if s == 7:
                assert r.public_event_digest == old["public_event_digest"] and r.structured_input_digest == old["structured_input_digest"] and r.observer_ids == old["observer_ids"]
    with pytest.raises(Exception, match="order 2"):
        rotation.turned_samples(formal.withColumn("tom_order", F.lit(1)), F.lit(1)).collect()
    shifts = spark.createDataFrame([(3, 5, 6), (0, 0, 0), (None, 1, 1), (1, -1, 1)], "a int, b int, c int").select(rotation.shift_of(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [x.s for x in shifts] == [0, 0, None, None]


def test_digest_of_incomplete_events(spark):
    cases = {'[{"event_idx":0,"event_type":"phase_change","phase":"1_day_speech"},{"event_idx":1,"event_type":"exile_result"}]': None, '[{"event_idx":0,"event_type":"vote_result"}]': None, '[{"event_idx":0,"event_type":"public_speech","speaker":"player1","raw_text":"x"}]': None,
             '[{"event_idx":0,"event_type":"party"}]': None, "[]": hashlib.sha256(b"[]").hexdigest(), "no": None}
    got = spark.createDataFrame([(c,) for c in cases], "e string").select("e", events.event_digest(events.parsed(F.col("e"))).alias("d")).collect()
    assert {r.e: r.d for r in got} == cases


def plain_paths(value, names, path="root"):
    if isinstance(value, dict):
        for k, v in value.items():
            if k in names:
                yield f"{path}.{k}"
            yield from plain_paths(v, names, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_paths(v, names, f"{path}[{i}]")


def test_key_paths(spark):
    deep = {"role": 1}
    for _ in range(150):
        deep = {"x": [deep]}
    values = [{"role": {"role": [1, {"Role": 2, "identity": None}]}, "a'b": 3}, [[{"identity": []}], {"x": {"role": "role"}}], {"roles": 1}, {"note": 'say "role": 1'}, 5, deep, {}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "no json {"), (0, json.dumps(values[0]))]
    names = ("role", "identity", "a'b")
    got = sorted((r.i, r.path) for r in snapshots.key_paths(spark.createDataFrame(rows, "i int, j string"), "j", names).collect())
    assert got == sorted((i, p) for i, v in [*enumerate(values), (0, values[0])] for p in plain_paths(v, names))
    kinds = {r.path: r.kind for r in snapshots.key_paths(spark.createDataFrame(rows[:2], "i int, j string"), "j", names).collect()}
    assert kinds["root.role"] == "OBJECT" and kinds["root.role.role"] == "ARRAY" and kinds["root.role.role[1].identity"] == "VOID"
    assert not snapshots.key_paths(spark.createDataFrame([], "i int, j string"), "j", names).collect()


def test_prefix_chain(spark):
    kind = "game string, row_idx int, events array<struct<a:int,b:int>>"
    rows = [("g", 0, []), ("g", 1, [(1, None)]), ("g", 2, [(1, None), (2, 2)]), ("g", 3, [(None, 1), (2, 2), (3, 3)]), ("g", 4, [(None, 1), (2, 2), (3, 3)]), ("g", 5, [(None, 1), (2, 2), (3, 3), None]), ("g", 6, [(None, 1), (2, 2), (3, 3), None, (1, 1)]), ("g", 7, None), ("h", 0, None), ("h", 1, [(1, 1)])]
    df = spark.createDataFrame(rows, kind)
    assert sorted((r.game, r.row_idx) for r in games.broken_prefixes(df).collect()) == [("g", 3), ("g", 4), ("g", 7)]
    plan = games.broken_prefixes(df)._jdf.queryExecution().executedPlan().toString()
    assert "chain" in next(x for x in plan.splitlines() if "Exchange" in x or "Sort" in x) or "Exchange" in plan


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles(spark, n):
    r = random.Random(n)
    values = {g: [r.choice([r.gauss(0, 1), 0.0, -0.0, 5.0, 1e300, -1e-300, 2.0**-1040, float(r.randint(-5, 5))]) for _ in range(n)] for g in ("a", None)}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {x.g: x for x in quantiles.quantiles(df, ["g"], "v", {"median": 0.5, "low": 0.1}, {"p95": 0.95, "first": 0.0, "last": 1.0}).collect()}
    assert set(found) == {"a", None}
    for g, vs in values.items():
        s = sorted(vs)
        assert math.isclose(found[g].median, statistics.median(s), rel_tol=1e-12) and found[g].p95 == s[math.ceil(0.95 * n) - 1] and found[g].first == s[0] and found[g].last == s[-1]
        at = 0.1 * (n - 1)
        assert math.isclose(found[g].low, s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at)), rel_tol=1e-9, abs_tol=1e-320)
    assert "percentile" not in quantiles.quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["materialized_rows", "turned_samples"])
def test_samples_are_made_once_by_many_tasks(spark, name):
    """One pass over one scan, without a join, and not one task for one file."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    assert df.rdd.getNumPartitions() > 1


def test_formal_rows_of_both_orders(spark):
    """Rows of both orders in one table are judged as each order's own rows are."""
    parts = materialize.parts(row_plans._samples(spark, "/root/testdata/sf0.001")).where("row is not null")
    mixed = parts.select("part", "row.*")
    order = F.when(F.col("part") == "tom1", 1).otherwise(2)
    odd = mixed.withColumn("tom_order", F.lit(1)).withColumn("model_input_scope", F.lit("public_events_only"))
    got = events.formal_violations(odd, order).groupBy("part", "violations").count()
    due = [events.formal_violations(odd.where(F.col("part") == f"tom{k}"), k).groupBy("part", "violations").count() for k in (1, 2)]
    assert sorted(map(str, got.collect())) == sorted(str(r) for d in due for r in d.collect())
    assert got.where(F.array_contains("violations", "tom_order") & (F.col("part") == "tom1")).isEmpty()


def test_quantiles_read_their_rows_once(spark, tmp_path):
    """All rounds, and a summary beside them, share one scan and one shuffle of the values."""
    spark.createDataFrame([(i % 3, float(i % 50)) for i in range(1000)] + [(1, None), (7, None)], "g int, value double").write.parquet(str(tmp_path / "v"))
    df = beliefs.summaries(spark.read.parquet(str(tmp_path / "v")), ["g"])
    found = {r.g: (r["count"], r["min"], r["median"], r["max"]) for r in df.collect()}
    assert found[7] == (0, 0.0, 0.0, 0.0) and found[1] == (333, 0.0, 25.0, 49.0)
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


ANSWERS = [
    None, "", "总结：\n**昨夜**： 平安 \n**发言**：1号\n好**昨夜**：死2号#投票原因： 他可疑。\n基于上述分析，可以预测玩家身份为： 1号玩家是狼人。２号玩家是村民。1号玩家是预言家。\n综上，投3号", "总结：前文\n综上，我弃票 5", "没有", "# 综上，投 7 号 8", "投票原因：根据上述观察，可以做出如下分析：x。\n基于上述", "主观身份判断： 1号狼 \r\n x", "弃票 3", "先 1 后 ２",
]


def plain_note(text):
    text = text.replace("#投票原因", "投票原因")
    if m := re.search(r"总结：\s*(.*?)(?=投票原因)", text, re.S):
        sections = {k: v.strip() for k, v in re.findall(r"\*\*(.*?)\*\*：(.*?)(?=\*\*|#|$)", m[1], re.S)}
        return "".join(f"{k}: {v}\n" for k, v in sections.items()), sections
    m = re.search(r"总结：\s*(.*?)\n综上", text, re.S)
    return (m[1] if m else text), None


def test_answers(spark):
    t = F.col("t")
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, t string")
    got = df.select("i", responses.note(t).alias("note"), responses.vote_reason(t).alias("reason"), responses.predicted_roles(t).alias("roles"), responses.subjective_roles(t).alias("own"), responses.vote_response(t).alias("vote")).collect()
    for r in got:
        a = ANSWERS[r.i]
        if a is None:
            assert r.note is r.reason is r.roles is r.own is r.vote is None
            continue
        assert (r.note.note, r.note.sections) == plain_note(a)
        m = re.search(r"投票原因：\s*(.*?)。\n基于上述", a.replace("# 综上，", "综上，"), re.S)
        assert r.reason == (m[1].strip() if m else a).replace("根据上述观察，可以做出如下分析：", "")
        m = re.search(r"基于上述分析，可以预测玩家身份为：\s*(.*?)\s*。\n综上", a, re.S)
        assert r.roles == {int(k): v for k, v in re.findall(r"(\d+)号玩家是(.*?)。", m[1].strip() if m else a)}
        m = re.search(r"主观身份判断：\s*(.*?)\n", a + "\n", re.S)
        assert r.own == (m[1].strip() if m else None)
        digits = re.findall(r"\d+", a.split("综上")[-1]) if "综上" in a else [] if "弃票" in a else re.findall(r"\d+", a)
        assert r.vote.vote == (int(digits[0 if "综上" in a else -1]) if digits else -1)
    forms = ['{"解药": "是", "毒药": "否", "原因": "x"}', '{"杀害": "3号"}', '{"查验": 2}', "[]", "no", None, '{"守卫": "1号", "原因": "y"}']
    roles = ["Witch", "Werewolf", "Witch", "Seer", "Guard", "Guard", "Guard", "King"]
    rows = [(i, roles[i], f) for i, f in enumerate([*forms, forms[0]])]
    night = {r.i: r.n for r in spark.createDataFrame(rows, "i int, r string, t string").select("i", responses.night_action(F.col("r"), t).alias("n")).collect()}
    assert [night[i].fault for i in range(8)] == [None, None, "missing:解药", "not_an_object", "not_an_object", "not_an_object", None, "unsupported_role"]
    assert night[0].action == {"解药": "是", "毒药": "否"} and night[0].reason == "x" and night[1].action == {"杀害": "3号"} and night[1].reason == "" and night[2].action is None
    speech = spark.createDataFrame([('{"发言": "大家好", "想要展示的身份": "村民", "身份标签": {"1号": "狼人", "2号": "好人"}, "归票": "1号"}',), ('{"归票": "2号"}',), ("plain",)], "t string").select("t", responses.speech_form(t).alias("s")).collect()
    assert speech[0].s.template == "展现自己身份为村民。把1号贴上身份标签：狼人。把2号贴上身份标签：好人。。归票：1号。" and speech[1].s.speech == speech[1].t and speech[2].s is None
    voted = spark.createDataFrame([("{'笔记': ' a ', '投票原因': 'b', '投票': '3号'}",), ("none",)], "t string").select(responses.noted_vote(t).alias("v")).collect()
    assert tuple(voted[0].v) == ("a", "b", 3) and tuple(voted[1].v) == ("", "", None)
    fenced = spark.createDataFrame([('x ```json\n {"a": 1} \n``` y',), ("```json no```",), ("none",)], "t string").select(responses.fenced_json(t).alias("f")).collect()
    assert [r.f for r in fenced] == ['{"a": 1}', None, None]
    prompt = "第1天总结：a\n第1天投票记录 # 我的投票： 3;昨晚发生：平安;"
    assert spark.createDataFrame([(prompt,)], "t string").select(responses.prompt_digest(t).alias("d")).first().d == "第1天总结：a\n\n我的投票：3\n昨晚发生：平安\n"


def test_events_are_read_once_for_both_orders(spark):
    """What the rules ask about events is found before a sample falls into rows of both orders, never after."""
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = catalog.QUERIES["materialized_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    after, before = plan.split("Generate explode", 1)
    assert "from_json" in before and "violations" in after and "from_json" not in after


def test_player_of_any_text(spark):
    due = {"player3": "player3", "3": "player3", " 3\n": "player3", "player3\n": "player3", "Player_4": "player4", "player 7": "player7", "player-1": "player1", "player8": None, "0": None, "33": None, "xplayer3": None, "": None}
    rows = spark.createDataFrame([(t,) for t in [*due, None]], "t string").select("t", player(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == due | {None: None}
    assert [r.p for r in spark.range(9).select(player(F.col("id")).alias("p")).orderBy("id").collect()] == [None, *[f"player{i}" for i in range(1, 8)], None]
