"""Stateful streams against their batch plans, on shuffled input and over restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import monitor
from veldra.streaming import collector

EVENTS = "game_id string, event_idx long, step_idx long, event string"


@pytest.fixture()
def rocks(spark):
    for k, v in collector.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in collector.STATE_STORE:
        spark.conf.unset(k)


def games(n, seed=1):
    r, rows = random.Random(seed), []
    for g in range(n):
        alive, idx, step = list(range(1, 8)), 0, 0

        def put(kind, **fields):
            nonlocal idx
            rows.append((f"g{g}", idx, step, json.dumps({"event_idx": idx, "event_type": kind, **fields})))
            idx += 1

        for day in range(1, r.randint(2, 5)):
            put("phase_change", phase=f"{day}_night_skill_wolf")
            put("death_announcement", dead_players=[f"player{alive.pop(r.randrange(len(alive)))}"] if r.random() < 0.7 else [])
            for kind in ["day_speech"] + ["day_speech_pk"] * (r.random() < 0.4):
                put("phase_change", phase=f"{day}_{kind}")
                for p in alive[: r.randint(1, 7)]:
                    step += 1
                    put("turn_start", speaker=f"player{p}")
                    put("public_speech", speaker=f"player{p}", raw_text="é" * r.randint(0, 3), sp_actions=[])
            put("phase_change", phase=f"{day}_day_vote")
            put("turn_start", speaker="player1")  # no speech phase: no sample
            put("exile_result", exiled_players=[f"player{alive.pop(0)}"] if len(alive) > 2 and r.random() < 0.6 else [])
    return rows


def as_set(rows):
    return sorted((r["game_id"], r["step_idx"], r["phase"], r["speaker"], r["report_trigger"], tuple(r["observers"]), tuple(r["events"])) for r in rows)


def plain_samples(rows):
    out = []
    for g in sorted({r[0] for r in rows}):
        own, phase, gone = {r[1]: r for r in rows if r[0] == g}, "", set()
        for i in range(len(own)):
            if i not in own:
                break
            e = json.loads(own[i][3])
            gone |= set(e.get("dead_players") or e.get("exiled_players") or [])
            phase = e.get("phase", phase)
            kind = phase.partition("_")[2]
            if e["event_type"] == "turn_start" and kind.startswith("day_speech"):
                out.append({"game_id": g, "step_idx": own[i][2], "phase": phase, "speaker": e["speaker"], "report_trigger": "pre_public_speech" + kind.removeprefix("day_speech"), "observers": [f"player{p}" for p in range(1, 8) if f"player{p}" not in gone], "events": [own[j][3] for j in range(i + 1)]})
    return as_set(out)


def test_samples_of_a_stream(rocks, tmp_path):
    rows = games(12)
    batch = rocks.createDataFrame(rows + rows[:40] + [("g1", None, 0, "{}"), (None, 0, 0, "{}"), ("bad", 0, 0, "no json"), ("gap", 1, 0, '{"event_type": "turn_start"}')], EVENTS)
    want = plain_samples(rows)
    assert as_set(collector.batch_samples(batch).collect()) == want and len(want) > 60
    assert not collector.batch_samples(batch.limit(0)).collect()
    shuffled = rows + rows[::7]
    random.Random(5).shuffle(shuffled)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k in range(3):  # three runs, each from the checkpoint of the one before
        rocks.createDataFrame(shuffled[k::3] + ([("bad", 0, 0, "no json")] if k else []), EVENTS).coalesce(2).write.mode("append").json(source)
        query = collector.collect_samples(rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source), out, mark)
        assert query.awaitTermination(120) and query.exception() is None
    assert as_set(rocks.read.schema(collector.SAMPLE).json(out).collect()) == want


@pytest.mark.parametrize("kind", ["streak", "observer", "total", "parse", "none"])
def test_monitor_of_a_stream(rocks, tmp_path, kind):
    r, rows, sample = random.Random(3), [], 0
    for seq in range(260):
        if seq % 7 == 0:
            sample += 1
        status = "ok"
        if kind == "streak" and seq in (100, 107, 114) or kind == "total" and seq in (30, 61, 92, 95, 98, 99) or kind == "parse" and seq in (50, 82):
            status = "parse_error" if kind == "parse" else "semantic_error"
        if kind == "observer" and seq % 7 == 2 and seq // 7 in (3, 6, 9):
            status = ("reporter_error", "semantic_error", None)[seq // 7 % 3]
        rows.append((seq, seq // 14, seq % 7 + 1, "1_day_speech", sample, status))
    schema = "seq long, game long, observer long, phase string, sample long, status string"
    reports = rocks.createDataFrame(rows, schema)
    stop = monitor.first_stop(reports).collect()
    want = sorted((x.seq, x.game) for x in monitor.until_stop(reports, "sample").collect())
    assert bool(stop) == (kind != "none")
    late = sorted(rows, key=lambda x: x[0] + r.uniform(0, 30))  # up to 30 seconds late
    late += late[::11]
    source = str(tmp_path / "in")
    for k in range(0, len(late), 90):
        rocks.createDataFrame(late[k : k + 90], schema).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).coalesce(1).write.mode("append").json(source)
    end = rocks.createDataFrame([(10_000, 0, 1, "x", -1, "ok")], schema).withColumn("at", F.timestamp_seconds(F.lit(1_700_100_000)))
    stream = rocks.readStream.schema(schema + ", at timestamp").json(source)
    mark, out = str(tmp_path / "mark"), str(tmp_path / "out")

    def run():
        q = collector.stream_until_stop(stream, "60 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None

    run()
    end.coalesce(1).write.mode("append").json(source)  # a later report moves the watermark
    run()
    got = [x for x in rocks.read.parquet(out).collect() if x.seq < 10_000]
    assert sorted((x.seq, x.game) for x in got) == want
    assert [(x.seq, x.rule) for x in got if x.rule] == [(x.seq, x.rule) for x in stop]
