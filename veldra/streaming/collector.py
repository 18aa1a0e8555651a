"""Samples before each public speech, as a batch plan and on a stream of events; the monitor as one state that stops.

``events`` rows are game_id, event_idx (from 0, without gaps), step_idx (the
step of the run) and event (JSON text, see ``veldra.operators.events``). A
sample is due at each ``turn_start`` while a speech phase lasts: everything
that all players saw up to then, and who is alive to report on it.

The streams need the RocksDB state store (``STATE_STORE``). Rows may arrive in
any order and repeatedly; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from veldra.functions.domain import PLAYERS
from veldra.operators.events import EVENT
from veldra.operators.monitor import OBSERVER_LEAST, OBSERVER_RATE, PARSE_RATE, STREAK, TOTAL_LEAST, TOTAL_RATE

#: What a session with these streams has to be configured with.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The report that a speech phase asks for.
TRIGGERS = {"day_speech": "pre_public_speech", "day_speech_pk": "pre_public_speech_pk"}
SAMPLE = "game_id string, step_idx long, phase string, speaker string, report_trigger string, observers array<string>, events array<string>"
_GONE = {"exile_result": "exiled_players", "death_announcement": "dead_players"}


def _trigger(phase: Column) -> Column:
    """The report that a phase such as ``2_day_speech`` asks for; null for phases without speeches."""
    kind = F.regexp_extract(phase, r"^\d+_(.*)$", 1)
    return F.coalesce(*[F.when(kind == k, v) for k, v in TRIGGERS.items()])


def batch_samples(events: DataFrame) -> DataFrame:
    """The samples of ``events`` (see ``SAMPLE``). Rows that repeat an event, or have no place or no JSON object, count once or not at all; what comes after a gap is left out.

    A game's events go through one task, as every sample holds all before it.
    """
    order = Window.partitionBy("game_id").orderBy("event_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where("game_id is not null and event_idx >= 0 and json_object_keys(event) is not null")
    rows = rows.groupBy("game_id", "event_idx").agg(F.min(F.struct("step_idx", "event")).alias("r")).select("game_id", "event_idx", "r.*")
    # a gap before a row keeps its place behind its index from there on
    rows = rows.withColumn("place", F.row_number().over(order) - 1).where("place = event_idx").withColumn("e", F.from_json("event", EVENT))
    gone = F.coalesce(*[F.when(F.col("e.event_type") == k, F.col(f"e.{v}")) for k, v in _GONE.items()])
    rows = rows.withColumn("phase", F.last(F.when(F.col("e.event_type") == "phase_change", F.col("e.phase")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("gone", F.flatten(F.collect_list(gone).over(so_far))).withColumn("events", F.collect_list("event").over(so_far))
    rows = rows.where(F.col("e.event_type") == "turn_start").withColumn("report_trigger", _trigger(F.col("phase"))).where("report_trigger is not null")
    return rows.select("game_id", "step_idx", "phase", F.col("e.speaker").alias("speaker"), "report_trigger", F.array_except(F.array(*map(F.lit, PLAYERS)), "gone").alias("observers"), "events")


class _Collector(StatefulProcessor):
    """State of a game: its events in order as far as there is no gap, those beyond one, what holds now."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "event string", self.keep_ms)
        self.early = handle.getListState("early", "event_idx long, step_idx long, event string", self.keep_ms)
        self.now = handle.getValueState("now", "next long, phase string, gone string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_, phase, gone = self.now.get() if self.now.exists() else (0, "", "[]")
        gone = json.loads(gone)
        # a state is read and written once for each batch of rows
        held = {r[0]: (r[1], r[2]) for r in self.early.get()}
        arrived: dict[int, tuple] = {}
        for table in rows:
            for idx, step, event in table[["event_idx", "step_idx", "event"]].itertuples(index=False):
                idx, new = int(idx), (None if pd.isna(step) else int(step), event)
                if idx >= next_ and idx not in held and _is_object(event) and (idx not in arrived or _first(new) < _first(arrived[idx])):
                    arrived[idx] = new
        early, out, seen, fresh = held | arrived, [], None, []
        while next_ in early:
            step, event = early.pop(next_)
            fresh.append((event,))
            next_ += 1
            e = json.loads(event)
            kind = e.get("event_type")
            if kind == "phase_change":
                phase = e.get("phase") or phase
            elif kind in _GONE:
                gone += [p for p in e.get(_GONE[kind]) or [] if p not in gone]
            elif kind == "turn_start" and (trigger := TRIGGERS.get(phase.partition("_")[2])) and phase.partition("_")[0].isdigit():
                if seen is None:
                    seen = [x[0] for x in self.seen.get()]
                out.append((key[0], step, phase, e.get("speaker"), trigger, [p for p in PLAYERS if p not in gone], seen + [x[0] for x in fresh]))
        if early:
            self.early.put([(idx, *r) for idx, r in early.items()])
        elif held:
            self.early.clear()
        if fresh:
            self.seen.appendList(fresh)
        self.now.update((next_, phase, json.dumps(gone)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SAMPLE.split(", ")])

    def close(self) -> None:
        pass


def _first(row: tuple) -> tuple:
    """Order of rows of one event that differ: those without a step first, as in a batch plan."""
    return (row[0] is not None, row[0] or 0, row[1])


def _is_object(text: object) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (TypeError, ValueError, RecursionError):
        return False


def stream_samples(events: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """The samples of a stream of events, each emitted once, as soon as all events up to it have arrived.

    With ``keep_hours`` the state of a game is forgotten that long after its
    last events. Then the stream never ends by itself, not even with the trigger
    ``availableNow``: Spark goes on looking for state that has run out.
    """
    rows = events.where("game_id is not null and event_idx >= 0")
    keep_ms = int(keep_hours * 3_600_000) if keep_hours else None
    return rows.groupBy("game_id").transformWithStateInPandas(_Collector(keep_ms), SAMPLE, "append", "ProcessingTime" if keep_hours else "None")


def collect_samples(events: DataFrame, path: str, checkpoint: str, keep_hours: float | None = None, trigger: dict | None = None):
    """Append the samples of a stream of events as JSON lines; returns the running query. Without a ``trigger`` it takes what is there and ends; with ``keep_hours`` give one that goes on."""
    writer = stream_samples(events, keep_hours).writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class Monitor:
    """What the four rules need to know, report by report in order of ``seq``."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"total": 0, "bad": 0, "parse": 0, "by": {}, "stop": None, "done": False}

    def take(self, observer: object, sample: object, status: str) -> tuple[bool, str | None]:
        """Whether a report still counts, and the rule that it is the first to break."""
        s = self.state
        if s["done"] or s["stop"] is not None and s["stop"] != sample:
            s["done"] = True  # the sample of the stop has ended
            return False, None
        seen, bad, last, run = s["by"].get(str(observer), (0, 0, "ok", 0))
        failed = status != "ok"
        run = 0 if not failed else run + 1 if status == last else 1
        seen, bad = seen + 1, bad + failed
        s["by"][str(observer)] = (seen, bad, status, run)
        s["total"], s["bad"], s["parse"] = s["total"] + 1, s["bad"] + failed, s["parse"] + (status == "parse_error")
        if s["stop"] is not None:
            return True, None
        rule = None
        if run >= STREAK:
            rule = "1_streak"
        elif seen >= OBSERVER_LEAST and bad / seen > OBSERVER_RATE:
            rule = "2_observer_rate"
        elif s["total"] >= TOTAL_LEAST and s["bad"] / s["total"] > TOTAL_RATE:
            rule = "3_total_rate"
        elif s["total"] >= TOTAL_LEAST and s["parse"] / s["total"] > PARSE_RATE:
            rule = "4_parse_rate"
        if rule:
            s["stop"] = sample
        return True, rule


class _MonitorProcessor(StatefulProcessor):
    """State of a batch of games: reports that wait for the watermark, and the monitor."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due long, seq long, observer long, sample long, game long, status string")
        self.known = handle.getValueState("known", "state string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, last = self.known.get() if self.known.exists() else ("", -(1 << 62))
        new, due = [], set()
        for table in rows:
            for at, *rest in table[["at", "seq", "observer", "sample", "game", "status"]].itertuples(index=False):
                if rest[0] > last:
                    ms = int(at.value // 1_000_000)
                    new.append((ms, *map(int, rest[:4]), rest[4]))
                    due.add(ms)
        if new and not (state and json.loads(state)["done"]):
            self.waiting.appendList(new)
            for ms in sorted(due):
                self.handle.registerTimer(ms)
        yield pd.DataFrame([], columns=["seq", "game", "rule"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        state, last = self.known.get() if self.known.exists() else ("", -(1 << 62))
        monitor, out = Monitor(json.loads(state) if state else None), []
        waiting = list(self.waiting.get())
        for _, seq, observer, sample, game, status in sorted({r for r in waiting if r[0] <= upto}, key=lambda r: r[1]):
            if seq <= last:
                continue
            last = seq
            counts, rule = monitor.take(observer, sample, status)
            if counts:
                out.append((seq, game, rule))
        left = [r for r in waiting if r[0] > upto]
        if left and not monitor.state["done"]:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.known.update((json.dumps(monitor.state), last))
        yield pd.DataFrame(out, columns=["seq", "game", "rule"])

    def close(self) -> None:
        pass


def stream_until_stop(reports: DataFrame, late: str = "1 minute", batch: str | None = None) -> DataFrame:
    """seq, game and rule of the reports of a stream up to the first stop, and on to the end of its sample; ``rule`` stands at the report that breaks it.

    ``reports`` are at (a time that grows with seq), seq, observer, sample,
    game and status; they count in order of ``seq`` once the watermark, ``late``
    behind the newest, has passed them, so they may arrive out of order by as
    much. A sample ends with the first report of another one. All reports of a
    ``batch`` (a column; none: all) are one state, since two rules are over all
    of them; it holds what is waiting and four numbers for each observer.
    """
    rows = reports.where("seq is not null and at is not null").withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("batch", F.col(batch) if batch else F.lit(0))
    return rows.withWatermark("at", late).groupBy("batch").transformWithStateInPandas(_MonitorProcessor(), "seq long, game long, rule string", "append", "EventTime")
