"""Queries of whole rows (contracts, materialization, turns), of samples, key paths and answers, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldra.functions import responses
from veldra.operators import events as E, materialize as M, rotation, snapshots as N
from veldra.plans import adapters as A
from veldra.plans.registry import query
from veldra.streaming import collector


def _name(number: Column) -> Column:
    return F.concat(F.lit("player"), number.cast("string"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw sample for each turn: the speaker s and an observer o three seats on; every second conversation is public only. The observer's report fails, in a third of the turns for what it knows."""
    t, c = F.col("turn"), F.col("conv_id")
    s, o = (t % 7 + 1).cast("int"), ((t + 3) % 7 + 1).cast("int")
    seat = lambda k: _name((t + k) % 7 + 1)
    phase = F.concat((t + 1).cast("string"), F.lit("_day_speech"))
    said = F.array_join(F.array(
        _json(event_idx=F.lit(0), event_type=F.lit("phase_change"), phase=phase), _json(event_idx=F.lit(1), event_type=F.lit("public_speech"), raw_text=F.coalesce("text", F.lit("")), sp_actions=F.array(F.array(_name(o), F.lit("support"), _name(s))), speaker=_name(o)),
        _json(event_idx=F.lit(2), event_type=F.lit("turn_start"), speaker=_name(s))), ",")
    public = c % 2 == 1
    maps = lambda a, b: F.create_map(_name(s), a, _name(o), b)
    none = F.array().cast("array<string>")
    knows = ~public & (t % 3 == 0)  # the observer knows both wolves, one and two seats on from itself
    wolves, rest = F.array_sort(F.array(seat(4), seat(5))), F.array_sort(F.array(seat(6), seat(0), seat(1), seat(2), seat(3)))
    scoped = lambda i: F.when(public, E.SOURCES["public_events_only"][i]).otherwise(E.SOURCES["private_conditioned"][i])
    rows = A.turns(spark, sf_dir).select(
        "conv_id", "turn", scoped(0).alias("schema_version"), scoped(1).alias("label_prompt_version"), scoped(2).alias("label_provenance"), F.concat(F.lit("g"), c.cast("string")).alias("game_id"), t.alias("step_idx"), t.alias("label_cutoff_step_idx"), phase.alias("phase"), s.alias("speaker_id"),
        F.lit("pre_public_speech").alias("report_trigger"), F.array(s, o).alias("observer_ids"), F.lit(1).cast("long").alias("public_action_count"), F.concat(F.lit("["), said, F.lit("]")).alias("events"), maps(F.array(seat(1)), F.lit(None).cast("array<string>")).alias("suspected_werewolves"),
        maps(none, F.when(knows, wolves).otherwise(none)).alias("known_werewolves"), maps(F.when(public, none).otherwise(F.array(_name(s))), F.when(public, none).when(knows, rest).otherwise(F.array(_name(o)))).alias("known_non_werewolves"),
        maps(F.lit("ok"), F.when(t % 3 == 0, "semantic_error").otherwise("parse_error")).alias("belief_status"), maps(F.lit(None).cast("string"), F.lit("bad")).alias("belief_errors"), maps(F.lit("m"), F.lit("n")).alias("agent_backend_ids"),
    )
    p = rows.withColumn("p", E.parsed(F.col("events")))
    return p.withColumn("public_event_digest", E.event_digest(F.col("p"))).withColumn("structured_input_digest", E.structured_digest(F.col("p"))).drop("p")


def _without(m: str) -> Column:
    """The map without the observer that is not the speaker."""
    return F.map_filter(m, lambda k, _: k == _name(F.col("speaker_id")))


def _at(m: str, value: Column) -> Column:
    """The map with another value for the speaker."""
    return F.transform_values(m, lambda k, v: F.when(k == _name(F.col("speaker_id")), value).otherwise(v))


def _s() -> Column:
    return _name(F.col("turn") % 7 + 1)


def _pair(k: int, j: int) -> Column:
    return F.array(_name((F.col("turn") + k) % 7 + 1), _name((F.col("turn") + j) % 7 + 1))


def _knows_itself() -> Column:
    o = _name((F.col("turn") + 3) % 7 + 1)
    return F.create_map(_s(), F.array(_s()), o, F.array(o))


def _other_turn() -> Column:
    turn = F.lit('"turn_start","speaker":"')
    return F.replace(F.col("events"), F.concat(turn, _s()), F.concat(turn, _name((F.col("turn") + 1) % 7 + 1)))


_NOT_KNOWN = "hard_knowledge_not_closed,suspicion_against_knowledge"
_UNCERTAIN = "suspicion_against_status,suspicion_order,suspicion_against_knowledge"
_NO_EVENTS = "public_events,not_at_turn_start,phase,public_action_count,public_event_digest,structured_input_digest"
#: What is found in private rows, in public ones, and the column that is changed with its new value: every rule that raw and formal rows share.
_CASES = [
    ("", "", "turn", lambda: F.col("turn")),
    ("lineage", "lineage", "schema_version", lambda: F.lit("x")),
    ("speaker_id,not_at_turn_start", "speaker_id,not_at_turn_start", "speaker_id", lambda: F.lit(9)),
    ("belief_status", "belief_status", "belief_status", lambda: F.transform_values("belief_status", lambda k, v: F.when(k == _s(), v).otherwise("odd"))),
    ("error_against_status", "error_against_status", "belief_errors", lambda: _at("belief_errors", F.lit("x"))),
    (_UNCERTAIN, _UNCERTAIN, "suspected_werewolves", lambda: _at("suspected_werewolves", F.lit(None).cast("array<string>"))),
    ("suspicion_order", "suspicion_order", "suspected_werewolves", lambda: _at("suspected_werewolves", F.reverse(F.array_sort(_pair(1, 2))))),
    ("suspicion_against_knowledge", "", "suspected_werewolves", lambda: _at("suspected_werewolves", F.array(_s()))),
    ("", "public_only_knows", "known_non_werewolves", lambda: F.when(F.col("conv_id") % 2 == 1, _knows_itself()).otherwise(F.col("known_non_werewolves"))),
    (_NOT_KNOWN, "public_only_knows," + _NOT_KNOWN, "known_werewolves", lambda: _at("known_werewolves", F.array_sort(_pair(4, 5)))),
    ("step_idx,label_cutoff_step_idx", "step_idx,label_cutoff_step_idx", "step_idx", lambda: F.lit(-1)),
    ("label_cutoff_step_idx", "label_cutoff_step_idx", "label_cutoff_step_idx", lambda: F.lit(999)),
    ("phase", "phase", "phase", lambda: F.lit("99_day_speech")),
    ("game_id", "game_id", "game_id", lambda: F.lit(" ")),
    ("report_trigger", "report_trigger", "report_trigger", lambda: F.lit("x")),
    ("public_action_count", "public_action_count", "public_action_count", lambda: F.lit(5)),
    ("public_event_digest", "public_event_digest", "public_event_digest", lambda: F.lit("x")),
    ("structured_input_digest", "structured_input_digest", "structured_input_digest", lambda: F.lit(None)),
    (_NO_EVENTS, _NO_EVENTS, "events", lambda: F.lit("[]")),
    ("not_at_turn_start,public_event_digest,structured_input_digest", "not_at_turn_start,public_event_digest,structured_input_digest", "events", _other_turn),
    ("suspected_werewolves:observers", "suspected_werewolves:observers", "suspected_werewolves", lambda: _without("suspected_werewolves")),
    ("known_werewolves:observers,hard_knowledge_not_closed", "known_werewolves:observers,hard_knowledge_not_closed", "known_werewolves", lambda: _without("known_werewolves")),
    ("known_non_werewolves:observers,hard_knowledge_not_closed", "known_non_werewolves:observers,hard_knowledge_not_closed", "known_non_werewolves", lambda: _without("known_non_werewolves")),
    ("belief_status:observers,belief_status,suspicion_order,suspicion_against_knowledge", "belief_status:observers,belief_status,suspicion_order,suspicion_against_knowledge", "belief_status", lambda: _without("belief_status")),
    ("belief_errors:observers,error_against_status", "belief_errors:observers,error_against_status", "belief_errors", lambda: _without("belief_errors")),
    ("agent_backend_ids:observers,agent_backend_ids", "agent_backend_ids:observers,agent_backend_ids", "agent_backend_ids", lambda: _without("agent_backend_ids")),
]
#: The same for the rules of formal rows alone.
_FORMAL_CASES = [
    (c, c, c, v)
    for c, v in {
        "source_schema_version": lambda: F.lit("x"), "tom_order": lambda: F.lit(1), "model_input_scope": lambda: F.lit("x"), "private_fields_usage": lambda: F.lit(None), "annotation_schema_version": lambda: F.lit("x"), "label_provenance": lambda: F.lit("x"), "current_action_used": lambda: F.lit(True),
        "expert_labels_used_as_later_evidence": lambda: F.lit(None), "future_information_used": lambda: F.lit(True), "observer_annotation_confidence": lambda: _at("observer_annotation_confidence", F.lit(" ")), "observer_label_provenance": lambda: _at("observer_label_provenance", F.lit(None)),
        "source_belief_status": lambda: _at("source_belief_status", F.lit("x")),
    }.items()
]


def _changed(rows: DataFrame, cases: list) -> DataFrame:
    """Rows of which each has the change of one case."""
    k = (F.col("conv_id") * 5 + F.col("turn")) % len(cases)
    new: dict[str, Column] = {}
    for i, (_, _, c, value) in enumerate(cases):
        new[c] = F.when(k == i, value().cast(rows.schema[c].dataType)).otherwise(new.get(c, F.col(c)))
    return rows.withColumns(new)


def _found(cases: list) -> str:
    each = " ".join(f"WHEN {i} THEN CASE WHEN conv_id % 2 = 1 THEN '{b}' ELSE '{a}' END" for i, (a, b, _, _) in enumerate(cases))
    return f"CASE (conv_id * 5 + turn) % {len(cases)} {each} END"


@query(f"SELECT conv_id, turn, {_found(_CASES)} AS violations FROM conversations")
def raw_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.raw_violations(_changed(_samples(spark, sf_dir), _CASES)).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


def _formal(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """conv_id, turn and the formal row of an order of each sample."""
    rows = M.parts(_samples(spark, sf_dir)).where(F.col("part") == f"tom{order}").select("row.*")
    return rows.select(F.substring("game_id", 2, 20).cast("long").alias("conv_id"), F.col("step_idx").alias("turn"), *M.FORMAL)


#: Formal rows of order 2 hold the observer only where it knows both wolves, so these cases change them in a further way.
_ORDER_2 = [c for c in _CASES[:20] if c[2] not in ("belief_status", "suspected_werewolves", "known_non_werewolves", "known_werewolves", "schema_version")]


@query(f"SELECT conv_id, turn, {_found(_ORDER_2 + _FORMAL_CASES)} AS violations FROM conversations")
def formal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(_formal(spark, sf_dir, 2), _ORDER_2 + _FORMAL_CASES)
    return E.formal_violations(rows, 2).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


_SEATS = """c AS (SELECT conv_id, turn, conv_id % 2 = 1 AS public, turn % 7 + 1 AS s, (turn + 3) % 7 + 1 AS o, (turn + 1) % 7 + 1 AS x, list_sort([(turn + 4) % 7 + 1, (turn + 5) % 7 + 1]) AS wolves FROM conversations
), k AS (SELECT *, NOT public AND turn % 3 = 0 AS hard FROM c)"""


@query(f"""WITH {_SEATS} SELECT conv_id, turn, 'tom1' AS part, CAST(NULL AS BIGINT) AS player, 's' || s AS observers, 's' || s || '=' || x AS suspected, 's' || s || '=source' AS confidence, 's' || s || '=ok' AS status, CASE WHEN public THEN 'none' ELSE 'first_order_model_input_and_label' END AS usage, 0 AS violations FROM k
UNION ALL SELECT conv_id, turn, 'tom2', NULL, 's' || s || CASE WHEN hard THEN ',s' || o ELSE '' END, 's' || s || '=' || x || CASE WHEN hard THEN ',s' || o || '=' || array_to_string(wolves, '+') ELSE '' END, 's' || s || '=source' || CASE WHEN hard THEN ',s' || o || '=exact' ELSE '' END,
  's' || s || '=ok' || CASE WHEN hard THEN ',s' || o || '=semantic_error' ELSE '' END, CASE WHEN public THEN 'none' ELSE 'label_construction_and_audit_only' END, 0 FROM k
UNION ALL SELECT conv_id, turn, 'filtered_tom2', o, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE NOT hard""")
def materialized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each sample, with the number of rules that the rows of both orders break."""
    parts = M.parts(E.with_facts(_samples(spark, sf_dir)), keep=("event_facts",))
    ids = lambda: F.transform("row.observer_ids", lambda i: F.concat(F.lit("s"), i.cast("string")))
    each = lambda m, show: F.array_join(F.transform("row.observer_ids", lambda i: F.concat(F.lit("s"), i.cast("string"), F.lit("="), show(F.col(f"row.{m}")[_name(i)]))), ",")
    seats = lambda names: F.array_join(F.transform(names, lambda n: F.substring(n, 7, 1)), "+")
    same = lambda v: v
    # both orders are checked where the rows are made: nothing is made again or joined, and what the events hold is found once for both
    order = F.when(F.col("part") == "tom1", 1).when(F.col("part") == "tom2", 2)
    checked = E.formal_violations(parts.select("part", "player", "row", "event_facts", F.col("game_id").alias("__game"), F.col("step_idx").alias("__step"), *[F.col(f"row.{c}").alias(c) for c in M.FORMAL]), order)
    key = [F.substring("__game", 2, 20).cast("long").alias("conv_id"), F.col("__step").alias("turn")]
    violations = F.when(order.isNotNull(), F.size("violations")).alias("violations")
    return checked.select(*key, "part", F.col("player").cast("long").alias("player"), F.array_join(ids(), ",").alias("observers"), each("suspected_werewolves", seats).alias("suspected"), each("observer_annotation_confidence", same).alias("confidence"), each("source_belief_status", same).alias("status"), F.col("row.private_fields_usage").alias("usage"), violations)


@query(f"""WITH {_SEATS}, r AS (SELECT k.*, e.e AS shift FROM k, range(0, 7) e(e)
), t AS (SELECT *, (s - 1 + shift) % 7 + 1 AS s2, (o - 1 + shift) % 7 + 1 AS o2, (x - 1 + shift) % 7 + 1 AS x2, list_sort(list_transform(wolves, lambda w: (w - 1 + shift) % 7 + 1)) AS w2 FROM r
), q AS (SELECT t.*, coalesce(CAST(to_json(m.text) AS VARCHAR), '""') AS q FROM t JOIN conversations m USING (conv_id, turn)
), e AS (SELECT *, '[{{"event_idx":0,"event_type":"phase_change","phase":"' || (turn + 1) || '_day_speech"}},{{"event_idx":1,"event_type":"public_speech","raw_text":' || q || ',"sp_actions":[["player' || o2 || '","support","player' || s2 || '"]],"speaker":"player' || o2 || '"}},{{"event_idx":2,"event_type":"turn_start","speaker":"player' || s2 || '"}}]' AS events FROM q)
SELECT conv_id, turn, CAST(shift AS INT) AS shift, CAST(s2 AS INT) AS speaker_id, CASE WHEN hard THEN s2 || ',' || o2 ELSE CAST(s2 AS VARCHAR) END AS observers, x2 || CASE WHEN hard THEN '|' || array_to_string(w2, '+') ELSE '' END AS suspected, sha256(events) AS public_event_digest, md5(events) AS events, 0 AS violations FROM e""")
def turned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of order 2 in all seven turns; the rows that come out keep their contract."""
    rows = N.orbit(_formal(spark, sf_dir, 2))
    turned = E.formal_violations(rotation.turned_samples(rows, F.col("shift")), 2)
    said = F.array_join(F.transform("observer_ids", lambda i: F.array_join(F.transform(F.col("suspected_werewolves")[_name(i)], lambda n: F.substring(n, 7, 1)), "+")), "|")
    return turned.select("conv_id", "turn", "shift", "speaker_id", F.array_join(F.col("observer_ids").cast("array<string>"), ",").alias("observers"), said.alias("suspected"), "public_event_digest", F.md5("events").alias("events"), F.size("violations").alias("violations"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a game for each conversation: its first turn opens a speech phase, others are in turn a turn, a speech, a vote phase, an exile and a new phase of speeches."""
    t = F.col("turn")
    k, seat = t % 6, _name(t % 7 + 1)
    event = (
        F.when(t == 0, _json(event_type=F.lit("phase_change"), phase=F.lit("1_day_speech"))).when(k == 1, _json(event_type=F.lit("turn_start"), speaker=seat)).when(k == 2, _json(event_type=F.lit("public_speech"), raw_text=F.col("text"), speaker=seat))
        .when(k == 3, _json(event_type=F.lit("turn_start"), speaker=seat)).when(k == 4, _json(event_type=F.lit("exile_result"), exiled_players=F.array(seat))).when(k == 5, _json(event_type=F.lit("phase_change"), phase=F.concat(t.cast("string"), F.when(t % 4 == 1, "_day_vote").otherwise("_day_speech_pk"))))
        .otherwise(_json(event_type=F.lit("death_announcement"), dead_players=F.array()))
    )
    return A.table(spark, sf_dir, "conversations").select(F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("game_id"), t.alias("event_idx"), t.alias("step_idx"), event.alias("event"))


@query("""WITH c AS (SELECT conv_id, turn, turn % 6 AS k, turn % 7 + 1 AS s FROM conversations
), p AS (SELECT *, last_value(CASE WHEN turn = 0 THEN '1_day_speech' WHEN k = 5 THEN turn || CASE WHEN turn % 4 = 1 THEN '_day_vote' ELSE '_day_speech_pk' END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS phase,
  list(CASE WHEN k = 4 AND turn > 0 THEN s END) OVER (PARTITION BY conv_id ORDER BY turn) AS gone FROM c)
SELECT 'g' || conv_id AS game_id, turn AS step_idx, phase, 'player' || s AS speaker, CASE WHEN phase LIKE '%_pk' THEN 'pre_public_speech_pk' ELSE 'pre_public_speech' END AS report_trigger,
  array_to_string(list_transform(list_filter(range(1, 8), lambda i: NOT list_contains(gone, i)), lambda i: 'player' || i), ',') AS observers, CAST(turn + 1 AS INT) AS n_events FROM p WHERE k IN (1, 3) AND turn > 0 AND phase LIKE '%_day_speech%'""")
def collected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collector.batch_samples(_logs(spark, sf_dir))
    return out.select("game_id", "step_idx", "phase", "speaker", "report_trigger", F.array_join("observers", ",").alias("observers"), F.size("events").alias("n_events"))


_KEYS = ("k", "role", "text")


@query("""WITH j AS (SELECT 'e' AS source, event_id AS id, 0 AS turn, CAST(props AS VARCHAR) AS j FROM events
  UNION ALL SELECT 'c', conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"said":[' || CAST(to_json(text) AS VARCHAR) || ',{"role":{"text":[' || CAST(to_json(role) AS VARCHAR) || ',{"k":null}]}}]}' WHEN 1 THEN text ELSE '[[{"role":' || turn || '}],{"x":{"text":' || CAST(to_json(text) AS VARCHAR) || '}}]' END FROM conversations
), w AS (SELECT v.source, v.id, v.turn, t.key, t.type, replace(t.fullkey, '$', 'root') AS path FROM (SELECT * FROM j WHERE json_valid(j)) v, json_tree(v.j) t)
SELECT source, id, turn, path, CASE type WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE type END AS kind FROM w WHERE key IN ('k', 'role', 'text') AND path NOT LIKE '%]'""")
def forbidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select(F.lit("e").alias("source"), F.col("event_id").alias("id"), F.lit(0).cast("long").alias("turn"), F.col("props").cast("string").alias("j"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)
    t = F.col("turn")
    j = (
        F.when(t % 3 == 0, F.concat(F.lit('{"said":['), quoted("text"), F.lit(',{"role":{"text":['), quoted("role"), F.lit(',{"k":null}]}}]}'))).when(t % 3 == 1, F.col("text"))
        .otherwise(F.concat(F.lit('[[{"role":'), t.cast("string"), F.lit('}],{"x":{"text":'), quoted("text"), F.lit("}}]")))
    )
    c = A.table(spark, sf_dir, "conversations").select(F.lit("c").alias("source"), F.col("conv_id").alias("id"), t.alias("turn"), j.alias("j"))
    return N.key_paths(e.unionByName(c), "j", _KEYS).drop("j")


_ANSWER = """c AS (SELECT conv_id, turn, coalesce(text, '') AS x, turn % 7 + 1 AS a, (turn + 2) % 7 + 1 AS b, (conv_id + turn) % 4 AS k FROM conversations
), t AS (SELECT *, replace(replace(replace(x, '*', ''), '#', ''), chr(10), ' ') AS y FROM c)"""


@query(f"""WITH {_ANSWER}, r AS (SELECT *, trim(y) AS z, CASE k WHEN 0 THEN '总结：' || chr(10) || '**昨夜**： ' || y || '**发言**：' || a || '号**昨夜**：平安 #投票原因： ' || y || '。' || chr(10) || '基于上述分析，可以预测玩家身份为： ' || a || '号玩家是狼人。' || b || '号玩家是村民。' || a || '号玩家是预言家。' || b || '号玩家是平民。' || chr(10) || '综上，投' || a || '号' || b
  WHEN 1 THEN '总结：' || y || chr(10) || '综上，我弃票' WHEN 2 THEN y || '弃票' ELSE y || a || '号' END AS t FROM t)
SELECT conv_id, turn, CASE k WHEN 0 THEN '昨夜: 平安' || chr(10) || '发言: ' || a || '号' || chr(10) WHEN 1 THEN ltrim(y) ELSE t END AS note, CASE k WHEN 0 THEN trim(y) ELSE t END AS reason,
  CASE k WHEN 0 THEN CASE WHEN a < b THEN a || '=预言家,' || b || '=村民' ELSE b || '=村民,' || a || '=预言家' END ELSE '' END AS roles, CAST(CASE k WHEN 0 THEN a WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE a END AS INT) AS vote FROM r""")
def noted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t = _answers(spark, sf_dir), F.col("t")
    roles = F.array_join(F.transform(F.array_sort(F.map_entries(responses.predicted_roles(t))), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")
    return rows.select("conv_id", "turn", responses.note(t)["note"].alias("note"), responses.vote_reason(t).alias("reason"), roles.alias("roles"), responses.vote_response(t)["vote"].alias("vote"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free answers around the text of each turn, in four forms; the last prediction of the first form ends with the list and is none of its own."""
    x = F.coalesce("text", F.lit(""))
    a, b = (F.col("turn") % 7 + 1).cast("string"), ((F.col("turn") + 2) % 7 + 1).cast("string")
    k = (F.col("conv_id") + F.col("turn")) % 4
    y = F.replace(F.translate(x, "*#", ""), F.lit("\n"), F.lit(" "))
    n = F.lit("\n")
    t = (
        F.when(k == 0, F.concat(F.lit("总结："), n, F.lit("**昨夜**： "), y, F.lit("**发言**："), a, F.lit("号**昨夜**：平安 #投票原因： "), y, F.lit("。"), n, F.lit("基于上述分析，可以预测玩家身份为： "), a, F.lit("号玩家是狼人。"), b, F.lit("号玩家是村民。"), a, F.lit("号玩家是预言家。"), b, F.lit("号玩家是平民。"), n, F.lit("综上，投"), a, F.lit("号"), b))
        .when(k == 1, F.concat(F.lit("总结："), y, n, F.lit("综上，我弃票"))).when(k == 2, F.concat(y, F.lit("弃票"))).otherwise(F.concat(y, a, F.lit("号")))
    )
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))


@query("""WITH c AS (SELECT conv_id, turn, text AS x, (conv_id + turn) % 5 AS k, turn % 7 + 1 AS a FROM conversations)
SELECT conv_id, turn, CASE k WHEN 1 THEN 'missing:毒药' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'unsupported_role' END AS fault, CASE k WHEN 0 THEN coalesce(x, '') || '/' || a WHEN 2 THEN CAST(a AS VARCHAR) END AS action, CASE k WHEN 0 THEN coalesce(x, '') WHEN 2 THEN '' END AS reason,
  CASE WHEN k = 0 THEN coalesce(x, '') END AS speech, CASE WHEN k = 0 THEN '展现自己身份为' || a || '。把' || a || '号贴上身份标签：' || coalesce(x, '') || '。。归票：' || a || '。' END AS template FROM c""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = (F.col("conv_id") + F.col("turn")) % 5, (F.col("turn") % 7 + 1).cast("string")
    x = F.coalesce("text", F.lit(""))
    role = F.when(k <= 1, "Witch").when(k == 2, "Seer").when(k == 3, "Guard").otherwise("King")
    night = F.when(k == 0, F.to_json(F.struct(x.alias("解药"), a.alias("毒药"), x.alias("原因")))).when(k == 1, F.to_json(F.struct(x.alias("解药")))).when(k == 2, F.concat(F.lit('{"查验": '), a, F.lit("}"))).when(k == 3, F.concat(F.lit("守卫 "), x)).otherwise("{}")
    speech = F.when(k == 0, F.to_json(F.struct(x.alias("发言"), a.alias("想要展示的身份"), F.create_map(F.concat(a, F.lit("号")), x).alias("身份标签"), a.alias("归票"))))
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", responses.night_action(role, night).alias("n"), responses.speech_form(speech).alias("s"))
    action = F.when(F.col("n.action").isNotNull(), F.array_join(F.map_values("n.action"), "/"))
    return rows.select("conv_id", "turn", "n.fault", action.alias("action"), "n.reason", "s.speech", "s.template")
