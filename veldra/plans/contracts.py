"""Queries of contracts, tokens, audits and game state, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldra.functions import domain, text
from veldra.operators import beliefs as B, events as E, games as G, relations as R, snapshots as N
from veldra.plans import adapters as A
from veldra.plans.registry import query
from veldra.sources import jsonl

#: Events of a turn as JSON, in SQL; ``k`` picks the rule that they break (8 and 9 none), {q} is the turn's text as a JSON string.
_EVENTS_SQL = """c AS (SELECT conv_id, turn, CAST(to_json(text) AS VARCHAR) AS q, (conv_id + turn) % 10 AS k, 'player' || (turn % 7 + 1) AS who, 'player' || ((turn + 3) % 7 + 1) AS other, turn + 1 AS day FROM conversations
), e AS (SELECT *, '{"event_idx":0,"event_type":"phase_change","phase":"' || CASE k WHEN 0 THEN '0' ELSE CAST(day AS VARCHAR) END || '_day_speech"}' AS e0,
  '{"event_idx":' || CASE k WHEN 1 THEN '"1"' WHEN 2 THEN '2' ELSE '1' END || ',"event_type":"public_speech","raw_text":' || CASE k WHEN 3 THEN '5' ELSE q END || ',"sp_actions":[["' || who || '","' || CASE k WHEN 4 THEN 'fly' ELSE 'support' END || '","' || other || '"]],"speaker":"' || who || '"}' AS e1,
  '{"event_idx":2,"event_type":"vote_result","votes":[{"target":null,"voter":"player1"},{"target":"' || who || '","voter":"' || CASE k WHEN 5 THEN 'player1' ELSE 'player2' END || '"}]' || CASE k WHEN 6 THEN ',"x":1' ELSE '' END || '}' AS e2,
  CASE k WHEN 7 THEN '{"dead_players":["player5","player4"]' ELSE '{"dead_players":["player4"]' END || ',"event_idx":3,"event_type":"death_announcement"}' AS e3,
  '{"event_idx":4,"event_type":"public_speech","raw_text":"","sp_actions":[],"speaker":"' || other || '"}' AS e4, '{"event_idx":5,"event_type":"turn_start","speaker":"' || who || '"}' AS e5 FROM c)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, k, who, other, day and events (JSON text with the keys of each object in another order than the canonical one)."""
    n = lambda i: F.concat(F.lit("player"), ((F.col("turn") + i) % 7 + 1).cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 10).alias("k"), n(0).alias("who"), n(3).alias("other"), (F.col("turn") + 1).alias("day"), quoted.alias("q"))
    k = lambda i, a, b: F.when(F.col("k") == i, F.lit(a)).otherwise(F.lit(b) if isinstance(b, str) else b)
    parts = (
        '[{"phase": "', k(0, "0", F.col("day").cast("string")), '_day_speech", "event_idx": 0, "event_type": "phase_change"}, {"event_type": "public_speech", "event_idx": ', F.when(F.col("k") == 1, '"1"').otherwise(k(2, "2", "1")),
        ', "raw_text": ', k(3, "5", F.col("q")), ', "speaker": "', F.col("who"), '", "sp_actions": [["', F.col("who"), '", "', k(4, "fly", "support"), '", "', F.col("other"), '"]]}, {"event_type": "vote_result", "event_idx": 2, "votes": [{"voter": "player1", "target": null}, {"voter": "',
        k(5, "player1", "player2"), '", "target": "', F.col("who"), '"}]', k(6, ', "x": 1', ""), '}, {"event_idx": 3, "event_type": "death_announcement", "dead_players": ["', k(7, 'player5", "player4', "player4"),
        '"]}, {"event_idx": 4, "event_type": "public_speech", "speaker": "', F.col("other"), '", "raw_text": "", "sp_actions": []}, {"event_idx": 5, "event_type": "turn_start", "speaker": "', F.col("who"), '"}]',
    )
    return rows.withColumn("events", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).drop("q")


@query(f"""WITH {_EVENTS_SQL} SELECT conv_id, turn, CASE k WHEN 0 THEN '0:phase' WHEN 1 THEN '1:event_idx' WHEN 2 THEN '1:event_idx' WHEN 3 THEN '1:raw_text' WHEN 4 THEN '1:sp_actions' WHEN 5 THEN '2:voter_order' WHEN 6 THEN '2:fields' WHEN 7 THEN '3:dead_players' ELSE '' END AS violations FROM e""")
def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(E.event_violations(F.col("events")), ",").alias("violations"))


@query(f"""WITH {_EVENTS_SQL}, t AS (SELECT *, '{{"action":null,"day":' || day || ',"object":null,"phase":"day_speech","subject":null,"token_type":"phase_change"}}' AS t0, '{{"action":' AS a, ',"day":0,"object":' AS o, ',"phase":null,"subject":' AS s, ',"token_type":"' AS y FROM e WHERE k > 7)
SELECT conv_id, turn, sha256('[' || e0 || ',' || e1 || ',' || e2 || ',' || e3 || ',' || e4 || ',' || e5 || ']') AS event_digest,
  sha256('[' || t0 || ',' || a || 'null' || o || 'null' || s || '"' || who || '"' || y || 'public_speech"}},' || a || '"support"' || o || '"' || other || '"' || s || '"' || who || '"' || y || 'speech_action"}},' || a || 'null' || o || 'null' || s || 'null' || y || 'vote_result"}},'
    || a || 'null' || o || 'null' || s || '"player1"' || y || 'vote"}},' || a || 'null' || o || '"' || who || '"' || s || '"player2"' || y || 'vote"}},' || a || 'null' || o || 'null' || s || 'null' || y || 'death_announcement"}},' || a || 'null' || o || '"player4"' || s || 'null' || y || 'dead_player"}},'
    || a || 'null' || o || 'null' || s || '"' || other || '"' || y || 'public_speech"}},' || a || 'null' || o || 'null' || s || '"' || who || '"' || y || 'turn_start"}}]') AS structured_digest,
  true AS boundary, 'support' AS actions FROM t""")
def event_digest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).where("k > 7").withColumn("p", E.parsed(F.col("events")))
    acts = F.array_join(F.transform(E.speech_actions(F.col("p")), lambda a: a[1]), ",")
    return rows.select("conv_id", "turn", E.event_digest(F.col("p")).alias("event_digest"), E.structured_digest(F.col("p")).alias("structured_digest"), E.at_boundary(F.col("p"), F.substring("who", 7, 1).cast("int")).alias("boundary"), acts.alias("actions"))


@query(f"""WITH {_EVENTS_SQL} SELECT conv_id, turn, '9,10,3,2' AS x, CAST(substr(other, 7, 1) AS INT) + CAST(substr(who, 7, 1) AS INT) AS y FROM e WHERE k > 7""")
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).where("k > 7").withColumn("p", E.parsed(F.col("events")))
    out = E.features(rows, "p", 4, ["conv_id"])
    return out.select("conv_id", "turn", F.array_join("event_type_ids", ",").alias("x"), F.aggregate("subject_ids", F.lit(0).cast("long"), lambda a, x: a + x).cast("int").alias("y"))


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, turn % 7 + 1 AS n FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'truncated' WHEN 2 THEN 'bad_reference' WHEN 3 THEN 'structured' WHEN 4 THEN 'control_text' WHEN 5 THEN CASE WHEN n = 7 THEN 'missing' ELSE 'unplanned' END WHEN 6 THEN CASE WHEN n = 2 THEN NULL ELSE 'missing' END END AS fault,
  CASE k WHEN 2 THEN '9' WHEN 5 THEN '7' WHEN 7 THEN CASE WHEN n = 2 THEN '2,3' ELSE array_to_string(list_sort(list_distinct([2, 3, n])), ',') END ELSE '' END AS named FROM c""")
def speech_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = (F.col("conv_id") + F.col("turn")) % 8, F.col("turn") % 7 + 1
    said = (
        F.when(k == 0, " \n").when(k == 1, "cut").when(k == 2, "9号").when(k == 3, '  {"x": 1}').when(k == 4, "see the game_log").when(k == 5, "玩家7").when(k == 6, "hm").otherwise(F.lit("我投2号，player 3 "))
    )
    plan = F.when(k == 7, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))
    who = n.cast("int")
    fault = text.speech_fault(said, F.when(k == 1, "length"), who, F.when(k == 6, F.when(n == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(2)))).otherwise(plan))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", fault.alias("fault"), F.array_join(text.references(said, who).cast("array<string>"), ",").alias("named"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 WHEN 3 THEN p_size END AS vote, CASE WHEN p_size < 3 THEN substr('abc', p_size + 1, 1) END AS chosen FROM part""")
def vote_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    response = F.when(k == 0, F.concat(F.lit("{'投票': '"), n, F.lit("'}"))).when(k == 1, F.concat(F.lit('```json\n{"投票玩家": '), n, F.lit("}\n```"))).when(k == 2, "- {'投票': '否'}").when(k == 3, F.concat(F.lit("我的投票："), n, F.lit("号。"))).when(k == 4, '{"投票": -1}').otherwise("nobody")
    index = F.concat(F.lit("{'action_index': "), n, F.lit("}"))
    return A.table(spark, sf_dir, "part").select("p_partkey", text.vote_target(response).alias("vote"), text.chosen_action(index, F.array(*map(F.lit, "abc"))).alias("chosen"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey % 7 AS k, [1, 2, 3, c_custkey % 4 + 4] AS alive, c_custkey % 3 + 1 AS x FROM customer), l AS (
  SELECT id, unnest(CASE k WHEN 0 THEN ['kill:0'] || list_transform(list_filter(alive, lambda a: a <> x), lambda a: 'kill:' || a) WHEN 1 THEN ['check:0'] || list_transform(list_filter(alive, lambda a: a <> x), lambda a: 'check:' || a)
    WHEN 2 THEN ['guard:0'] || list_transform(list_filter(alive, lambda a: a <> x), lambda a: 'guard:' || a) WHEN 3 THEN ['witch_pass:0'] || CASE WHEN x > 1 THEN list_transform(alive, lambda a: 'witch_poison:' || a) ELSE [] END || CASE WHEN x < 3 THEN ['witch_heal:' || x] ELSE [] END
    WHEN 4 THEN ['vote:0', 'vote:' || x] WHEN 5 THEN ['vote_pk:0', 'vote_pk:4'] ELSE ['speech:0'] END) AS act FROM c)
SELECT id, string_agg(act, ',' ORDER BY act) AS legal FROM l GROUP BY 1""")
def legal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    x = (c % 3 + 1).cast("int")
    one = lambda v: F.array(v.cast("int"))
    phases = F.array(*map(F.lit, ("skill_wolf", "skill_seer", "skill_guard", "skill_witch", "vote", "vote_pk", "speech")))
    state = A.table(spark, sf_dir, "customer").select(
        c.alias("id"), F.get(phases, (F.col("c_nationkey") % 7).cast("int")).alias("phase"), F.lit(5).alias("actor"), F.array(F.lit(1), F.lit(2), F.lit(3), (c % 4 + 4).cast("int")).alias("alive"), one(x).alias("wolves"), one(x).alias("checked"), x.alias("last_guard"),
        (x == 1).alias("poison_used"), F.lit(False).alias("heal_used"), F.when(x < 3, x).otherwise(0).alias("victim"), one(x).alias("suggestible"), F.array(F.lit(4), F.lit(5)).alias("pk_pool"),
    )
    acts = F.array_sort(F.transform("legal", lambda a: F.concat_ws(":", a["action"], a["target"].cast("string"))))
    return G.legal_actions(state).select("id", F.array_join(acts, ",").alias("legal"))


@query("""WITH b AS (SELECT l_orderkey AS round, CASE WHEN l_linenumber <= 4 THEN 'vote' ELSE 'vote_pk' END AS stage, l_linenumber AS voter, l_suppkey % 4 AS target FROM lineitem
), g AS (SELECT round, [1, 2, 3] || CASE WHEN round % 3 > 0 THEN [5, 6, 7] ELSE [] END AS alive FROM b GROUP BY 1
), c AS (SELECT round, target, count(*) AS n FROM b WHERE stage = 'vote' AND target > 0 GROUP BY 1, 2
), l AS (SELECT round, list_sort(list(target)) AS leaders FROM (SELECT *, rank() OVER (PARTITION BY round ORDER BY n DESC) AS k FROM c) WHERE k = 1 GROUP BY 1
), s AS (SELECT g.round, leaders, CASE WHEN len(list_filter(alive, lambda x: NOT list_contains(leaders, x))) > 0 THEN list_sort(list_filter(alive, lambda x: NOT list_contains(leaders, x))) ELSE leaders END AS voters FROM g JOIN l USING (round) WHERE len(leaders) > 1
), d AS (SELECT b.round, b.target, count(*) AS n FROM b JOIN s USING (round) WHERE stage = 'vote_pk' AND target > 0 AND list_contains(voters, voter) AND list_contains(leaders, target) GROUP BY 1, 2
), m AS (SELECT round, list(target) AS winners FROM (SELECT *, rank() OVER (PARTITION BY round ORDER BY n DESC) AS k FROM d) WHERE k = 1 GROUP BY 1
), a AS (SELECT round, count(*) AS abstained FROM b WHERE stage = 'vote' AND target = 0 GROUP BY 1)
SELECT g.round, CASE WHEN l.leaders IS NULL THEN 'all abstention' WHEN len(l.leaders) = 1 THEN 'exiled' WHEN m.winners IS NULL THEN 'all abstention in pk' WHEN len(m.winners) = 1 THEN 'exiled in pk' ELSE 'draw in pk' END AS outcome,
  CAST(CASE WHEN len(l.leaders) = 1 THEN l.leaders[1] WHEN len(m.winners) = 1 THEN m.winners[1] END AS INT) AS exiled, array_to_string(s.leaders, ',') AS candidates, array_to_string(s.voters, ',') AS voters, coalesce(abstained, 0) AS abstained
FROM g LEFT JOIN l USING (round) LEFT JOIN s USING (round) LEFT JOIN m USING (round) LEFT JOIN a USING (round)""")
def runoff_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("round"), F.when(F.col("l_linenumber") <= 4, "vote").otherwise("vote_pk").alias("stage"), F.col("l_linenumber").cast("int").alias("voter"), (F.col("l_suppkey") % 4).cast("int").alias("target"))
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    alive = b.select("round").distinct().withColumn("alive", F.when(F.col("round") % 3 > 0, F.concat(three, F.array(F.lit(5), F.lit(6), F.lit(7)))).otherwise(three))
    names = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return G.runoff(b, alive).select("round", "outcome", "exiled", names("candidates"), names("voters"), "abstained")


@query("""SELECT l_orderkey AS round, string_agg(l_linenumber || '=' || CASE l_partkey % 8 WHEN 0 THEN '-' ELSE CAST(l_partkey % 8 AS VARCHAR) END, ',' ORDER BY l_linenumber, CASE l_partkey % 8 WHEN 0 THEN -1 ELSE l_partkey % 8 END) AS votes FROM lineitem GROUP BY 1""")
def public_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform("votes", lambda v: F.concat_ws("=", v["voter"].cast("string"), F.coalesce(v["target"].cast("string"), F.lit("-"))))
    return G.public_votes(A.ballots(spark, sf_dir)).select("round", F.array_join(each, ",").alias("votes"))


_LOG = """l AS (SELECT conv_id AS game, turn AS log_idx, turn // 3 AS day, CASE WHEN turn % 3 = 0 THEN 'end_night' WHEN turn % 3 = 1 THEN 'speech' ELSE 'end_vote' END AS event, (conv_id + turn) % 7 + 1 AS p FROM conversations)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    event = F.when(t % 3 == 0, "end_night").when(t % 3 == 1, "speech").otherwise("end_vote")
    player = ((F.col("conv_id") + t) % 7 + 1).cast("int")
    viewer = F.when(t % 3 == 1, F.sequence(F.lit(1), F.lit(7))).otherwise(F.array(player))
    return A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("game"), t.alias("log_idx"), F.floor(t / 3).alias("day"), (t % 3 == 0).alias("is_night"), event.alias("event"), F.array(player).alias("players"), viewer.alias("viewer"))


@query(f"""WITH {_LOG}, m AS (SELECT *, max(day) OVER (PARTITION BY game) AS now FROM l)
SELECT game, max(now) AS day, coalesce(string_agg(day || ':' || p, ',' ORDER BY day, p) FILTER (event = 'end_vote'), '') AS exiles, max(day || ':' || p) FILTER (event = 'end_night' AND day = now - 1) AS night,
  array_to_string(list_filter(range(1, 8), lambda i: NOT list_contains(coalesce(list(p) FILTER (event <> 'speech'), []), i)), ',') AS alive FROM m GROUP BY 1""")
def public_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.public_state(_log(spark, sf_dir))
    exiles = F.array_join(F.transform("prior_exiles", lambda x: F.concat_ws(":", x["day"].cast("string"), x["player"].cast("string"))), ",")
    night = F.concat_ws(":", F.col("last_night.day").cast("string"), F.array_join(F.col("last_night.dead").cast("array<string>"), ","))
    return out.select("game", F.col("day").cast("long").alias("day"), exiles.alias("exiles"), F.when(F.col("last_night").isNotNull(), night).alias("night"), F.array_join(F.col("alive").cast("array<string>"), ",").alias("alive"))


@query(f"""WITH {_LOG} SELECT count(*) AS visible, count_if(event = 'speech') AS speeches FROM l WHERE event = 'speech' OR p = 3""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = G.visible(_log(spark, sf_dir), F.lit(3))
    return seen.agg(F.count("*").alias("visible")).crossJoin(F.broadcast(G.speeches(seen).agg(F.count("*").alias("speeches"))))  # one row each


@query(f"""WITH {_LOG} SELECT game, md5(string_agg('day ' || day || ' ' || CASE WHEN event = 'end_night' THEN 'night' ELSE 'day' END || ' | ' || event || ' | ' || p, chr(10) ORDER BY log_idx)) AS digest FROM l GROUP BY 1""")
def rendered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rendered(_log(spark, sf_dir)).select("game", F.md5("text").alias("digest"))


@query("""WITH o AS (SELECT o_custkey AS run, o_orderkey AS epoch, round(o_totalprice / 50000) AS loss FROM orders), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT run, epoch, before IS NULL OR loss < before AS is_best FROM b""")
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.round(F.col("o_totalprice") / 50000).alias("loss"))
    return R.best_epochs(o).select("run", "epoch", "is_best")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT c_custkey AS g FROM customer)
SELECT 'overlap' AS what, g FROM a JOIN b USING (g) UNION ALL SELECT 'unassigned', g FROM c WHERE g NOT IN (SELECT g FROM a) UNION ALL SELECT 'union', g FROM (SELECT g FROM a UNION SELECT g FROM b)""")
def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), "o_orderstatus")
    a, b = o.where("o_orderstatus = 'F'").select("g"), o.where("o_orderstatus = 'P'").select("g")
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g"))
    named = lambda what, t: t.select(F.lit(what).alias("what"), "g")
    return named("overlap", R.overlapping(a, b, "g")).unionByName(R.uncovered(c, a, "g").select(F.col("side").alias("what"), "g")).unionByName(named("union", R.united(a, b)))


@query("""SELECT CASE WHEN game % 10 < 7 THEN 'train' WHEN game % 10 < 9 THEN 'test' END AS split, count(*) AS n, max(seq) AS last FROM (SELECT user_id AS game, event_id AS seq FROM events) WHERE game % 10 < 9 GROUP BY 1""")
def assigned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"))
    manifest = e.select("game_id").distinct().where("game_id % 10 < 9").withColumn("split", F.when(F.col("game_id") % 10 < 7, "train").otherwise("test"))
    return R.assigned(e, manifest).groupBy("split").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN 'm' WHEN 2 THEN 'n' WHEN 3 THEN 'm,n' ELSE '' END AS misaligned FROM customer""")
def misaligned_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    a, b = (c % 3 + 1).cast("int"), (c % 3 + 4).cast("int")
    name = lambda x: F.concat(F.lit("player"), x.cast("string"))
    full, part = F.create_map(name(b), F.lit(1), name(a), F.lit(2)), F.create_map(name(a), F.lit(1))
    rows = A.table(spark, sf_dir, "customer").select(c.alias("id"), F.array(a, b).alias("observers"), F.when(c % 4 == 1, part).when(c % 4 == 3, F.lit(None)).otherwise(full).alias("m"), F.when(c % 4 >= 2, F.when(c % 2 == 0, F.create_map(name(a), F.lit(1), F.lit("player7"), F.lit(2)))).otherwise(full).alias("n"))
    return R.misaligned_maps(rows, "observers", ["m", "n"]).select("id", F.array_join("misaligned", ",").alias("misaligned"))


@query("""SELECT 'lineage' AS what, count(DISTINCT (coalesce(event_type, ''), user_id % 3)) AS n FROM events UNION ALL SELECT 'types', count(DISTINCT event_type) FROM events UNION ALL SELECT 'games', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_id % 20 HAVING count(*) > 1)""")
def contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").withColumn("third", F.col("user_id") % 3).withColumn("idx", F.col("event_id") % 20)
    row = lambda what, t, c: t.select(F.lit(what).alias("what"), F.col(c).alias("n"))
    counts = R.distinct_counts(e, ["event_type", "user_id"])
    return row("lineage", R.homogeneous(e, ["event_type", "third"]), "n_values").unionByName(row("types", counts, "event_type")).unionByName(row("games", counts, "user_id")).unionByName(row("repeated", R.duplicates(e, ["user_id", "idx"]).agg(F.count("*").alias("n")), "n"))


@query("""WITH n AS (SELECT conv_id AS game, turn AS seq, 'n-' || conv_id || '-' || turn AS nonce, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT game, CAST(0 AS BIGINT) AS actor, seq, turn_leaks AS nonce_leaks, false AS response_leaks FROM (SELECT *, nxt % 3 = 0 AS turn_leaks FROM n WHERE nxt IS NOT NULL) WHERE turn_leaks""")
def contaminated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    nonce = lambda turn: F.concat(F.lit("n-"), c.cast("string"), F.lit("-"), turn.cast("string"))
    turns = A.table(spark, sf_dir, "conversations").withColumn("former", F.lag("turn").over(_by_conversation()))
    base = turns.select(c.alias("game"), F.lit(0).cast("long").alias("actor"), (2 * t + 1).alias("seq"), nonce(t).alias("nonce"), F.lit("\u0001no such answer").alias("response"))
    requests = turns.select(c.alias("game"), F.lit(0).cast("long").alias("actor"), (2 * t).alias("seq"), F.when(t % 3 == 0, F.concat(F.col("text"), F.coalesce(nonce(F.col("former")), F.lit("")))).otherwise(F.col("text")).alias("text"))
    return R.contaminated(base, requests).withColumn("seq", F.floor(F.col("seq") / 2))


def _by_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


@query("""SELECT o_custkey AS game FROM orders GROUP BY 1 HAVING bool_or(o_totalprice < 20000) OR bool_and(o_orderstatus = 'P' AND o_totalprice >= 20000)""")
def bad_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("o_totalprice") < 20000, -1.0).when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    return R.bad_weights(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game"), weight.alias("weight")), ["game"])


@query("""WITH r AS (SELECT l_orderkey AS game, CASE l_partkey % 3 WHEN 0 THEN 'wolf' WHEN 1 THEN 'seer' ELSE 'fool' END AS role FROM lineitem), g AS (SELECT DISTINCT game FROM r), d AS (SELECT * FROM (VALUES ('wolf', 2), ('seer', 1), ('fool', 0)) v(role, due)
), n AS (SELECT g.game, d.role, count(r.role) AS n, any_value(due) AS due FROM g CROSS JOIN d LEFT JOIN r ON r.game = g.game AND r.role = d.role GROUP BY 1, 2) SELECT game, role, CAST(n AS INT) AS n, CAST(due AS INT) AS due FROM n WHERE n <> due""")
def role_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    roles = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.when(k == 0, "wolf").when(k == 1, "seer").otherwise("fool").alias("role"))
    return R.role_faults(roles, {"wolf": 2, "seer": 1})


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing:game_id,invalid:step_idx' WHEN 2 THEN 'invalid:phase,invalid:speaker_id' WHEN 3 THEN 'invalid:game_id,missing:report_trigger' ELSE 'missing:game_id,missing:step_idx,missing:phase,missing:speaker_id,missing:report_trigger' END AS violations FROM conversations""")
def snapshot_key_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = (F.col("conv_id") + F.col("turn")) % 5, F.col("turn").cast("string")
    said = F.to_json(F.struct(F.col("text").alias("report_trigger")))
    body = F.regexp_extract(said, r"^\{([\s\S]*)\}$", 1)
    line = (
        F.when(k == 0, F.concat(F.lit('{"game_id": "g", "step_idx": '), t, F.lit(', "phase": "1_day_speech", "speaker_id": 7, '), body, F.lit("}"))).when(k == 1, F.concat(F.lit('{"step_idx": true, "phase": "p", "speaker_id": 1, '), body, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"game_id": "g", "step_idx": 0, "phase": " ", "speaker_id": 8, '), body, F.lit("}"))).when(k == 3, '{"game_id": 5, "step_idx": 0, "phase": "p", "speaker_id": 1}').otherwise(F.col("text"))
    )
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("value"))
    return jsonl.key_violations(rows).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 13 THEN p_size ELSE 0 END AS action_id, CASE WHEN p_size BETWEEN 1 AND 7 THEN 'player' || p_size ELSE 'unknown' END AS name, CASE p_partkey % 3 WHEN 0 THEN 'seer' WHEN 1 THEN 'unknown' END AS role,
  CASE WHEN p_partkey % 2 = 0 THEN p_size END AS day, p_partkey % 2 = 0 AND p_partkey % 4 = 0 AS night, CASE p_partkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' END AS lineage, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS tokens FROM part""")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    named = F.coalesce(F.get(F.array(*map(F.lit, domain.ACTIONS)), size - 1), F.lit("none"))
    time = domain.log_time(F.when(key % 2 == 0, F.concat(F.lit("第"), size.cast("string"), F.lit("天"), F.when(key % 4 == 0, "夜晚").otherwise("白天"))).otherwise("day"))
    kind = F.when(key % 3 == 0, "a").when(key % 3 == 1, "b").otherwise("a")
    usage = F.when(key % 3 == 0, F.concat(F.lit('{"prompt_tokens": '), size.cast("string"), F.lit("}"))).when(key % 3 == 1, F.concat(F.lit('{"prompt_tokens": "9", "input_tokens": '), size.cast("string"), F.lit("}"))).otherwise('{"input_tokens": 1.5}')
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", domain.number_of(named, domain.ACTIONS).alias("action_id"), domain.name_of(size, domain.PLAYERS).alias("name"), domain.guessed_role(F.when(key % 3 == 0, " Seer ").when(key % 3 == 2, "king")).alias("role"), time["day"].alias("day"),
        F.coalesce(time["is_night"], F.lit(False)).alias("night"), domain.lineage({"private": ("a", "x"), "public": ("b", "x")}, kind, F.when(key % 3 != 2, "x")).alias("lineage"), domain.token_usage(usage)["input_tokens"].alias("tokens"),
    )


_T = """b AS (SELECT c_custkey AS id, c_custkey // 7 AS snapshot, c_custkey % 7 + 1 AS observer, c_nationkey AS bits, (c_custkey // 7) % 3 AS day, (c_custkey // 7) % 4 <> 0 AS boundary, (c_custkey // 7) % 7 + 1 AS speaker, c_custkey % 6 <> 0 AS valid FROM customer
), p AS (SELECT i AS a, j AS b, row_number() OVER (ORDER BY i, j) AS k FROM range(1, 8) x(i), range(1, 8) y(j) WHERE i < j
), w AS (SELECT id, snapshot, day, boundary AND observer <> speaker AS sup, k, a, b, CASE WHEN a = observer OR b = observer THEN 0 ELSE power(2, ((bits >> CAST(a - 1 AS INT)) & 1) + ((bits >> CAST(b - 1 AS INT)) & 1)) END AS w FROM b, p WHERE valid
), t AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS t FROM w)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    o, s = (c % 7 + 1).cast("int"), F.floor(c / 7)
    marked = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda x: (F.pmod(F.floor(F.col("c_nationkey") / F.pow(F.lit(2.0), x - 1)), F.lit(2)) == 1) & (x != o))
    target = B.vector(B.distribution(F.array().cast("array<int>"), F.array(o), marked))
    return A.customers(spark, sf_dir).select(c.alias("id"), s.alias("snapshot"), o.alias("observer"), (s % 3).alias("day"), (s % 4 != 0).alias("boundary"), (s % 7 + 1).alias("speaker"), (c % 6 != 0).alias("valid"), target.alias("target"))


@query(f"""WITH {_T}, m AS (SELECT id, player, sum(t) AS m FROM (SELECT id, unnest([a, b]) AS player, t FROM t) GROUP BY 1, 2), ms AS (SELECT id, max(m) - min(m) AS spread FROM m GROUP BY 1
), r AS (SELECT id, snapshot, day, sup, -sum(CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END) AS h, max(t) AS top, list_sort(list(t), 'DESC')[2] AS second, 0.5 * sum(abs(t - 1 / 21)) AS tv FROM t GROUP BY 1, 2, 3, 4
), l AS (SELECT snapshot, day, sup, unnest([{{'s': 'pair_entropy', 'v': h}}, {{'s': 'max_probability', 'v': top}}, {{'s': 'top1_top2_margin', 'v': top - second}}, {{'s': 'tv_from_uniform', 'v': tv}}, {{'s': 'entropy_gap_from_uniform', 'v': ln(21) - h}}, {{'s': 'marginal_spread', 'v': spread}}]) AS x FROM r JOIN ms USING (id)
), q AS (SELECT x.id AS i, y.id AS j, x.snapshot, x.day, x.sup AND y.sup AS both_sup, sum(0.5 * abs(x.t - y.t)) AS d FROM t x JOIN t y ON x.snapshot = y.snapshot AND x.id < y.id AND x.k = y.k GROUP BY ALL
), z AS (SELECT 'all' AS scope, x.s AS statistic, x.v AS value, day FROM l UNION ALL SELECT 'supervised', x.s, x.v, day FROM l WHERE sup
  UNION ALL SELECT 'all', 'observer_pairwise_tv', avg(d), day FROM q GROUP BY snapshot, day UNION ALL SELECT 'supervised', 'observer_pairwise_tv', avg(d), day FROM q WHERE both_sup GROUP BY snapshot, day)
SELECT scope, statistic, day, count(*) AS count, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max FROM z GROUP BY GROUPING SETS ((scope, statistic), (scope, statistic, day))""")
def target_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.audit_values(_targets(spark, sf_dir), ["day"])
    return out.select("scope", "statistic", "day", "count", *[F.round(c, 6).alias(c) for c in ("min", "mean", "median", "max")])


@query("""WITH b AS (SELECT c_custkey // 7 AS snapshot, c_custkey % 7 + 1 AS observer, (c_custkey // 7) % 3 AS day, (c_custkey // 7) % 4 <> 0 AS boundary, (c_custkey // 7) % 7 + 1 AS speaker, c_custkey % 6 <> 0 AS valid FROM customer
), s AS (SELECT snapshot, day, any_value(boundary) AS boundary, count_if(valid) AS v, count_if(valid AND boundary AND observer <> speaker) AS s FROM b GROUP BY 1, 2)
SELECT day, count(*) AS snapshots, count_if(boundary) AS boundaries, count_if(s > 0) AS supervised_snapshots, CAST(sum(v) AS BIGINT) AS valid_rows, CAST(sum(s) AS BIGINT) AS supervised_rows, count_if(s = 5) AS with_5, round(count_if(s > 0) / count(*), 9) AS supervised_fraction, count_if(NOT boundary) AS non_boundaries, count_if(s = 0) AS filtered_snapshots, round(count_if(boundary) / count(*), 9) AS boundary_fraction FROM s GROUP BY GROUPING SETS ((), (day))""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.audit_counts(_targets(spark, sf_dir), ["day"])
    return out.select("day", "snapshots", "boundaries", "supervised_snapshots", "valid_rows", "supervised_rows", "with_5", "non_boundaries", "filtered_snapshots", *[F.round(c, 9).alias(c) for c in ("supervised_fraction", "boundary_fraction")])


@query("""SELECT DISTINCT c_custkey // 7 AS snapshot FROM customer WHERE (c_custkey // 7) % 4 <> 0 AND c_custkey % 6 <> 0 AND c_custkey % 7 <> (c_custkey // 7) % 7""")
def eligible_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.eligible(_targets(spark, sf_dir), "snapshot")


@query("""SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN 'sum' WHEN 1 THEN 'negative' WHEN 2 THEN 'size' WHEN 3 THEN CASE WHEN c_custkey % 6 = 0 THEN 'not_zero' END ELSE 'not_finite' END AS fault FROM customer""")
def target_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 5
    rows = _targets(spark, sf_dir).join(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), k.alias("k")), "id")
    t = F.col("target")
    bad = F.when(F.col("k") == 0, F.transform(t, lambda x: x * 0.5)).when(F.col("k") == 1, F.transform(t, lambda x, i: F.when(i == 3, F.lit(-0.5)).otherwise(x))).when(F.col("k") == 2, F.slice(t, 1, 20)).when(F.col("k") == 3, t).otherwise(F.transform(t, lambda x, i: F.when(i == 2, F.lit(float("nan"))).otherwise(x)))
    valid = (F.col("k") == 0) | F.col("valid")
    return rows.select("id", B.target_fault(bad, valid).alias("fault"))


@query("""SELECT l_returnflag AS split, round(coalesce(sum(l_tax * greatest(l_quantity - 10, 0)) / nullif(sum(greatest(l_quantity - 10, 0)), 0), 0), 9) AS tax, round(coalesce(sum(l_discount * greatest(l_quantity - 10, 0)) / nullif(sum(greatest(l_quantity - 10, 0)), 0), 0), 9) AS discount FROM lineitem GROUP BY 1""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.greatest(F.col("l_quantity") - 10, F.lit(0)).alias("w"))
    return B.weighted_means(rows, ["split"], ["tax", "discount"], "w").select("split", F.round("tax", 9).alias("tax"), F.round("discount", 9).alias("discount"))


@query("""WITH c AS (SELECT c_custkey // 7 AS snapshot, c_custkey % 7 + 1 AS o, c_nationkey % 4 < 2 AS ok, c_custkey % 3 = 0 AS sure, (c_custkey // 7) % 5 = 0 AS public, c_nationkey % 4 = 2 AS semantic FROM customer)
, s AS (SELECT DISTINCT snapshot FROM c), a AS (SELECT snapshot, o FROM c WHERE ok OR semantic AND NOT public AND sure)
SELECT s.snapshot, CAST(i AS INT) AS observer, a.o IS NOT NULL AS valid FROM s CROSS JOIN range(1, 8) r(i) LEFT JOIN a ON a.snapshot = s.snapshot AND a.o = i""")
def target_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.target_rows(N.decisions(A.snapshots(spark, sf_dir)), ["snapshot"]).select("snapshot", "observer", "valid")


_PLAYERS_SQL = """, m AS (SELECT id, any_value(day) AS day, any_value(sup) AS sup, player, sum(t) AS m FROM (SELECT id, day, sup, unnest([a, b]) AS player, t FROM t) GROUP BY id, player
), x AS (SELECT m.*, max(m) OVER (PARTITION BY id) AS top, (SELECT any_value(observer) FROM b WHERE b.id = m.id) AS observer FROM m)"""


@query(f"""WITH {_T}{_PLAYERS_SQL}, g AS (SELECT day, player, count_if(sup AND observer = player) AS supervised_rows, avg(m) AS mean, count_if(abs(m - top) <= 1e-8 + 1e-5 * top) AS top_count, grouping(day) AS a FROM x GROUP BY GROUPING SETS ((player), (day, player)))
SELECT day, CAST(player AS INT) AS player, supervised_rows, round(mean, 9) AS mean_marginal, top_count, round(max(mean) OVER (PARTITION BY a, day) - min(mean) OVER (PARTITION BY a, day), 9) AS gap FROM g""")
def target_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.audit_players(_targets(spark, sf_dir), ["day"]).withColumn("mean_marginal", F.round("mean_marginal", 9)).withColumn("gap", F.round("gap", 9))


@query(f"""WITH {_T}{_PLAYERS_SQL}, o AS (SELECT (player - 1 + e) % 7 + 1 AS player, (observer - 1 + e) % 7 + 1 AS observer, m, top, sup FROM x, range(0, 7) r(e)
), g AS (SELECT player, count_if(sup AND observer = player) AS supervised_rows, avg(m) AS mean, count_if(abs(m - top) <= 1e-8 + 1e-5 * top) AS top_count FROM o GROUP BY 1)
SELECT CAST(player AS INT) AS player, supervised_rows, round(mean, 9) AS mean_marginal, top_count, round(max(mean) OVER () - min(mean) OVER (), 9) AS gap FROM g""")
def orbit_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.audit_orbit(_targets(spark, sf_dir)).withColumn("mean_marginal", F.round("mean_marginal", 9)).withColumn("gap", F.round("gap", 9))
