"""All queries of the library and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldra.functions import domain, text
from veldra.operators import beliefs as B, games as G, monitor as M, relations as R, snapshots as N, splits as S
from veldra.plans import adapters as A, contracts, rows  # noqa: F401  (they register their queries)
from veldra.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401

_BELIEFS = """b AS (
  SELECT c_custkey AS report_id, c_custkey % 7 + 1 AS observer, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey + 2) % 7 + 1 END AS wolf, c_nationkey AS bits FROM customer
), p AS (SELECT i AS a, j AS b FROM range(1, 8) x(i), range(1, 8) y(j) WHERE i < j
), s AS (
  SELECT report_id, observer, a, b, wolf, a <> coalesce(wolf, 0) AND (bits >> CAST(a - 1 AS INT)) & 1 = 1 AS sa, b <> coalesce(wolf, 0) AND (bits >> CAST(b - 1 AS INT)) & 1 = 1 AS sb
  FROM b, p WHERE a <> observer AND b <> observer AND (wolf IS NULL OR a = wolf OR b = wolf)
), t AS (
  SELECT *, power(2, CAST(sa AS INT) + CAST(sb AS INT)) / sum(power(2, CAST(sa AS INT) + CAST(sb AS INT))) OVER (PARTITION BY report_id) AS p FROM s
)"""


@query(f"WITH {_BELIEFS}, m AS (SELECT report_id, unnest([a, b]) AS player, p FROM t) SELECT report_id, CAST(player AS INT) AS player, round(sum(p), 9) AS marginal FROM m GROUP BY 1, 2")
def pair_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.marginals(A.beliefs(spark, sf_dir), ["report_id"]).withColumn("marginal", F.round("marginal", 9))


@query(f"WITH {_BELIEFS} SELECT report_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(p, 9) AS p FROM t")
def pair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.targets(A.beliefs(spark, sf_dir)).select("report_id", "a", "b", F.round("p", 9).alias("p"))


@query(f"""WITH {_BELIEFS}, n AS (SELECT report_id, any_value(wolf) AS wolf, any_value(observer) AS observer, count(*) AS n_legal FROM t GROUP BY 1)
SELECT report_id, coalesce(CAST(wolf AS VARCHAR), '') AS known, CAST(observer AS VARCHAR) AS cleared, CAST(n_legal AS INT) AS n_legal FROM n""")
def knowledge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = N.compatible(F.col("known"), F.col("cleared"))
    out = A.beliefs(spark, sf_dir).select("report_id", N.closure(pairs).alias("shut"), F.size(pairs).alias("n_legal"))
    return out.select("report_id", F.array_join(F.col("shut.known").cast("array<string>"), ",").alias("known"), F.array_join(F.col("shut.cleared").cast("array<string>"), ",").alias("cleared"), "n_legal")


@query(f"""WITH {_BELIEFS}, m AS (SELECT report_id, unnest([a, b]) AS player, p FROM t), g AS (SELECT report_id, player, sum(p) AS marginal FROM m GROUP BY 1, 2
), x AS (SELECT *, max(marginal) OVER (PARTITION BY report_id) AS top FROM g) SELECT CAST(player AS INT) AS player, count(*) AS n FROM x WHERE abs(marginal - top) <= 1e-8 + 1e-5 * abs(top) GROUP BY 1""")
def most_suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.most_suspected(A.beliefs(spark, sf_dir)).groupBy("player").agg(F.count("*").alias("n"))


_P = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), p AS (SELECT vec_id, vec_id // 4 AS snapshot, vec_id % 4 + 1 AS observer, unnest(range(1, 22)) AS i, v FROM v
), l AS (SELECT vec_id, snapshot, observer, i, v[i] AS z, abs(v[i + 21]) AS w FROM p
), t AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS t, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS q FROM l)"""


_M = """, pl AS (SELECT row_number() OVER (ORDER BY a, b) AS i, a, b FROM range(1, 8) x(a), range(1, 8) y(b) WHERE a < b
), mm AS (SELECT vec_id, any_value(t.observer) AS observer, pl.player, sum(q) AS qm, sum(t) AS tm FROM t JOIN (SELECT i, unnest([a, b]) AS player FROM pl) pl USING (i) GROUP BY vec_id, pl.player
), ms AS (SELECT vec_id, round(sum(abs(qm - tm)) / 7, 6) AS marginal_mae, round(abs(sum(qm) - 2), 6) AS row_sum_error, round(max(qm) - min(qm), 6) AS predicted_spread, round(max(tm) - min(tm), 6) AS target_spread,
  round(max(qm) FILTER (player = observer), 6) AS predicted_diagonal, round(max(tm) FILTER (player = observer), 6) AS target_diagonal FROM mm GROUP BY 1)"""


@query(f"WITH {_P}{_M} SELECT * FROM ms")
def marginal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.row_metrics(A.predictions(spark, sf_dir), "observer")
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("marginal_mae", "row_sum_error", "predicted_spread", "target_spread", "predicted_diagonal", "target_diagonal")])


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC) AS k FROM t)
SELECT vec_id, round(-sum(t * ln(q)), 6) AS cross_entropy, round(sum(CASE WHEN t > 0 THEN t * ln(t / q) ELSE 0 END), 6) AS kl, round(0.5 * sum(abs(t - q)), 6) AS tv,
  round(-sum(q * ln(q)), 6) AS entropy, round(max(q) FILTER (k = 1) - max(q) FILTER (k = 2), 6) AS margin FROM r GROUP BY 1""")
def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.row_metrics(A.predictions(spark, sf_dir)).select("vec_id", *[F.round(c, 6).alias(c) for c in ("cross_entropy", "kl", "tv", "entropy", "margin")])


@query(f"""WITH {_P} SELECT a.snapshot, round(sum(0.5 * abs(a.q - b.q)) / count(DISTINCT (a.observer, b.observer)), 6) AS pairwise_tv
FROM t a JOIN t b ON a.snapshot = b.snapshot AND a.observer < b.observer AND a.i = b.i GROUP BY 1""")
def observer_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.observer_tv(B.row_metrics(A.predictions(spark, sf_dir)), "snapshot", "observer").withColumn("pairwise_tv", F.round("pairwise_tv", 6))


@query(f"""WITH {_P}, r AS (SELECT vec_id, observer, sum(CASE WHEN t > 0 THEN t * ln(t / q) ELSE 0 END) AS kl FROM t GROUP BY 1, 2)
SELECT round(coalesce(avg(CASE WHEN observer <> 2 THEN kl END), 0), 6) AS effective_kl, round(coalesce(avg(CASE WHEN observer > 9 THEN kl END), 0), 6) AS empty_kl, count_if(observer <> 2) AS effective_rows FROM r""")
def masked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.row_metrics(A.predictions(spark, sf_dir))
    effective = F.col("observer") != 2
    return rows.agg(F.round(B.masked_mean(F.col("kl"), effective), 6).alias("effective_kl"), F.round(B.masked_mean(F.col("kl"), F.col("observer") > 9), 6).alias("empty_kl"), F.count_if(effective).alias("effective_rows"))


_R = """r AS (SELECT event_id AS seq, user_id % 50 AS game, user_id % 7 + 1 AS observer, (event_id % 3 + 1) || '_day_speech' AS phase, event_id // 7 AS sample,
  CASE event_type WHEN 'error' THEN 'parse_error' WHEN 'signup' THEN 'semantic_error' ELSE 'ok' END AS status FROM events)"""


@query(f"""WITH {_R} SELECT game, phase, observer, status, count(*) AS n, round(count_if(status <> 'ok') / count(*), 9) AS invalid_rate, round(count_if(status = 'parse_error') / count(*), 9) AS parse_error_rate,
  CAST(grouping(game, phase, observer, status) AS BIGINT) AS level FROM r GROUP BY GROUPING SETS ((), (status), (observer), (observer, status), (game, phase), (game, phase, status))""")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.counters(A.reports(spark, sf_dir))
    return out.withColumn("invalid_rate", F.round("invalid_rate", 9)).withColumn("parse_error_rate", F.round("parse_error_rate", 9))


_STREAK = """i AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY seq) - row_number() OVER (PARTITION BY observer, status ORDER BY seq) AS island FROM r
), k AS (SELECT seq, observer, status, CASE WHEN status = 'ok' THEN 0 ELSE row_number() OVER (PARTITION BY observer, status, island ORDER BY seq) END AS streak FROM i)"""


@query(f"WITH {_R}, {_STREAK} SELECT seq, observer, status, CAST(streak AS INT) AS streak FROM k")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.streaks(A.reports(spark, sf_dir), 9).select("seq", "observer", "status", F.col("streak").cast("int").alias("streak"))


_RATES = """o AS (SELECT seq, count(*) OVER w AS seen, sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS invalid_rate FROM r WINDOW w AS (PARTITION BY observer ORDER BY seq)
), g AS (SELECT seq, count(*) OVER w AS total, sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS tir, sum(CASE WHEN status = 'parse_error' THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS tpr FROM r WINDOW w AS (ORDER BY seq))"""


@query(f"WITH {_R}, {_RATES} SELECT seq, seen, round(invalid_rate, 9) AS invalid_rate, total, round(tir, 9) AS total_invalid_rate, round(tpr, 9) AS total_parse_rate FROM o JOIN g USING (seq)")
def running_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.total_rates(M.observer_rates(A.reports(spark, sf_dir), 9), 9)
    return rows.select("seq", "seen", F.round("invalid_rate", 9).alias("invalid_rate"), "total", F.round("total_invalid_rate", 9).alias("total_invalid_rate"), F.round("total_parse_rate", 9).alias("total_parse_rate"))


@query(f"""WITH {_R}, {_STREAK}, {_RATES}, x AS (SELECT seq, CASE WHEN streak >= 3 THEN '1_streak' WHEN seen >= 10 AND invalid_rate > 0.2 THEN '2_observer_rate'
  WHEN total >= 100 AND tir > 0.05 THEN '3_total_rate' WHEN total >= 100 AND tpr > 0.01 THEN '4_parse_rate' END AS rule FROM k JOIN o USING (seq) JOIN g USING (seq))
SELECT seq, rule FROM x WHERE rule IS NOT NULL ORDER BY seq LIMIT 1""")
def first_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_stop(A.reports(spark, sf_dir), 9)


@query(f"""WITH {_R}, {_STREAK}, {_RATES}, x AS (SELECT seq, sample FROM k JOIN o USING (seq) JOIN g USING (seq) JOIN r USING (seq)
  WHERE streak >= 3 OR seen >= 10 AND invalid_rate > 0.2 OR total >= 100 AND (tir > 0.05 OR tpr > 0.01) ORDER BY seq LIMIT 1)
SELECT game, count(*) AS n, max(seq) AS last FROM r WHERE seq <= (SELECT max(r.seq) FROM r JOIN x ON r.sample = x.sample) GROUP BY 1""")
def reports_until_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.until_stop(A.reports(spark, sf_dir), "sample", 9).groupBy("game").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


_C = """c AS (SELECT event_id AS call_id, user_id % 50 AS game, CASE WHEN event_type IN ('click', 'view') THEN 'gameplay' ELSE 'belief' END AS category, event_type = 'error' AS failed, value AS latency_ms,
  event_id % 3 = 0 AS usage, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS tokens FROM events)"""


@query(f"""WITH {_C}, k AS (SELECT *, category AS cat FROM c UNION ALL SELECT *, NULL FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY latency_ms, call_id) AS k, count(*) OVER (PARTITION BY cat) AS n FROM k)
SELECT cat AS category, count(*) AS calls, count_if(failed) AS errors, count_if(usage) AS usage_available, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS input_tokens, round(avg(latency_ms), 6) AS mean_ms, round(median(latency_ms), 6) AS median_ms,
  max(CASE WHEN k = ceil(0.95 * n) THEN latency_ms END) AS p95_ms, max(latency_ms) AS max_ms FROM s GROUP BY 1""")
def call_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.call_audit(A.calls(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("median_ms", F.round("median_ms", 6))


@query(f"""WITH {_C}, k AS (SELECT game, category, call_id AS seq, row_number() OVER (PARTITION BY game ORDER BY call_id) AS n, row_number() OVER (PARTITION BY game, category ORDER BY call_id) AS m FROM c
), h AS (SELECT game, seq, CASE WHEN n > 150 THEN 'total' WHEN category = 'belief' AND m > 90 THEN 'belief' WHEN category = 'gameplay' AND m > 70 THEN 'gameplay' END AS budget FROM k
), f AS (SELECT game, min(seq) AS seq FROM h WHERE budget IS NOT NULL GROUP BY 1) SELECT h.* FROM h JOIN f USING (game, seq)""")
def refused_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refused(A.calls(spark, sf_dir), {"gameplay": 70, "belief": 90, "total": 150})


@query("SELECT user_id % 50 AS game, event_id AS seq, CAST(501 AS BIGINT) AS n FROM events ORDER BY event_id LIMIT 1 OFFSET 500")
def total_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.over_total(A.calls(spark, sf_dir), 500, 7)


@query(f"""WITH {_C} SELECT game, count_if(category = 'gameplay') AS gameplay, count_if(category = 'belief') AS belief, count(*) AS total, count_if(failed) AS failed, CASE WHEN game % 3 = 0 THEN 'completed' ELSE 'partial' END AS state FROM c GROUP BY 1""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = A.calls(spark, sf_dir)
    return M.run_summaries(calls, calls.where("game % 3 = 0"))


@query("""WITH v AS (SELECT l_orderkey AS round, l_partkey % 8 AS target, count(*) AS n FROM lineitem GROUP BY 1, 2
), r AS (SELECT *, rank() OVER (PARTITION BY round ORDER BY n DESC) AS k FROM v WHERE target <> 0
), t AS (SELECT round, count(*) AS n_leaders, min(target) AS leader FROM r WHERE k = 1 GROUP BY 1)
SELECT v.round, CAST(any_value(CASE WHEN n_leaders = 1 THEN leader END) AS INT) AS exiled, CAST(coalesce(any_value(n_leaders), 0) AS INT) AS n_leaders, CAST(sum(CASE WHEN target = 0 THEN n ELSE 0 END) AS BIGINT) AS abstained
FROM v LEFT JOIN t ON t.round = v.round GROUP BY v.round""")
def exile_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.exile(A.ballots(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey AS round, l_linenumber AS voter, l_partkey % 8 AS target, l_partkey * 100000 + l_suppkey AS ballot FROM lineitem WHERE l_partkey % 8 <> 0
), v AS (SELECT round, target, count(*) AS n FROM b GROUP BY 1, 2
), r AS (SELECT *, rank() OVER (PARTITION BY round ORDER BY n DESC) AS k FROM v
), t AS (SELECT round, count(*) AS ties, min(target) AS leader FROM r WHERE k = 1 GROUP BY 1
), l AS (SELECT round, target, row_number() OVER (PARTITION BY round ORDER BY voter DESC, ballot DESC) AS k FROM b)
SELECT t.round, CAST(CASE WHEN ties = 1 THEN leader ELSE l.target END AS INT) AS killed FROM t JOIN l ON l.round = t.round AND l.k = 1""")
def kill_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kill(A.ballots(spark, sf_dir))


@query("""WITH n AS (SELECT c_custkey AS game, c_custkey % 7 + 1 AS k, c_nationkey % 7 + 1 AS g, c_custkey % 3 = 0 AS h, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 5 + 1 END AS p FROM customer)
SELECT game, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN (k = g) = h THEN k END, p], lambda x: x IS NOT NULL))), ',') AS deaths FROM n""")
def night_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    died = G.night((c % 7 + 1).cast("int"), (F.col("c_nationkey") % 7 + 1).cast("int"), c % 3 == 0, F.when(c % 4 == 0, (F.col("c_nationkey") % 5 + 1).cast("int")))
    return A.table(spark, sf_dir, "customer").select(c.alias("game"), F.array_join(died.cast("array<string>"), ",").alias("deaths"))


@query("""WITH a AS (SELECT o_custkey % 500 AS game, CASE o_orderstatus WHEN 'F' THEN 'wolf' WHEN 'O' THEN 'villager' ELSE 'god' END AS camp FROM orders)
SELECT game, CASE WHEN count_if(camp = 'wolf') = 0 THEN -1 WHEN count_if(camp = 'villager') = 0 OR count_if(camp = 'god') = 0 THEN 1 ELSE 0 END AS outcome FROM a GROUP BY 1""")
def game_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    camp = F.when(F.col("o_orderstatus") == "F", "wolf").when(F.col("o_orderstatus") == "O", "villager").otherwise("god")
    return G.outcome(A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("game"), camp.alias("camp")))


@query("""WITH l AS (SELECT user_id AS game, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT count_if(outcome = 1) AS wolf, count_if(outcome <> 1) AS villager FROM l WHERE k = 1""")
def win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return G.wins(e.select(F.col("user_id").alias("game"), F.col("event_id").alias("log_idx"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("outcome")))


_E = "e AS (SELECT conv_id AS game, turn AS event_idx, CASE WHEN turn % 3 = 0 THEN (turn + 1) || '_day_speech' END AS phase, length(text) AS n_tokens FROM conversations)"


@query(f"WITH {_E}, p AS (SELECT game, event_idx, row_number() OVER (PARTITION BY game ORDER BY event_idx) - 1 AS place FROM e WHERE event_idx <> game % 8) SELECT game, event_idx, CAST(place AS INT) AS place FROM p WHERE place <> event_idx")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.discontinuities(A.events(spark, sf_dir).where("event_idx <> game % 8"))


@query(f"WITH {_E} SELECT game, event_idx, last_value(phase IGNORE NULLS) OVER (PARTITION BY game ORDER BY event_idx ROWS UNBOUNDED PRECEDING) AS current_phase FROM e")
def current_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latest_phase(A.events(spark, sf_dir)).select("game", "event_idx", "current_phase")


@query(f"""WITH {_E}, b AS (SELECT *, sum(n_tokens) OVER w AS up_to, row_number() OVER w AS age FROM e WINDOW w AS (PARTITION BY game ORDER BY event_idx DESC ROWS UNBOUNDED PRECEDING))
SELECT game, event_idx, CAST(CASE WHEN up_to <= 2000 THEN n_tokens ELSE 2000 END AS BIGINT) AS kept_tokens FROM b WHERE up_to <= 2000 OR age = 1""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.newest_groups(A.events(spark, sf_dir), 2000)


@query("""WITH s AS (SELECT conv_id AS game, turn AS row_idx, list_transform(range(0, CASE WHEN turn % 4 = 3 THEN turn ELSE turn + 1 END), lambda i: i) AS events FROM conversations
), l AS (SELECT *, lag(events) OVER (PARTITION BY game ORDER BY row_idx) AS former FROM s)
SELECT game, row_idx FROM l WHERE former IS NOT NULL AND NOT (len(events) > len(former) AND events[1:len(former)] = former)""")
def broken_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("turn") % 4 == 3, F.col("turn")).otherwise(F.col("turn") + 1)
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("game"), F.col("turn").alias("row_idx"), F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")).alias("events"))
    return G.broken_prefixes(rows)


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || CAST(props->>'k' AS BIGINT) || '}') AS digest FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0""")
def event_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.substring("props", 1, 1), F.lit(' "k" :'), F.regexp_extract("props", r":\s*(\d+)", 1), F.lit(' , "event_type":"'), F.col("event_type"), F.lit('"} '))
    text_ = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("no json "), mixed)).otherwise(mixed)
    return A.table(spark, sf_dir, "events").select("event_id", domain.digest(text_).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 7 THEN 'player' || p_size END AS from_number, CASE WHEN p_size BETWEEN 1 AND 7 THEN 'player' || p_size END AS from_text,
  CAST((p_size % 7 - 1 - p_partkey % 7 + 14) % 7 AS BIGINT) AS relative FROM part""")
def player_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    relative = domain.relative_index((F.col("p_partkey") % 7), (F.col("p_size") % 7 + 7).cast("long"))
    return A.table(spark, sf_dir, "part").select("p_partkey", domain.player(F.col("p_size")).alias("from_number"), domain.player(F.concat(F.lit(" Player_ "), size)).alias("from_text"), relative.alias("relative"))


@query("""WITH o AS (SELECT o_orderkey, least(greatest(o_totalprice / 500000, 1e-5), 1 - 1e-5) AS r FROM orders), c AS (SELECT o_orderkey, r, 1.0 * (1 - r) AS p, 0.4 * r + 0.3 * (1 - r) AS b, 1.0 * r AS n FROM o)
SELECT o_orderkey, CASE WHEN p <= b AND p <= n THEN 'P' WHEN b <= n THEN 'B' ELSE 'N' END AS choice, round(p, 9) AS risk_p, round(b, 9) AS risk_b, round(n, 9) AS risk_n FROM c""")
def three_way_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domain.decision(F.col("o_totalprice") / 500000)
    return A.table(spark, sf_dir, "orders").withColumn("d", d).select("o_orderkey", "d.choice", *[F.round(f"d.risk_{n}", 9).alias(f"risk_{n.lower()}") for n in "PBN"])


@query("""WITH s AS (SELECT user_id % 100 AS game, CASE WHEN user_id % 100 < 70 THEN 'train' WHEN user_id % 100 < 85 THEN 'validation' ELSE 'test' END AS split FROM events)
SELECT split, count(*) AS rows, count(DISTINCT game) AS games FROM s GROUP BY 1""")
def seed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    game = F.concat(F.lit("run_seed_"), (F.col("user_id") % 100).cast("string"))
    rows = A.table(spark, sf_dir, "events").select(game.alias("game"), domain.seed_of(game).alias("seed"))
    return S.seed_split(rows, {"train": (0, 69), "validation": (70, 84), "test": (85, 99)}).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("game").alias("games"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.n IS DISTINCT FROM b.n""")
def misaligned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return S.misaligned(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)")
def unused_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unused(A.table(spark, sf_dir, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey"), A.table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT user_id AS game_id, count(DISTINCT event_type) AS n_splits FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leaking(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id"), F.col("event_type").alias("split")))


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + length(text)) % 8 AS k, length(text) % 7 + 1 AS a, (length(text) + 3) % 7 + 1 AS b FROM conversations), r AS (
  SELECT conv_id, turn, CASE WHEN k = 0 THEN 'reporter_error' WHEN k < 5 THEN 'parse_error' WHEN a = 1 OR b = 1 OR a <> 2 AND b <> 2 THEN 'semantic_error' ELSE 'ok' END AS status, least(a, b) AS lo, greatest(a, b) AS hi FROM c)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN 'player' || lo || ',player' || hi END AS suspected FROM r""")
def report_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    k, a, b = (F.col("conv_id") + n) % 8, (n % 7 + 1).cast("string"), ((n + 3) % 7 + 1).cast("string")
    pair = F.concat(F.lit('["player'), a, F.lit('", "player'), b, F.lit('"]'))
    key = F.lit('{"suspected_werewolves": ')
    response = (
        F.when(k == 1, F.concat(key, pair, F.lit(', "more": 1}'))).when(k == 2, F.concat(key, F.lit('["'), a, F.lit('"]}'))).when(k == 3, F.concat(key, F.lit('["player'), a, F.lit('", "player'), a, F.lit('"]}')))
        .when(k == 4, F.col("text")).otherwise(F.concat(F.lit(" "), key, pair, F.lit("}\n")))
    )
    r = text.report(response, k == 0, F.array(F.lit("player2")), F.array(F.lit("player1")))
    return A.table(spark, sf_dir, "conversations").withColumn("r", r).select("conv_id", "turn", "r.status", F.array_join("r.suspected", ",").alias("suspected"))


def _acts(c) -> Column:
    return F.array_join(F.transform(c, lambda t: F.concat_ws(":", t["subject"], t["action"], t["object"])), ",")


#: Ten shapes of a parser's response ({n} and {o} are digits of players), with the actions in them, and their tolerant and strict status.
_SHAPES = {
    0: ("{n} | point_as_werewolf | {o}", "point_as_werewolf:{o}", "parsed", "parsed"),
    1: ("```\n- Player {n} ｜ CHECK_AS_GOOD ｜ player {o},\n2) 1|support|{o}。\n```", "check_as_good:{o} support:{o}", "parsed", "failed"),
    2: ("NONE.", "", "empty", "empty"),
    3: ("无动作", "", "empty", "empty"),
    4: ('so: [[1, "oppose", {o}], [9], {"action": "Save", "object": "player{n}"}] end', "oppose:{o} save:{n}", "parsed", "failed"),
    5: ('[[1, "oppose", {o}]]', "oppose:{o}", "parsed", "parsed"),
    6: ("words\nno action!", "", "empty", "failed"),
    7: ("{n} | fly | {o}\n{n} | guard | {o}", "guard:{o}", "parsed", "failed"),
    8: ("{n} | check_as_werewolf | {o}\n{n} | point_as_werewolf | {o}\n{n} | check_as_werewolf | {o}", "check_as_werewolf:{o}", "parsed", "parsed"),
    9: ("words only", "", "failed", "failed"),
}
_SAID = """c AS (SELECT conv_id, turn, text, (conv_id + turn) % 10 AS k, length(text) % 7 + 1 AS n, conv_id % 7 + 1 AS o, length(text) % 3 = 0 AS claims FROM conversations)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, k, n, o, claims, speech and response, as in ``_SAID``."""
    n = F.length("text")
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 10).alias("k"), (n % 7 + 1).alias("n"), (F.col("conv_id") % 7 + 1).alias("o"), (n % 3 == 0).alias("claims"), "text")
    shape = F.lit(None).cast("string")
    for k, (said, *_) in _SHAPES.items():
        filled = F.replace(F.replace(F.lit(said), F.lit("{n}"), F.col("n").cast("string")), F.lit("{o}"), F.col("o").cast("string"))
        shape = F.when(F.col("k") == k, filled).otherwise(shape)
    speech = F.concat(F.col("text"), F.when(F.col("claims"), F.lit("。我是3号玩家，身份是预言家。")).otherwise(F.lit("。他是女巫。")))
    return rows.withColumn("response", shape).withColumn("speech", speech)


def _expected(column: int) -> str:
    """SQL for what a shape gives: 1 its actions as ``who:action:object`` in order, 2 and 3 its tolerant and strict status."""
    cases = []
    for k, row in _SHAPES.items():
        if column == 1:
            acts = " || ',' || ".join(f"'player' || n || ':{a.split(':')[0]}:player' || {a.split(':')[1][1]}" for a in row[1].split())
            cases.append(f"WHEN {k} THEN {acts or chr(39) * 2}")
        else:
            cases.append(f"WHEN {k} THEN '{row[column]}'")
    return f"CASE k {' '.join(cases)} END"


@query(f"""WITH {_SAID}, e AS (SELECT *, {_expected(1)} AS acts, {_expected(2)} AS status, {_expected(3)} AS strict_status, 'player' || n || ':point_as_seer:player' || n AS claim FROM c)
SELECT conv_id, turn, status, strict_status, CASE WHEN NOT claims OR acts LIKE claim || '%' THEN acts WHEN acts = '' THEN claim ELSE claim || ',' || acts END AS acts, CASE WHEN claims THEN claim ELSE '' END AS claims FROM e""")
def parsed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir)
    tolerant, strict = text.response_actions(F.col("response"), F.col("n")), text.response_actions(F.col("response"), F.col("n"), strict=True)
    return rows.select("conv_id", "turn", tolerant["status"].alias("status"), strict["status"].alias("strict_status"), _acts(text.spoken(F.col("speech"), F.col("response"), F.col("n"))).alias("acts"), _acts(text.role_claims(F.col("speech"), F.col("n"))).alias("claims"))


_SNAPSHOTS = """c AS (SELECT c_custkey AS k, c_custkey // 7 AS snapshot, c_custkey % 7 + 1 AS observer, (c_custkey // 7) % 7 + 1 AS speaker, (c_custkey // 7) % 5 = 0 AS public_only,
  CASE c_nationkey % 4 WHEN 2 THEN 'semantic_error' WHEN 3 THEN 'parse_error' ELSE 'ok' END AS status, c_custkey % 3 = 0 AS sure FROM customer
), w AS (SELECT *, observer % 7 + 1 AS w1, (observer + 2) % 7 + 1 AS w2, (observer + 3) % 7 + 1 AS soft FROM c
), d AS (
  SELECT *, CASE WHEN status = 'semantic_error' AND NOT public_only THEN CASE WHEN sure THEN 1 ELSE 15 END END AS n_compatible,
    CASE WHEN status = 'ok' THEN 'source' WHEN status = 'semantic_error' AND NOT public_only AND sure THEN 'deterministic_hard_knowledge' ELSE 'unavailable' END AS kind FROM w
), t AS (
  SELECT *, CASE WHEN kind = 'source' AND NOT sure THEN CAST(soft AS VARCHAR) WHEN kind = 'source' THEN w1 || '+' || w2 WHEN kind <> 'unavailable' THEN least(w1, w2) || '+' || greatest(w1, w2) END AS target FROM d
)"""


def _joined(c) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "+")


@query(f"WITH {_SNAPSHOTS} SELECT snapshot, CAST(observer AS INT) AS observer, kind, CAST(n_compatible AS INT) AS n_compatible, target FROM t")
def observer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.decisions(A.snapshots(spark, sf_dir)).select("snapshot", "observer", "kind", "n_compatible", _joined("target").alias("target"))


@query(f"WITH {_SNAPSHOTS} SELECT snapshot, CAST(observer AS INT) AS observer, kind, target FROM t WHERE observer = speaker AND kind <> 'unavailable'")
def first_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.first_order(N.decisions(A.snapshots(spark, sf_dir))).select("snapshot", "observer", "kind", _joined("target").alias("target"))


@query(f"""WITH {_SNAPSHOTS} SELECT snapshot, string_agg(observer, ',' ORDER BY observer) AS observers, string_agg(observer || '=' || target, ',' ORDER BY observer) AS targets
FROM t WHERE kind <> 'unavailable' GROUP BY 1""")
def second_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.second_order(N.decisions(A.snapshots(spark, sf_dir)), ["snapshot"])
    pairs = F.transform(F.map_entries("target"), lambda e: F.concat_ws("=", e["key"].cast("string"), _joined(e["value"])))
    return out.select("snapshot", F.array_join(F.col("observers").cast("array<string>"), ",").alias("observers"), F.array_join(pairs, ",").alias("targets"))


@query(f"""WITH {_SNAPSHOTS}, r AS (SELECT snapshot, shift, (speaker - 1 + shift) % 7 + 1 AS speaker, observer, (observer - 1 + shift) % 7 + 1 AS seat,
  list_sort(list_transform(string_split(target, '+'), lambda x: (CAST(x AS INT) - 1 + shift) % 7 + 1)) AS suspects FROM t, (SELECT unnest(range(7)) AS shift) WHERE kind <> 'unavailable')
SELECT snapshot, CAST(shift AS INT) AS shift, CAST(min(speaker) AS INT) AS speaker, string_agg(seat, ',' ORDER BY observer) AS observers, string_agg(seat || '=' || array_to_string(suspects, '+'), ',' ORDER BY seat) AS targets FROM r GROUP BY 1, 2""")
def rotated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.orbit(N.second_order(N.decisions(A.snapshots(spark, sf_dir)), ["snapshot", "speaker"]))
    out = N.rotated_rows(rows, F.col("shift"), players=("speaker",), seats=("observers",), maps=("kind",), list_maps=("target",))
    pairs = F.transform(F.array_sort(F.map_entries("target")), lambda e: F.concat_ws("=", e["key"].cast("string"), _joined(e["value"])))
    return out.select("snapshot", "shift", "speaker", F.array_join(F.col("observers").cast("array<string>"), ",").alias("observers"), F.array_join(pairs, ",").alias("targets"))


@query(f"""WITH {_BELIEFS}, m AS (SELECT unnest([a, b]) AS player, p FROM t), n AS (SELECT count(DISTINCT report_id) AS n FROM t)
SELECT CAST((player - 1 + shift) % 7 + 1 AS INT) AS player, round(sum(p) / any_value(n) / 7, 9) AS mean_marginal FROM m, n, (SELECT unnest(range(7)) AS shift) GROUP BY 1""")
def orbit_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.orbit_marginals(B.marginals(A.beliefs(spark, sf_dir), ["report_id"]), "report_id").withColumn("mean_marginal", F.round("mean_marginal", 9))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 7 + 1 AS o, c_nationkey % 8 AS k FROM customer)
SELECT id, CASE k WHEN 1 THEN 'unknown_status,error_against_status' WHEN 2 THEN 'contradiction' WHEN 3 THEN 'not_closed' WHEN 4 THEN 'suspicion_against_status' WHEN 5 THEN 'error_against_status'
  WHEN 6 THEN 'known_not_suspected' WHEN 7 THEN 'cleared_suspected' ELSE '' END AS violations FROM c""")
def report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("c_nationkey") % 8, (F.col("c_custkey") % 7 + 1).cast("int")
    seat = lambda i: ((o - 1 + i) % 7 + 1).cast("int")
    none = F.array().cast("array<int>")
    rows = A.customers(spark, sf_dir).select(
        F.col("c_custkey").alias("id"), F.when(k == 1, "lost").when((k == 2) | (k == 4), "parse_error").otherwise("ok").alias("status"),
        F.when(k == 2, F.array(seat(1), seat(2), seat(3))).when(k == 3, F.array(seat(1), seat(2))).when(k == 6, F.array(seat(1))).otherwise(none).alias("known"), F.array(o).alias("cleared"),
        F.when((k == 1) | (k == 2), F.lit(None)).when(k == 3, F.array(seat(1), seat(2))).when(k == 7, F.array(o, seat(1))).otherwise(F.array(seat(3))).alias("suspected"), F.when(k.isin(2, 4, 5), "wrong").alias("error"),
    )
    return N.report_violations(rows).select("id", F.array_join("violations", ",").alias("violations"))


@query("""WITH e AS (
  SELECT user_id AS game, user_id % 7 + 1 AS o, user_id % 4 AS role, event_type, event_id % 8 AS t FROM events
), x AS (SELECT *, o % 7 + 1 AS w1, (o + 2) % 7 + 1 AS w2 FROM e
), f AS (
  SELECT game, unnest(CASE WHEN role = 0 THEN [o, w1] WHEN role = 1 AND event_type = 'click' AND t IN (w1, w2) THEN [t] ELSE [] END) AS player, true AS bad FROM x
  UNION SELECT game, unnest(CASE WHEN role = 0 THEN list_filter(range(1, 8), lambda i: i <> o AND i <> w1) WHEN role = 1 AND event_type = 'click' AND t > 0 AND t NOT IN (w1, w2) THEN [o, t]
    WHEN role = 2 AND event_type = 'view' AND t > 0 AND t NOT IN (w1, w2) THEN [o, t] ELSE [o] END), false FROM x
), p AS (SELECT i AS a, j AS b FROM range(1, 8) r(i), range(1, 8) q(j) WHERE i < j
), k AS (SELECT game, coalesce(list(DISTINCT player) FILTER (bad), []) AS k, coalesce(list(DISTINCT player) FILTER (NOT bad), []) AS c FROM f GROUP BY 1
), l AS (SELECT game, a, b FROM k, p WHERE len(list_filter(k, lambda x: x <> a AND x <> b)) = 0 AND NOT list_contains(c, a) AND NOT list_contains(c, b)
), n AS (SELECT game, count(*) AS n FROM l GROUP BY 1
), s AS (SELECT n.game, n.n, i AS player, count(l.a) AS hits FROM n, range(1, 8) r(i) LEFT JOIN l ON l.game = n.game AND i IN (l.a, l.b) GROUP BY 1, 2, 3)
SELECT game, coalesce(string_agg(player, ',' ORDER BY player) FILTER (hits = n), '') AS known, coalesce(string_agg(player, ',' ORDER BY player) FILTER (hits = 0), '') AS cleared, CAST(n AS INT) AS n_compatible FROM s GROUP BY game, n""")
def hard_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.hard_knowledge(A.game_log(spark, sf_dir), ["game"])
    return out.select("game", F.array_join(F.col("known").cast("array<string>"), ",").alias("known"), F.array_join(F.col("cleared").cast("array<string>"), ",").alias("cleared"), "n_compatible")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[' || conv_id || ',' || turn || ']' WHEN 1 THEN '[' || CAST(to_json(text) AS VARCHAR) || ']' WHEN 2 THEN '["x"]' END AS found,
  CASE turn % 4 WHEN 0 THEN '{"turn":' || turn || '}' WHEN 1 THEN CAST(to_json(text) AS VARCHAR) WHEN 2 THEN '{"a":[' || turn || ',null],"b":true}' END AS literal FROM conversations""")
def extracted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, turn, k = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("turn") % 4
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)
    free = (
        F.when(k == 0, F.concat(F.lit("So [sic] it is [ "), id_, F.lit(" , "), turn, F.lit("], not [0]."))).when(k == 1, F.concat(F.lit("words ["), quoted, F.lit("\n]")))
        .when(k == 2, F.concat(F.lit('{"a": [1]} ```json\n["x"]\n``` ["y"]'))).otherwise(F.concat(F.lit("[NaN] "), F.regexp_replace("text", r"\[", "(")))
    )
    like = F.when(k == 0, F.concat(F.lit("```json\n{'turn': "), turn, F.lit("}\n```"))).when(k == 1, quoted).when(k == 2, F.concat(F.lit("- {'b': True, 'a': ("), turn, F.lit(", None)}"))).otherwise(F.lit('["\\ud800"]'))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_json_array(free).alias("found"), text.json_like(like).alias("literal"))


@query("""WITH c AS (SELECT conv_id, turn, (turn + 1) || '_day_speech' AS phase, 'player' || (turn % 7 + 1) AS who FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'not_at_turn_start' WHEN turn % 3 = 1 THEN 'report_trigger,latest_phase' ELSE '' END AS violations, CAST(2 AS INT) AS public_action_count,
  sha256('[{"event_idx":0,"event_type":"phase_change","phase":"' || phase || '"},{"event_idx":1,"event_type":"public_speech","sp_actions":[["player1","point_as_wolf","' || who || '"],["player1","support","player2"]],"speaker":"player1"},{"event_idx":2,"event_type":"turn_start","speaker":"' || who || '"}]') AS digest FROM c""")
def frozen_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    phase, who = F.concat((turn + 1).cast("string"), F.lit("_day_speech")), F.concat(F.lit("player"), (turn % 7 + 1).cast("string"))
    event = lambda i, kind, phase=None, speaker=None, acts=None: F.struct(F.lit(i).alias("event_idx"), F.lit(kind).alias("event_type"), F.lit(phase).alias("phase"), F.lit(speaker).alias("speaker"), F.lit(acts).alias("sp_actions"))
    said = F.array(F.array(F.lit("player1"), F.lit("point_as_wolf"), who), F.array(F.lit("player1"), F.lit("support"), F.lit("player2")))
    events = F.array(event(0, "phase_change", phase), event(1, "public_speech", None, "player1", said), event(2, "turn_start", None, who)).cast(N.EVENTS)
    other = turn % 3 == 1
    rows = A.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("game-"), F.col("conv_id").cast("string")).alias("game_id"), turn.alias("step_idx"), F.when(other, "1_day_vote").otherwise(phase).alias("phase"),
        (F.when(turn % 3 == 0, turn + 1).otherwise(turn) % 7 + 1).alias("speaker"), F.when(other, "never").otherwise("pre_speech").alias("report_trigger"), events.alias("events"),
    )
    return N.frozen(rows, ("pre_speech",)).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"), "public_action_count", F.col("public_event_digest").alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'memory' ELSE '' END AS private FROM conversations""")
def private_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.to_json(F.when(F.col("role") == "user", F.struct(F.array(F.struct(F.col("text").alias("Memory"))).alias("log"))).otherwise(F.lit(None)))
    shown = F.to_json(F.struct(F.col("text").alias("said"), F.lit('"god_view":1').alias("quoted")))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(N.private_fields(F.coalesce(json, shown), ("god_view", "memory", "teammate")), ",").alias("private"))


@query(f"""WITH {_BELIEFS}, r AS (SELECT report_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, p, row_number() OVER (PARTITION BY report_id ORDER BY a, b) AS k FROM t)
SELECT report_id, a, b, round(p, 9) AS due, CASE report_id % 10 WHEN 0 THEN round(p + 0.25, 9) END AS low, CAST(CASE report_id % 10 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS n_stored FROM r WHERE a = 6 AND b = 7 AND report_id % 10 < 2""")
def tampered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = A.beliefs(spark, sf_dir)
    last = (F.col("a") == 6) & (F.col("b") == 7)
    true = B.targets(reports).select("report_id", "a", "b", "p")
    stored = true.where(~(last & (F.col("report_id") % 10 == 1))).withColumn("p", F.when(last & (F.col("report_id") % 10 == 0), F.col("p") + 0.25).otherwise(F.col("p")))
    return B.tampered(stored, reports, ["report_id"]).select("report_id", "a", "b", F.round("due", 9).alias("due"), F.round("low", 9).alias("low"), "n_stored")


@query(f"""WITH {_SAID}, e AS (SELECT *, {_expected(1)} AS acts, {_expected(3)} AS status, ['player' || n || ':support:player' || o] AS old FROM c
), d AS (SELECT status, list_filter(string_split(CASE WHEN status IN ('parsed', 'empty') THEN acts ELSE old[1] END, ','), lambda x: x <> '') AS new, old FROM e)
SELECT status, count(*) AS n, CAST(sum(len(list_filter(new, lambda x: NOT list_contains(old, x)))) AS BIGINT) AS n_added, CAST(sum(len(list_filter(old, lambda x: NOT list_contains(new, x)))) AS BIGINT) AS n_removed FROM d GROUP BY 1""")
def reparse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = lambda c: F.concat(F.lit("player"), F.col(c).cast("string"))
    old = F.array(F.struct(who("n").alias("subject"), F.lit("support").alias("action"), who("o").alias("object")))
    r = _said(spark, sf_dir).select(text.reparsed(F.col("response"), old, F.col("n")).alias("r")).select("r.*")
    return r.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("added")).alias("n_added"), F.sum(F.size("removed")).alias("n_removed"))


_REPARSED = f"""{_SAID}, e AS (SELECT *, {_expected(1)} AS acts, {_expected(3)} AS status FROM c
), o AS (SELECT *, CASE WHEN k % 3 = 0 THEN [] WHEN k % 3 = 1 THEN ['player' || n || ':support:player' || o] ELSE ['player' || n || ':fly:player' || o, 'player9:support:player' || o] END AS old FROM e
), d AS (SELECT *, CASE WHEN status IN ('parsed', 'empty') THEN list_filter(string_split(acts, ','), lambda x: x <> '') ELSE old END AS new FROM o)"""


def _reparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new actions of each speech: a third had none, a third two that are invalid."""
    who = lambda c: F.concat(F.lit("player"), F.col(c).cast("string"))
    act = lambda s, a: F.struct(s.alias("subject"), F.lit(a).alias("action"), who("o").alias("object"))
    none = F.array().cast("array<struct<subject:string,action:string,object:string>>")
    old = F.when(F.col("k") % 3 == 0, none).when(F.col("k") % 3 == 1, F.array(act(who("n"), "support"))).otherwise(F.array(act(who("n"), "fly"), act(F.lit("player9"), "support")))
    out = _said(spark, sf_dir).withColumn("old", old).withColumn("r", text.reparsed(F.col("response"), F.col("old"), F.col("n")))
    return out.select("old", F.col("r.actions").alias("new"), (F.col("r.status") != "missing").alias("called"), (F.col("r.status") == "failed").alias("failed"))


@query(f"""WITH {_REPARSED}, v AS (SELECT *, len(list_filter(old, lambda a: a LIKE '%:fly:%' OR a LIKE 'player9%')) AS bad_old, len(list_filter(new, lambda a: a LIKE '%:fly:%' OR a LIKE 'player9%')) AS bad_new FROM d)
SELECT count(*) AS speeches, count_if(status <> 'missing') AS parser_calls, count_if(status = 'failed') AS parser_errors, count_if(len(old) > 0) AS old_nonempty, count_if(len(new) > 0) AS new_nonempty, round(count_if(len(old) > 0) / count(*), 9) AS old_coverage, round(count_if(len(new) > 0) / count(*), 9) AS new_coverage,
  CAST(sum(len(old)) AS BIGINT) AS old_actions, CAST(sum(len(new)) AS BIGINT) AS new_actions, count_if(old <> new) AS changed, count_if(old = new) AS identical, count_if(len(old) = 0 AND len(new) > 0) AS gained, count_if(len(old) > 0 AND len(new) = 0) AS lost, CAST(sum(bad_old) AS BIGINT) AS invalid_old, CAST(sum(bad_new) AS BIGINT) AS invalid_new FROM v""")
def reparse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reparse_summary(_reparsed(spark, sf_dir)).withColumn("old_coverage", F.round("old_coverage", 9)).withColumn("new_coverage", F.round("new_coverage", 9))


@query(f"""WITH {_REPARSED}, a AS (SELECT unnest(old) AS a, 'old' AS side FROM d UNION ALL SELECT unnest(new), 'new' FROM d) SELECT split_part(a, ':', 2) AS action, count_if(side = 'old') AS old, count_if(side = 'new') AS new FROM a GROUP BY 1""")
def reparse_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_counts(_reparsed(spark, sf_dir))
