"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldra.llm import bpe, caps, chat, fuzzy, minhash, negatives, packing, pii, quality, secrets, shards, substring, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), _hex("ids_csv_sha256").alias("ids_sha256"), _hex("decoded_sha256").alias("decoded_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.with_next(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", F.col("queue").alias("source_queue"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = _joined(F.filter("spans", lambda s: s["kind"] != "novel"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.link(*chat.from_turns(table(spark, sf_dir, "conversations")), chat.TURN_SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "result_turn", "depth", "status", F.array_join("faults", ",").alias("faults"), "repeats", "line")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, pii.KINDS[: pii.BASE]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_packing, op4_minhash, op5_vectors, op6_quality, op7_secrets, op8_shards, op9_tool_calls, op10_substrings, op11_pii, op12_variants, op13_negatives)}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op4_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), f AS (SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x
), n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, t.vec_id = c.component_id AS kept FROM embeddings t JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op9_tool_calls": """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS k, 'call-' || turn AS call_id, min(CASE role WHEN 'user' THEN 'reply' ELSE 'context' END) AS name FROM conversations WHERE role IS DISTINCT FROM 'assistant' GROUP BY conv_id, turn
), a AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS k, 'call-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), d AS (
  SELECT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2
), j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn AS turn, a.turn AS result_turn, d.depth AS depth,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN a.turn IS NULL THEN 'open' ELSE 'linked' END AS status,
         CASE WHEN c.turn >= 2 THEN 'call-' || (c.turn - 2) END AS after, c.text AS prompt, c.name AS name, a.text AS result, coalesce(c.k, 0) + coalesce(a.k, 0) AS repeats
  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn
)
SELECT conv_id, call_id, turn, result_turn, CAST(depth AS BIGINT) AS depth, status, CASE WHEN name = 'context' THEN 'no_schema:context' WHEN turn IS NOT NULL AND prompt IS NULL THEN 'missing:prompt' ELSE '' END AS faults, CAST(repeats AS BIGINT) AS repeats,
  '{"after":' || coalesce(CAST(to_json(after) AS VARCHAR), 'null') || ',"arguments":' || CASE WHEN turn IS NULL THEN 'null' ELSE '{' || coalesce('"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',', '') || '"turn":' || turn || '}' END
  || ',"conv_id":' || conv_id || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null')
  || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS line
FROM j""",
    "op10_substrings": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35
), g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s
), t AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1
), x AS (SELECT DISTINCT g.r, g.i + j.j AS p FROM g JOIN t USING (h), (SELECT unnest(range(0, 35)) AS j) j
), k AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w
), o AS (SELECT k.r, count(x.p) AS n_removed, string_agg(k.word, ' ' ORDER BY k.p) FILTER (WHERE x.p IS NULL) AS kept FROM k LEFT JOIN x ON x.r = k.r AND x.p = k.p GROUP BY k.r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM w LEFT JOIN o USING (r)""",
    "op12_variants": r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
), c AS (SELECT id, w, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY 1, 2
), u AS (
  SELECT w, k, list_transform(string_split(id || ':' || w, ''), lambda x: unicode(x)) AS u FROM c
), b AS (
  SELECT w, k, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [CAST(x AS BIGINT)] ELSE [CAST(192 | (x >> 6) AS BIGINT), CAST(128 | (x & 63) AS BIGINT)] END)) AS b FROM u
), h AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM b, t
), m AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM h
), n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2
), i AS (SELECT word, i, word[:i] AS head, word[i + 2:] AS tail FROM (SELECT word, unnest(range(0, length(word))) AS i FROM n)
), p AS (
  SELECT x.word AS a, y.word AS b FROM i x JOIN i y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT i.word, n.word FROM i JOIN n ON n.word = i.head || i.tail
  UNION SELECT n.word, i.word FROM i JOIN n ON n.word = i.head || i.tail
), q AS (
  SELECT p.a, p.b, y.n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY y.n DESC, p.b) AS k FROM p JOIN n y ON y.word = p.b
), f AS (
  SELECT n.word, n.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 10 * n.n THEN q.b END AS form, CASE WHEN q.n >= 10 * n.n THEN q.n END AS form_n FROM n LEFT JOIN q ON q.a = n.word AND q.k = 1
), g AS (
  SELECT word, word AS at, form AS upward FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.upward
)
SELECT f.word, f.n, f.form, g.at AS root, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word AND g.upward IS NULL""",
    "op13_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same
), n AS (
  SELECT p.a, p.b, p.k, p.score AS ps, s.b AS nb, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5
)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INT) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score, CAST(k AS INT) AS positive_rank FROM n WHERE rank <= 10""",
}
