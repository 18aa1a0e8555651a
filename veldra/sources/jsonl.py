"""Strict JSON lines: numbered scans, exact keys, violations, and sinks that never overwrite."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

#: The columns that an audit record may have.
AUDIT_COLUMNS = frozenset({"call_category", "dispatch_status", "latency_ms", "usage_available", "input_tokens", "output_tokens", "total_tokens", "game_id", "seq"})


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1, in file order) and value of every line, blank ones included.

    Blocks of a file are read apart; each line adds the lines of the blocks before its own.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("at", F.monotonically_increasing_id())
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift") + 1).alias("line_no"), "value")


def violations(lines: DataFrame, keys: list[str], blank_is_error: bool = True) -> DataFrame:
    """Lines with the array of what is wrong with them: blank, not an object, missing or unknown keys."""
    blank = F.trim("value") == ""
    have = F.json_object_keys("value")
    expected = F.array(*[F.lit(k) for k in keys])
    wrong = F.when(blank, F.array(F.lit("blank")) if blank_is_error else F.array().cast("array<string>")).when(
        F.try_parse_json("value").isNull() | have.isNull(), F.array(F.lit("not_an_object"))
    ).otherwise(F.concat(F.transform(F.array_except(expected, have), lambda k: F.concat(F.lit("missing:"), k)), F.transform(F.array_except(have, expected), lambda k: F.concat(F.lit("unknown:"), k))))
    return lines.withColumn("violations", wrong)


def _mistyped(value: Column, schema: str) -> Column:
    """``type:name`` of the top-level fields whose JSON value does not have the type that the schema gives them; null is fine for all."""
    fields = StructType.fromDDL(schema)
    shape = F.try_parse_json(value)
    kinds = {"string": ("STRING",), "bigint": ("BIGINT",), "int": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "struct": ("OBJECT",), "map": ("OBJECT",)}

    def wrong(f: StructField) -> Column:
        seen = F.schema_of_variant(F.try_variant_get(shape, f"$['{f.name}']", "variant"))
        fits = kinds.get(f.dataType.typeName() if f.dataType.typeName() in ("array", "struct", "map") else f.dataType.simpleString(), ())
        return F.when(seen.isNotNull() & (seen != "VOID") & ~functools.reduce(lambda a, b: a | b, [seen.startswith(k) for k in fits], F.lit(False)), F.lit(f"type:{f.name}"))

    return F.array_compact(F.array(*map(wrong, fields.fields)))


def read_strict(spark: SparkSession, path: str, schema: str, keys: list[str], one_value: list[str] | None = None) -> DataFrame:
    """Rows of ``schema`` with file, line_no and the raw line.

    Fails with the first bad line: blank, no object, missing or unknown keys, a
    value of another type; also if there is no line, or if the fields
    ``one_value`` (a lineage, say) do not have the same values in all rows.
    """
    lines = violations(numbered(spark, path), keys)
    lines = lines.withColumn("violations", F.when(F.size("violations") == 0, _mistyped(F.col("value"), schema)).otherwise(F.col("violations")))
    bad = lines.where("size(violations) > 0").orderBy("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}, line {bad[0]['line_no']}: {', '.join(bad[0]['violations'])}")
    rows = lines.select("file", "line_no", F.col("value").alias("raw"), F.from_json("value", schema).alias("row")).select("file", "line_no", "raw", "row.*")
    n, kinds = rows.agg(F.count("*"), F.count_distinct(F.to_json(F.struct(*(one_value or ["line_no"])), {"ignoreNullFields": "false"}))).first()
    if not n:
        raise ValueError(f"{path} is empty")
    if one_value and kinds > 1:
        raise ValueError(f"{path} mixes {kinds} values of {', '.join(one_value)}")
    return rows


#: The fields that name a snapshot.
SNAPSHOT_KEYS = ("game_id", "step_idx", "phase", "speaker_id", "report_trigger")


def key_violations(lines: DataFrame) -> DataFrame:
    """Lines with the array of what is wrong with their snapshot keys: ``missing:name`` or ``invalid:name``."""
    value = F.try_parse_json("value")
    have = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    of = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    text = lambda name: F.schema_of_variant(of(name)).eqNullSafe("STRING") & F.coalesce(F.trim(F.try_variant_get(value, f"$.{name}", "string")) != "", F.lit(False))
    number = lambda name, a, b: F.schema_of_variant(of(name)).eqNullSafe("BIGINT") & F.coalesce(F.try_variant_get(value, f"$.{name}", "bigint").between(a, b), F.lit(False))
    fine = {k: text(k) for k in SNAPSHOT_KEYS} | {"step_idx": number("step_idx", 0, (1 << 62)), "speaker_id": number("speaker_id", 1, 7)}
    wrong = [F.when(~F.array_contains(have, k), f"missing:{k}").when(~fine[k], f"invalid:{k}") for k in SNAPSHOT_KEYS]
    return lines.withColumn("violations", F.array_compact(F.array(*wrong)))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """file, place (from 0) and value (JSON text) of every element of files that hold one JSON array each; a file that holds none gives one row with a null place."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items = F.when(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.from_json("value", "array<string>"))
    return files.select("file", F.posexplode_outer(items).alias("place", "value"))


def game_logs(spark: SparkSession, folder: str, name: str = "game_log.json") -> tuple[DataFrame, DataFrame]:
    """The elements of every ``name`` one folder below ``folder``, and the folders that hold other files but no such log."""
    found = spark.read.format("binaryFile").load(f"{folder}/*/*").select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), (F.regexp_extract("path", r"([^/]+)$", 1) == name).alias("is_log"))
    missing = found.groupBy("folder").agg(F.bool_or("is_log").alias("has")).where("not has").select("folder")
    return json_array(spark, f"{folder}/*/{name}"), missing


def write_staged(df: DataFrame, path: str, **options: str) -> None:
    """JSON lines in a folder that must not exist; written beside it under a hidden name and renamed at the end, so that no reader ever sees a part. A failure leaves nothing."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, hidden = fs_path(path), fs_path(path).getParent().suffix(f"/.{fs_path(path).getName()}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        df.write.mode("errorifexists").options(**options).json(hidden.toString())
        if not fs.rename(hidden, target):
            raise OSError(f"cannot rename to {path}")
    finally:
        fs.delete(hidden, True)


def write_predictions(df: DataFrame, path: str) -> None:
    """One prediction for each event: a game's event_idx that stands in two rows is an error, as is a folder that exists."""
    again = [tuple(r) for r in df.groupBy("game_id", "event_idx").agg(F.count("*").alias("n")).where("n > 1").orderBy("game_id", "event_idx").limit(10).collect()]
    if again:
        raise ValueError(f"repeated events: {again}")
    write_staged(df, path)


def write_roles(df: DataFrame, path: str) -> None:
    """Who plays what (game_id, player, role, model), apart from the reports; no other column passes."""
    write_staged(df.select("game_id", "player", "role", "model"), path)


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines in a folder that must not exist yet; readers see it only when the job has committed."""
    df.write.mode("errorifexists").json(path)


def write_raw_by_split(df: DataFrame, path: str) -> None:
    """The unchanged input lines, by order and split, those of a file in the order of their lines."""
    df.repartition("tom_order", "split", "file").sortWithinPartitions("tom_order", "split", "file", "line_no").select("tom_order", "split", F.col("raw").alias("value")).write.mode("errorifexists").partitionBy("tom_order", "split").text(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit records; a column that is not allowed is an error."""
    if extra := set(df.columns) - AUDIT_COLUMNS:
        raise ValueError(f"columns not allowed: {sorted(extra)}")
    df.write.mode("append").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_violations(spark: SparkSession, path: str, schema_version: str, projection_version: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> list[str]:
    """What is wrong with a split manifest (a single JSON file that lists games, read as one row); empty if nothing is."""
    part = "struct<game_ids: array<string>, game_count: long>"
    shape = f"schema_version string, projection_version string, splits map<string, {part}>, total_game_count long, " + ", ".join(f"{s}_game_count long" for s in splits)
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("m")).select("m.*")
    ids = lambda s: F.coalesce(F.col("splits")[s]["game_ids"], F.array().cast("array<string>"))
    everything = F.flatten(F.array(*[ids(s) for s in splits]))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {"schema_version": no(F.col("schema_version") == schema_version), "projection_version": no(F.col("projection_version") == projection_version), "split_names": no(F.sort_array(F.map_keys("splits")) == F.sort_array(F.array(*map(F.lit, splits))))}
    for s in splits:
        rules[f"{s}:empty"] = F.size(ids(s)) == 0
        rules[f"{s}:invalid_id"] = F.exists(ids(s), lambda g: no(F.trim(g) != ""))
        rules[f"{s}:duplicates"] = F.size(F.array_distinct(ids(s))) != F.size(ids(s))
        rules[f"{s}:game_count"] = no(F.col("splits")[s]["game_count"] == F.size(ids(s)))
        rules[f"{s}:{s}_game_count"] = no(F.col(f"{s}_game_count") == F.size(ids(s)))
    each_once = sum((F.size(F.array_distinct(ids(s))) for s in splits), F.lit(0))
    rules["overlap"] = F.size(F.array_distinct(everything)) != each_once
    rules["total_game_count"] = no(F.col("total_game_count") == F.size(F.array_distinct(everything)))
    found = row.select(F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull()).alias("v")).first()
    return found["v"] if found else ["missing"]


def read_manifest(spark: SparkSession, path: str, schema_version: str, projection_version: str) -> DataFrame:
    """game_id and split of a manifest without violations; any violation is an error."""
    if wrong := manifest_violations(spark, path, schema_version, projection_version):
        raise ValueError(f"split manifest {path}: {', '.join(wrong)}")
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "splits map<string, struct<game_ids: array<string>>>")["splits"].alias("s"))
    return row.select(F.explode("s").alias("split", "part")).select(F.explode("part.game_ids").alias("game_id"), "split")
