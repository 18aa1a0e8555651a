"""Several outputs that appear together or not at all, and the jobs that use them.

All outputs are first written beside their places under hidden names. Then each
is renamed; if one cannot be, those that were renamed are taken back. A reader
may see some of them while the renaming lasts, never a part of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldra.operators import events as E, materialize as M, relations, splits
from veldra.sources import jsonl


class Outputs:
    """Folders to be published together; use as a context: leaving it without an error publishes, with one it leaves nothing."""

    def __init__(self, spark: SparkSession, *paths: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        if len({self._path(p).toString() for p in paths}) < len(paths):
            raise ValueError("outputs must differ")
        if existing := [p for p in paths if self._fs(p).exists(self._path(p))]:
            raise FileExistsError(", ".join(existing))
        self.moves: list[tuple[str, str]] = []
        self._hidden: list[str] = []
        self.paths = paths

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def staging(self, beside: str) -> str:
        """A hidden folder beside a path, removed at the end."""
        at = self._path(beside)
        hidden = self._path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}.tmp").toString()
        self._hidden.append(hidden)
        return hidden

    def move(self, staged: str, path: str) -> None:
        """Publish the folder ``staged`` as ``path`` at the end; an empty folder if it does not exist."""
        self.moves.append((staged, path))

    def __enter__(self) -> Outputs:
        return self

    def __exit__(self, kind, *_) -> None:
        done: list[str] = []
        try:
            if kind is None:
                for staged, path in self.moves:
                    fs, to = self._fs(path), self._path(path)
                    if fs.exists(to):
                        raise FileExistsError(path)
                    fs.mkdirs(to.getParent())
                    made = fs.rename(self._path(staged), to) if fs.exists(self._path(staged)) else fs.mkdirs(to)
                    if not made:
                        raise OSError(f"cannot rename to {path}")
                    done.append(path)
        except BaseException:
            for path in done:
                self._fs(path).delete(self._path(path), True)
            raise
        finally:
            for hidden in self._hidden:
                self._fs(hidden).delete(self._path(hidden), True)


def write_all(outputs: dict[str, DataFrame], write: Callable[[DataFrame, str], None] = lambda df, path: df.write.json(path)) -> None:
    """Each table to its folder, all or none."""
    spark = next(iter(outputs.values())).sparkSession
    with Outputs(spark, *outputs) as out:
        for path, df in outputs.items():
            staged = out.staging(path)
            write(df, staged)
            out.move(staged, path)


def materialize(spark: SparkSession, raw: str, folders: dict[str, str]) -> dict:
    """Rows of both orders from raw JSON lines, each line read once; returns the counters.

    ``folders`` names a folder for each of ``materialize.PARTS``. Samples that
    break a rule, or samples of two lineages, are an error and leave nothing.
    """
    if set(folders) != set(M.PARTS):
        raise ValueError(f"folders for {', '.join(M.PARTS)} are due")
    samples, seen = M.counted(M.from_lines(spark.read.text(raw)))
    with Outputs(spark, *folders.values()) as out:
        hidden = out.staging(folders[M.PARTS[0]])
        M.lines(M.parts(samples)).write.partitionBy("part").text(hidden)
        counters = dict(seen.get)
        if counters["bad_samples"]:
            raise ValueError(f"{counters['bad_samples']} samples break a rule: {counters['first_bad']}")
        if counters["first_scope"] != counters["last_scope"]:
            raise ValueError("samples of two lineages")
        for part, path in folders.items():
            out.move(f"{hidden}/part={part}", path)
    return {k: v for k, v in counters.items() if k not in ("bad_samples", "first_bad", "last_scope")}


def _in_order(df: DataFrame, path: str) -> None:
    """The raw lines of each split, byte for byte, one file for each input file and split, in the order of its lines."""
    df.repartition("split", "file").sortWithinPartitions("split", "file", "line_no").select("split", F.col("raw").alias("value")).write.partitionBy("split").text(path)


def split_by_manifest(tables: dict[str, DataFrame], manifest: DataFrame, out_folder: str, names: tuple[str, ...]) -> dict[tuple[str, str], dict]:
    """Lines of each table (``jsonl.numbered`` rows with a game_id) to ``out_folder/table/split``, all or none; returns for each table and split the assigned and represented games and the lines.

    A game that the manifest (game_id, split) does not have, or that it has
    twice, is an error.
    """
    spark = manifest.sparkSession
    relations.require_unique(manifest, ["game_id"], "games assigned twice")
    assigned = {r["split"]: r["n"] for r in manifest.groupBy("split").agg(F.count("*").alias("n")).collect()}
    paths = {(t, s): f"{out_folder}/{t}/{s}" for t in tables for s in names}
    stats = {}
    with Outputs(spark, *paths.values()) as out:
        for t, rows in tables.items():
            splits.require_empty(splits.unknown(rows, manifest, "game_id"), f"{t}: games absent from the manifest")
            hidden = out.staging(f"{out_folder}/{t}")
            _in_order(relations.assigned(rows, manifest).withColumnRenamed("value", "raw") if "raw" not in rows.columns else relations.assigned(rows, manifest), hidden)
            found = {r["split"]: r for r in relations.assigned(rows, manifest).groupBy("split").agg(F.count("*").alias("lines"), F.countDistinct("game_id").alias("games")).collect()}
            for s in names:
                stats[t, s] = {"assigned": assigned.get(s, 0), "represented": found[s]["games"] if s in found else 0, "lines": found[s]["lines"] if s in found else 0}
                out.move(f"{hidden}/split={s}", paths[t, s])
    return stats


def split_formal(spark: SparkSession, order1: str, order2: str, manifest: DataFrame, out_folder: str, names: tuple[str, ...] = ("train", "validation", "test")) -> dict[tuple[str, str], dict]:
    """Formal JSON lines of both orders by an existing assignment of games; a row that breaks the contract of its order is an error."""
    tables = {}
    for order, path in ((1, order1), (2, order2)):
        lines = jsonl.numbered(spark, path)
        rows = E.formal_violations(M.formal_from_lines(lines), order)
        bad = rows.where(F.size("violations") > 0).orderBy("game_id", "step_idx").select("game_id", "step_idx", "violations").head(1)
        if bad:
            raise ValueError(f"order {order}: game {bad[0][0]}, step {bad[0][1]}: {', '.join(bad[0][2])}")
        tables[f"tom{order}"] = lines.withColumn("game_id", F.get_json_object("value", "$.game_id"))
    return split_by_manifest(tables, manifest, out_folder, names)


def split_by_seed(spark: SparkSession, order1: str, order2: str, counts: dict[str, int], seed: int, out_folder: str) -> dict[tuple[str, str], dict]:
    """JSON lines of both orders, whose games must be the same, by a seeded shuffle of the games."""
    tables = {f"tom{k}": jsonl.numbered(spark, path).withColumn("game_id", F.get_json_object("value", "$.game_id")) for k, path in ((1, order1), (2, order2))}
    for t, rows in tables.items():
        if rows.where("game_id is null or trim(game_id) = ''").head(1):
            raise ValueError(f"{t}: a line without a game")
    splits.require_empty(splits.misaligned(*[t.select("game_id").distinct() for t in tables.values()], ["game_id"]), "games that only one order has")
    return split_by_manifest(tables, splits.shuffled_split(tables["tom1"], counts, seed), out_folder, tuple(counts))
