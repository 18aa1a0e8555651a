"""Turning a whole table's rows around the seats: every player in any nested column.

The walk follows the schema. Strings that are canonical players move; arrays of
nothing but players are sorted anew; arrays of structs with a ``voter`` are
sorted by voter; keys of maps move; numbers move in the columns and fields that
are named as such. Text fields (``KEEP``) stay as they are, whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StringType, StructType

from veldra.functions.domain import N_PLAYERS, PLAYERS
from veldra.operators import events as E
from veldra.operators.snapshots import turned

#: Fields that never name a player by themselves.
KEEP = ("raw_text", "game_id", "phase", "event_type")
#: Fields that hold players as numbers; arrays of them keep their order.
NUMBERED = ("observer_ids", "speaker_id", "observer", "speaker", "observers")


def shift_of(seed: Column, epoch: Column, index: Column) -> Column:
    """The turn of a row in an epoch; null if one of the three is null or below 0."""
    return F.when((seed >= 0) & (epoch >= 0) & (index >= 0), F.pmod(seed + epoch + index, F.lit(N_PLAYERS)).cast("int"))


def _is_player(name: Column) -> Column:
    return F.coalesce(name.isin(*PLAYERS), F.lit(False))


def _name(name: Column, shift: Column) -> Column:
    moved = F.concat(F.lit("player"), turned(F.substring(name, 7, 1).cast("int"), shift).cast("string"))
    return F.when(_is_player(name), moved).otherwise(name)


def _walk(value: Column, kind: DataType, shift: Column, name: str) -> Column:
    if name in KEEP:
        return value
    if isinstance(kind, StringType):
        return _name(value, shift)
    if isinstance(kind, IntegralType):
        return turned(value, shift).cast(kind) if name in NUMBERED else value
    if isinstance(kind, ArrayType):
        moved = F.transform(value, lambda x: _walk(x, kind.elementType, shift, name))
        if isinstance(kind.elementType, StringType):
            return F.when(F.forall(value, _is_player), F.array_sort(moved)).otherwise(moved)
        if isinstance(kind.elementType, StructType) and "voter" in kind.elementType.names:
            by = lambda a, b: F.when(a["voter"] < b["voter"], -1).when(a["voter"] > b["voter"], 1).otherwise(0)
            return F.when(F.forall(value, lambda v: v["voter"].isNotNull()), F.array_sort(moved, by)).otherwise(moved)
        return moved
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_walk(e["key"], kind.keyType, shift, name if name in NUMBERED else "key").alias("key"), _walk(e["value"], kind.valueType, shift, name).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_walk(value[f.name], f.dataType, shift, f.name).alias(f.name) for f in kind.fields]))
    return value


def turned_rows(rows: DataFrame, shift: Column, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with every player in ``columns`` (all, if not given) ``shift`` seats on; maps come with sorted keys."""
    return rows.withColumns({f.name: _walk(F.col(f.name), f.dataType, shift, f.name) for f in rows.schema.fields if columns is None or f.name in columns})


def turned_samples(samples: DataFrame, shift: Column) -> DataFrame:
    """Formal rows of order 2 with all players ``shift`` seats on, their events (JSON text) and both digests made anew.

    Events become canonical JSON; a row whose events are incomplete has null
    events and digests. A row of another order is an error, raised where the
    row is read.
    """
    order = F.when(F.coalesce(F.col("tom_order") == 2, F.lit(False)), F.col("tom_order")).otherwise(F.raise_error(F.lit("only rows of order 2 are turned")).cast("int"))
    rows = samples.withColumn("tom_order", order).withColumn("__shift", shift).withColumn("__parsed", E.parsed(F.col("events")))
    fixed = {"events", "public_event_digest", "structured_input_digest", "__shift", "tom_order"}
    rows = turned_rows(rows, F.col("__shift"), [c for c in rows.columns if c not in fixed])
    parsed = F.col("__parsed")
    rows = rows.withColumns({"events": E.canonical_events(parsed), "structured_input_digest": E.structured_digest(parsed)})
    return rows.withColumn("public_event_digest", F.sha2("events", 256)).drop("__shift", "__parsed")
