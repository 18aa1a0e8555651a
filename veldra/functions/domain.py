"""The closed domains of the data model: seven players, unordered pairs, actions, phases, statuses."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Players by number, and the 21 unordered pairs in lexicographic order.
N_PLAYERS = 7
PLAYERS = [f"player{i}" for i in range(1, N_PLAYERS + 1)]
PAIRS = list(combinations(range(1, N_PLAYERS + 1), 2))
#: Statuses of a report, in the order of the cascade that finds them.
STATUSES = ("reporter_error", "parse_error", "semantic_error", "ok")
#: Actions that a speech may hold, in the order of their numbers from 1, and the roles that an observer may know itself to have.
ACTIONS = ("point_as_werewolf", "point_as_villager", "point_as_seer", "point_as_witch", "point_as_guard", "support", "oppose", "check_as_good", "check_as_werewolf", "save", "poison", "guard", "vote_intent")
ROLES = ("werewolf", "villager", "seer", "witch", "guard", "unknown")
#: Forms of a phase.
PHASE = r"^(\d+)_(day|night)_(skill_wolf|speech_pk|speech|vote_pk|vote)$"


def pairs(spark: SparkSession) -> DataFrame:
    """pair_idx, a, b: 21 rows."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "pair_idx int, a int, b int")


def player(text: Column) -> Column:
    """player1 to player7 from 3, "3", "player3", "Player_3" or "player 3"; null for anything else."""
    text = text.cast("string")
    bare = F.regexp_replace(F.lower(text), r"(?U)[\s_-]+", "")
    number = F.regexp_extract(bare, "^(?:player)?([1-7])$", 1)
    # names and numbers as they should be need one look only
    return F.when(text.rlike(r"^player[1-7]\z"), text).when(text.rlike(r"^[1-7]\z"), F.concat(F.lit("player"), text)).otherwise(F.when(number != "", F.concat(F.lit("player"), number)))


def phase_parts(phase: Column) -> Column:
    """day, time and kind of a phase; null where the form, or daytime on day 0, is wrong."""
    day = F.regexp_extract(phase, PHASE, 1)
    time, kind = F.regexp_extract(phase, PHASE, 2), F.regexp_extract(phase, PHASE, 3)
    fits = (day != "") & ((kind == "skill_wolf") == (time == "night")) & ((time == "night") | (F.try_to_number(day, F.lit("999999999")) >= 1))
    return F.when(fits, F.struct(day.cast("long").alias("day"), time.alias("time"), kind.alias("kind")))


def canonical_json(json: Column) -> Column:
    """Sorted keys, no blanks, no escapes for what lies beyond ASCII; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def digest(json: Column) -> Column:
    return F.sha2(canonical_json(json), 256)


def seed_of(game_id: Column) -> Column:
    """The number after ``_seed_`` at the end of a game's id, else null."""
    digits = F.regexp_extract(game_id, r"_seed_(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def relative_index(i: Column, j: Column) -> Column:
    """Place of player j as seen from player i (0 to 5; 6 for oneself, 7 for nobody)."""
    return F.when(j.isNull() | (j == 0), F.lit(7)).otherwise(F.pmod(j - 1 - i, F.lit(N_PLAYERS)))


def rotated(values: Column, first: Column) -> Column:
    """The array turned so that element ``first`` (from 1) leads."""
    return F.concat(F.slice(values, first, F.size(values)), F.slice(values, F.lit(1), first - 1))


def decision(risk: Column, costs: tuple[float, ...] = (0.0, 0.4, 1.0, 1.0, 0.3, 0.0), temperature: float = 0.7) -> Column:
    """Three-way decision by least expected cost; costs of P, B, N for a positive, then for a negative case. The first of P, B, N wins ties."""
    r = F.least(F.greatest(risk, F.lit(1e-5)), F.lit(1 - 1e-5))
    of = [costs[i] * r + costs[i + 3] * (1 - r) for i in range(3)]
    low = F.least(*of)
    soft = [F.exp(-(x - low) / temperature) for x in of]
    name = F.when(of[0] == low, "P").when(of[1] == low, "B").otherwise("N")
    total = soft[0] + soft[1] + soft[2]
    return F.struct(name.alias("choice"), *[x.alias(f"risk_{n}") for x, n in zip(of, "PBN")], *[(s / total).alias(f"p_{n}") for s, n in zip(soft, "PBN")])


def learning_rate(step: Column, warm_up: int, total: int, top: float) -> Column:
    """Linear warm-up, then a cosine to zero."""
    after = (step - warm_up) / F.lit(float(max(1, total - warm_up)))
    return F.when(step < warm_up, top * step / float(max(1, warm_up))).otherwise(top * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(after, F.lit(1.0)))))


def action(text: Column) -> Column:
    """The action's name in lower case; null for anything else."""
    name = F.lower(F.trim(text))
    return F.when(name.isin(*ACTIONS), name)


def guessed_role(text: Column) -> Column:
    """The role's name in lower case, ``unknown`` for null; null for anything else."""
    name = F.lower(F.trim(F.coalesce(text, F.lit("unknown"))))
    return F.when(name.isin(*ROLES), name)


def player_set(names: Column) -> Column:
    """The sorted names of an array of distinct canonical players; null if it is none."""
    fine = F.forall(names, lambda x: F.coalesce(x.isin(*PLAYERS), F.lit(False))) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(fine, F.array_sort(names))


def number_of(name: Column, names: tuple[str, ...] | list[str], otherwise: int = 0) -> Column:
    """Place of a name in a fixed list, from 1; ``otherwise`` for anything else."""
    place = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(place > 0, place).otherwise(F.lit(otherwise)).cast("long")


def name_of(number: Column, names: tuple[str, ...] | list[str], otherwise: str = "unknown") -> Column:
    """The name at a place of a fixed list, from 1; ``otherwise`` outside."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), (number - 1).cast("int")), F.lit(otherwise))


def lineage(contracts: dict[str, tuple[str, ...]], *fields: Column) -> Column:
    """Name of the contract whose values all fields have; null if there is none."""
    out = F.lit(None).cast("string")
    for name, values in contracts.items():
        same = F.lit(True)
        for f, v in zip(fields, values, strict=True):
            same = same & F.coalesce(f == v, F.lit(False))
        out = F.when(same, name).otherwise(out)
    return out


def log_time(text: Column) -> Column:
    """day and is_night of a log's time such as ``第2天夜晚``; null for other forms."""
    day = F.regexp_extract(text, r"第(\d+)天(白天|夜晚)", 1)
    return F.when(day != "", F.struct(day.cast("long").alias("day"), (F.regexp_extract(text, r"第(\d+)天(白天|夜晚)", 2) == "夜晚").alias("is_night")))


def one_based(numbers: Column) -> Column:
    """Player numbers counted from 1 instead of 0, in an array."""
    return F.transform(numbers, lambda x: x + 1)


def token_usage(usage: Column) -> Column:
    """input_tokens, output_tokens and total_tokens of a JSON text, under their older names too; only integers count."""
    value = F.try_parse_json(usage)

    def of(*names: str) -> Column:
        found = [F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant")) == "BIGINT", F.try_variant_get(value, f"$.{n}", "bigint")) for n in names]
        return F.coalesce(*found)

    return F.struct(of("prompt_tokens", "input_tokens").alias("input_tokens"), of("completion_tokens", "output_tokens").alias("output_tokens"), of("total_tokens").alias("total_tokens"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]
