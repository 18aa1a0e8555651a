"""Structured actions and claims in free text."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from veldra.functions.domain import ACTIONS, action, let, player, player_set

#: Markers that say "no actions".
EMPTY_MARKERS = ("none", "no action", "no actions", "null", "[]", "无", "无动作", "没有动作")
#: Roles that a speaker may claim, with the actions that this counts as.
ROLE_CLAIMS = {"狼人": "point_as_werewolf", "村民": "point_as_villager", "平民": "point_as_villager", "预言家": "point_as_seer", "女巫": "point_as_witch", "守卫": "point_as_guard"}
#: Findings of a check, with the weaker action that each makes redundant.
WEAKER = {"check_as_good": "point_as_villager", "check_as_werewolf": "point_as_werewolf"}
#: Forms of a line with an action, of bullets, of fences, and of a claim in the first person.
_LINE = r"(?iU)^\s*[\"'`]?\s*((?:player\s*)?[1-7])\s*[|｜]\s*([a-z_]+)\s*[|｜]\s*((?:player\s*)?[1-7])\s*[\"'`]?\s*[,;，；。.！!]?\s*$"
_BULLET = r"(?U)^\s*(?:[-*•]+\s*|\d+\s*[.)、:：-]\s*)"
_FENCE = r"```(?:[a-zA-Z0-9_-]+)?\s*"
_CLAIM = r"(?U)(?:^|[。！？；;\n])\s*(?:我是\s*(?:[1-7]\s*号(?:\s*玩家)?)?\s*[，,\s]*(?:身份(?:是|为|：|:)\s*)?|我的身份(?:是|为|：|:)\s*|我身份(?:是|为|：|:)\s*)(?:一名|一个|普通的?)?\s*(狼人|村民|平民|预言家|女巫|守卫)"
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TRIPLETS = "array<struct<subject:string,action:string,object:string>>"


def _none() -> Column:
    return F.array().cast(TRIPLETS)


def unfenced(text: Column) -> Column:
    """Without the marks of code fences."""
    return F.replace(F.regexp_replace(text, _FENCE, ""), F.lit("```"), F.lit(""))


def marker_text(text: Column) -> Column:
    """Lower case, with dots, marks, quotes and white space as single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[\s.!！。`'\"]+", " "))


def is_empty_marker(text: Column) -> Column:
    return marker_text(text).isin(*EMPTY_MARKERS)


def lines_of(text: Column) -> Column:
    """Lines with something in them, trimmed."""
    bare = F.transform(F.split(text, _BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(bare, lambda x: x != "")


def _parts(line: Column) -> Column:
    return F.struct(*[F.regexp_extract(line, _LINE, i).alias(n) for i, n in enumerate(("subject", "action", "object"), 1)])


def triplets(text: Column, strict: bool = False) -> Column:
    """Raw (subject, action, object) of the lines ``subject | action | object``; fences and bullets count only where parsing is strict."""
    lines = lines_of(text) if strict else F.transform(lines_of(unfenced(text)), lambda x: F.regexp_replace(x, _BULLET, ""))
    return F.transform(F.filter(lines, lambda x: x.rlike(_LINE)), _parts).cast(TRIPLETS)


def rejected_lines(text: Column) -> Column:
    """Lines that break the protocol of a strict answer (one action a line, or a lone marker); none where no line follows it at all."""
    lines = lines_of(text)
    follows = F.exists(lines, lambda x: x.rlike("[|｜]") | is_empty_marker(x))
    return F.when(follows, F.filter(lines, lambda x: ~x.rlike(_LINE))).otherwise(F.array().cast("array<string>"))


def normalised(raw: Column, speaker: Column) -> Column:
    """Distinct valid actions of raw ones, with the true speaker (a number) as their subject."""
    who = player(speaker)
    acts = F.transform(raw, lambda t: F.struct(who.alias("subject"), action(t["action"]).alias("action"), player(t["object"]).alias("object")))
    return F.array_distinct(F.filter(acts, lambda t: t["subject"].isNotNull() & t["action"].isNotNull() & t["object"].isNotNull())).cast(TRIPLETS)


def rejected(raw: Column) -> Column:
    """Raw actions whose subject, action or object is not valid."""
    return F.filter(raw, lambda t: t.isNull() | player(t["subject"]).isNull() | action(t["action"]).isNull() | player(t["object"]).isNull())


def without_superseded(acts: Column) -> Column:
    """Actions without the weaker ones that a check of the same player by the same one makes redundant."""
    weaker = F.create_map(*[F.lit(x) for pair in WEAKER.items() for x in pair])
    redundant = F.transform(F.filter(acts, lambda x: x["action"].isin(*WEAKER)), lambda x: F.struct(x["subject"].alias("subject"), weaker[x["action"]].alias("action"), x["object"].alias("object")))
    return F.filter(acts, lambda x: ~F.coalesce(F.array_contains(redundant.cast(TRIPLETS), x), F.lit(False)))


def role_claims(speech: Column, speaker: Column) -> Column:
    """Roles that the speaker (a number) claims in so many words, as distinct actions about itself."""
    role = F.create_map(*[F.lit(x) for pair in ROLE_CLAIMS.items() for x in pair])
    who = player(speaker)
    found = F.transform(F.regexp_extract_all(speech, F.lit(_CLAIM), F.lit(1)), lambda x: F.struct(who.alias("subject"), role[x].alias("action"), who.alias("object")))
    return F.coalesce(F.when(who.isNotNull(), F.array_distinct(found).cast(TRIPLETS)), _none())


def merged(*groups: Column) -> Column:
    """All actions of the groups, each once, where it comes first."""
    return F.array_distinct(F.concat(*groups))


def _of_json(array: Column) -> Column:
    """Raw actions of a JSON array of triples or of objects with action and object; null elements for anything else."""

    def of(item: Column) -> Column:
        three = F.from_json(item, "array<string>")
        keys = F.json_object_keys(item)
        named = F.array_contains(keys, "action") & F.array_contains(keys, "object")
        field = lambda n: F.get_json_object(item, f"$.{n}").alias(n)
        return F.when(keys.isNotNull(), F.when(named, F.struct(field("subject"), field("action"), field("object")))).when(F.size(three) == 3, F.struct(three[0].alias("subject"), three[1].alias("action"), three[2].alias("object")))

    return F.transform(F.from_json(array, "array<string>"), of).cast(TRIPLETS)


def response_actions(response: Column, speaker: Column, strict: bool = False) -> Column:
    """status (empty, parsed or failed), actions and failures of a parser's response.

    A marker alone says that there are none; else lines with actions come
    first, then the first JSON array; if not ``strict``, a marker on any line
    counts at last, and what is not valid is left out. If ``strict``, anything
    that is not valid is a failure, a JSON array must be the whole response,
    and failures leave no actions. A null or blank response has failed.
    """
    array = first_json_array(response)
    found = F.struct(lines_of(response).alias("lines"), triplets(response, strict).alias("raw"), array.alias("array"), _of_json(array).alias("from_json"), (rejected_lines(response) if strict else F.array().cast("array<string>")).alias("bad_lines"))
    return let(found, lambda f: let(_judged(f, response, strict), lambda j: F.struct(
        j["status"].alias("status"), F.when(j["status"] == "parsed", normalised(F.filter(j["chosen"], lambda t: t.isNotNull()), speaker)).otherwise(_none()).alias("actions"),
        F.when(j["status"] == "failed", j["bad"]).otherwise(F.array().cast("array<string>")).alias("failures"))))


def _judged(found: Column, response: Column, strict: bool) -> Column:
    """status, chosen raw actions and what is bad about them."""
    lines, raw, array = found["lines"], found["raw"], found["array"]
    chosen = F.when(F.size(raw) > 0, raw).when(array.isNotNull(), found["from_json"])
    bad = found["bad_lines"]
    if strict:
        empty = (F.size(lines) == 1) & ~F.contains(lines[0], F.lit("`")) & is_empty_marker(lines[0])
        text = lambda t: F.coalesce(F.concat_ws(" | ", t["subject"], t["action"], t["object"]), F.lit("not an action"))
        invalid = F.transform(rejected(F.coalesce(chosen, _none())), text)
        beside = (F.size(raw) == 0) & array.isNotNull() & ~F.coalesce(F.try_parse_json(response).isNotNull(), F.lit(False))
        bad = F.when(beside, F.array(F.lit("text beside a JSON array"))).otherwise(F.concat(bad, invalid))
        late = F.lit(False)
    else:
        empty = is_empty_marker(response)
        late = F.exists(lines_of(unfenced(response)), is_empty_marker)
    failed = response.isNull() | (F.size(lines) == 0)
    status = F.when(failed, "failed").when(empty, "empty").when(F.size(bad) > 0, "failed").when(chosen.isNotNull(), "parsed").when(late, "empty").otherwise("failed")
    return F.struct(status.alias("status"), chosen.alias("chosen"), F.coalesce(bad, F.array().cast("array<string>")).alias("bad"))


def spoken(speech: Column, response: Column, speaker: Column) -> Column:
    """Actions of a speech: the speaker's own claims and those of the parser's response; the claims alone if that has failed."""
    claims = role_claims(speech, speaker)
    both = F.struct(claims.alias("claims"), response_actions(response, speaker).alias("parsed"))
    return let(both, lambda x: F.when(x["parsed"]["status"] == "failed", x["claims"]).otherwise(let(merged(x["claims"], x["parsed"]["actions"]), without_superseded)))


#: Numerals, and the forms in which players are named: single, grouped, and the speaker as such.
NUMERALS = "零一二三四五六七八九"
_SINGLE = r"(?iU)player\s*(\d+)(?!\d)|玩家\s*(\d+|[零一二三四五六七八九])(?!\d)|(?<!第)(\d+|[零一二三四五六七八九])\s*号(?:玩家|位)?"
_GROUP = r"(?U)((?:\d+|[零一二三四五六七八九])(?:\s*[、，,]\s*(?:\d+|[零一二三四五六七八九]))+)\s*号(?:玩家|位)?"
_SELF = "我(?:自己)?|(?<!他)(?<!她)(?<!它)(?<!你)(?<!您)(?<!他们)(?<!她们)(?<!它们)(?<!你们)(?<!您们)自己"


def references(text: Column, speaker: Column | None = None) -> Column:
    """Sorted distinct numbers of the players that a speech names, alone, in groups or as the speaker itself; numbers beyond 1 to 7 are in it, too."""
    value = lambda x: F.coalesce(F.try_to_number(x, F.lit("9999999999")).cast("long"), F.instr(F.lit(NUMERALS), x) - 1).cast("int")
    single = F.concat(*[F.filter(F.regexp_extract_all(text, F.lit(_SINGLE), F.lit(i)), lambda x: x != "") for i in (1, 2, 3)])
    grouped = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_GROUP), F.lit(1)), lambda g: F.regexp_extract_all(g, F.lit(r"\d+|[零一二三四五六七八九]"), F.lit(0))))
    found = F.transform(F.concat(single, grouped), value)
    if speaker is not None:
        found = F.concat(found, F.when(speaker.between(1, 7) & text.rlike(_SELF), F.array(speaker.cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(found))


#: Text that belongs to prompts, never to a speech.
CONTROL_TEXT = ("【权威公共状态】", "【你合法知道的私有信息】", "【其他玩家此前的公开主张】", "【公开发言要求】", "system prompt", "系统提示词", "current_act_idx", "valid_action", "game_log")


def speech_fault(text: Column, finish_reason: Column, speaker: Column, planned: Column | None = None) -> Column:
    """The first thing that is wrong with a final speech: empty, truncated, bad_reference, structured, control_text, unplanned, missing; null if nothing is."""
    return let(references(text, speaker), lambda named: _speech_fault(text, finish_reason, speaker, planned, named))


def _speech_fault(text: Column, finish_reason: Column, speaker: Column, planned: Column | None, named: Column) -> Column:
    fault = F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "empty").when(F.coalesce(finish_reason == "length", F.lit(False)), "truncated")
    fault = fault.when(F.exists(named, lambda x: ~x.between(1, 7)), "bad_reference").when(text.rlike(r"(?U)^\s*(?:\{|\[|```|# )"), "structured")
    for marker in CONTROL_TEXT:
        fault = fault.when(F.contains(text, F.lit(marker)), "control_text")
    if planned is not None:
        due = planned.cast("array<int>")
        fault = fault.when(F.size(F.array_except(named, F.array_append(due, speaker.cast("int")))) > 0, "unplanned").when(F.size(F.array_except(due, named)) > 0, "missing")
    return fault


#: Roles whose players make speeches.
SPEAKER_ROLES = ("Werewolf", "Seer", "Witch", "Guard", "Villager")


def plan_fault(plan: Column, suggestible: Column, speaker: Column, role: Column) -> Column:
    """The first thing that is wrong with a plan (array of action and target, a number): role (of no speaker), no_plan, action, target, not_suggestible, opposes_itself, discloses_itself."""
    known = F.transform(plan, lambda p: p["action"])
    some = lambda test: F.exists(plan, lambda p: F.coalesce(test(p), F.lit(True)))
    own = lambda *names: F.exists(plan, lambda p: p["action"].isin(*names) & (p["target"] == speaker))
    return (
        F.when(~F.coalesce(role.isin(*SPEAKER_ROLES), F.lit(False)), "role").when(plan.isNull(), "no_plan").when(F.exists(known, lambda a: ~F.coalesce(a.isin(*ACTIONS), F.lit(False))), "action").when(some(lambda p: ~p["target"].between(1, 7)), "target")
        .when(F.exists(plan, lambda p: (p["action"] == "vote_intent") & ~F.array_contains(suggestible, p["target"])), "not_suggestible").when(own("oppose"), "opposes_itself")
        .when((role == "Werewolf") & own("point_as_werewolf", "check_as_werewolf"), "discloses_itself")
    )


def vote_target(response: Column) -> Column:
    """Number of the player that a response votes for: 0 abstains, null for no vote."""
    as_json = json_like(response)
    named = F.coalesce(F.get_json_object(as_json, "$['投票玩家']"), F.get_json_object(as_json, "$['投票']"))
    free = F.regexp_extract(response, r"(?U)(?:投票玩家|投票)\s*[:：]\s*([^\n,，。；;}]*)", 1)
    said = F.coalesce(named, F.when(response.rlike(r"(?U)(?:投票玩家|投票)\s*[:：]"), free))
    bare = F.regexp_replace(F.trim(said), "^[\"']+|[\"']+$", "")
    digits = F.regexp_extract(bare, r"\d+", 0)
    negative = F.coalesce(named.rlike(r"^-\d+$"), F.lit(False))
    return F.when(negative, F.lit(None)).when(F.lower(bare).isin("否", "弃票", "不投", "不投票", "abstain", "0"), 0).when(digits != "", digits.cast("int"))


def chosen_action(response: Column, candidates: Column) -> Column:
    """The candidate whose place (from 0) a response of exactly ``{"action_index": n}`` gives; null for any other response or place."""
    as_json = json_like(response)
    index = F.try_variant_get(F.try_parse_json(as_json), "$.action_index", "variant")
    whole = (F.json_object_keys(as_json) == F.array(F.lit("action_index"))) & (F.schema_of_variant(index) == "BIGINT")
    return F.when(whole, F.get(candidates, F.get_json_object(as_json, "$.action_index").cast("int")))


def report(response: Column, reporter_failed: Column, known: Column, cleared: Column, key: str = "suspected_werewolves") -> Column:
    """Status and suspicion of a response that must be a JSON object with one key and canonical names: the first failure of the cascade wins."""
    names = F.from_json(response, f"`{key}` array<string>")[key]
    suspected = player_set(names)
    shape = F.coalesce((F.json_object_keys(response) == F.array(F.lit(key))) & suspected.isNotNull() & F.try_parse_json(response).isNotNull(), F.lit(False))
    sound = (F.size(F.array_except(known, suspected)) == 0) & ~F.arrays_overlap(suspected, cleared)
    status = F.when(reporter_failed, "reporter_error").when(~shape, "parse_error").when(~sound, "semantic_error").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", suspected).alias("suspected"))


def _load(text: str, kind: type | None = None):
    """(value,) of a JSON text, of ``kind`` if given; None if it is not."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return (value,) if kind is None or isinstance(value, kind) else None


def _canonical(value: object) -> str | None:
    """Canonical JSON; None for what has none: numbers that are not finite, lone surrogates, keys of different kinds, values beyond JSON."""
    try:
        out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        out.encode()
    except (ValueError, TypeError, RecursionError):
        return None
    return out


#: A fenced block, with or without its language.
_FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)\s*```", re.IGNORECASE)


@F.pandas_udf(StringType())
def first_json_array(texts: pd.Series) -> pd.Series:
    """The first JSON array as canonical JSON: the whole text, else a fenced block, else from the first ``[`` that begins one; null if none does."""
    scan = json.JSONDecoder().raw_decode

    def of(text: str | None) -> str | None:
        if text is None:
            return None
        text = text.strip()
        for part in (text, *_FENCED.findall(text)):
            if found := _load(part, list):
                return _canonical(found[0])
        at = text.find("[")
        while at >= 0:
            try:
                return _canonical(scan(text, at)[0])
            except (ValueError, RecursionError):
                at = text.find("[", at + 1)
        return None

    return texts.map(of, na_action="ignore").astype(object)


@F.pandas_udf(StringType())
def json_like(texts: pd.Series) -> pd.Series:
    """JSON in a fence or bare, else a literal of Python, as canonical JSON; null for anything else."""

    def of(text: str | None) -> str | None:
        text = text.strip().strip("- ").strip()
        block = _FENCED.search(text)
        text = (block.group(1) if block else text).strip()
        if found := _load(text):
            return _canonical(found[0])
        try:
            return _canonical(ast.literal_eval(text))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(of, na_action="ignore").astype(object)


def reparsed(response: Column, old: Column, speaker: Column) -> Column:
    """Outcome of parsing a stored response anew, strictly, against its ``old`` actions.

    ``status``: missing (null), empty, failed or parsed. A failed or missing
    response keeps the old actions; ``added`` and ``removed`` are what changed,
    sorted. Null old actions count as none.
    """
    before = F.coalesce(old.cast(TRIPLETS), _none())
    both = F.struct(before.alias("before"), response_actions(response, speaker, strict=True).alias("new"))

    def of(x: Column) -> Column:
        status = F.when(response.isNull(), "missing").otherwise(x["new"]["status"])
        now = F.when(status.isin("empty", "parsed"), without_superseded(x["new"]["actions"])).otherwise(x["before"])
        return let(now, lambda n: F.struct(status.alias("status"), n.alias("actions"), F.array_sort(F.array_except(n, x["before"])).alias("added"), F.array_sort(F.array_except(x["before"], n)).alias("removed")))

    return let(both, of)
