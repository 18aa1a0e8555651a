"""Notes, reasons, predicted roles and the agents' own forms of answers in text.

A map from repeated keys holds each key once, in the place of its first
occurrence and with the value of its last. Texts that are null give null; a
form that a text does not have gives what its function says.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veldra.functions.domain import let
from veldra.functions.text import json_like, vote_target

#: The forms of notes, reasons and predictions (``.`` is any character where the form says so by (?s)).
SUMMARY = r"(?s)总结：\s*(.*?)(?=投票原因)"
SUMMARY_BEFORE_CONCLUSION = r"(?s)总结：\s*(.*?)\n综上"
SECTION = r"(?sd)\*\*(.*?)\*\*：(.*?)(?=\*\*|#|$)"
REASON = r"(?s)投票原因：\s*(.*?)。\n基于上述"
REASON_LEAD = "根据上述观察，可以做出如下分析："
PREDICTION = r"(?s)基于上述分析，可以预测玩家身份为：\s*(.*?)\s*。\n综上"
PREDICTED = r"(?d)(\d+)号玩家是(.*?)。"
SUBJECTIVE = r"(?s)主观身份判断：\s*(.*?)\n"
#: Parts of a prompt, with the words that stand before each in the short form.
PROMPT_PARTS = {
    "第1天总结：": r"(?s)第1天总结：\s*(.*?)第1天投票记录", "第2天总结：": r"(?s)第2天总结：\s*(.*?)第2天投票记录", "我的投票：": r"(?s)# 我的投票：\s*(.*?);", "昨晚发生：": r"(?s)昨晚发生：\s*(.*?);",
    "昨晚行动：": r"(?s)昨晚行动：\s*(.*?);", "前置位发言：\n": r"(?s)本轮在你之前的玩家发言：(.*?)请根据上述内容形成你本轮的发言。",
}
#: What the action of each role must name, and what it may.
NIGHT_ACTIONS = {"Witch": ("解药", "毒药"), "Werewolf": ("杀害",), "Seer": ("查验",), "Guard": ("守卫",)}
_BLANK = r"[\s\x1c-\x1f]"
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def stripped(text: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+\\z", "")


def _first(text: Column, form: str) -> Column:
    """The first group of the first match; null if there is none."""
    return F.when(text.rlike(f"(?U){form}"), F.regexp_extract(text, f"(?U){form}", 1))


def last_wins(keys: Column, values: Column) -> Column:
    """Map of repeated keys: places of the first, values of the last occurrence."""
    each = F.array_distinct(keys)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
    return F.map_from_arrays(each, F.transform(each, last))


def note(text: Column) -> Column:
    """``note`` (text) and ``sections`` (map; null where the note has no such form) of an answer.

    A summary before the reason of a vote is a note in sections; else the
    summary before the conclusion, else the whole answer, is the note as it is.
    """
    bare = F.replace(text, F.lit("#投票原因"), F.lit("投票原因"))

    def of(summary: Column) -> Column:
        found = lambda k: F.regexp_extract_all(summary, F.lit(f"(?U){SECTION}"), F.lit(k))
        sections = F.when(summary.isNotNull(), last_wins(found(1), F.transform(found(2), stripped)))
        lines = F.array_join(F.transform(F.map_entries(sections), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
        return F.struct(F.coalesce(lines, _first(bare, SUMMARY_BEFORE_CONCLUSION), bare).alias("note"), sections.alias("sections"))

    return F.when(text.isNotNull(), let(_first(bare, SUMMARY), of))


def vote_reason(text: Column) -> Column:
    """The reason of a vote; the whole answer if it gives none."""
    said = _first(F.replace(text, F.lit("# 综上，"), F.lit("综上，")), REASON)
    return F.replace(F.coalesce(stripped(said), text), F.lit(REASON_LEAD), F.lit(""))


def predicted_roles(text: Column) -> Column:
    """Map of player numbers to roles that an answer predicts (its last word on each)."""
    part = F.translate(F.coalesce(stripped(_first(text, PREDICTION)), text), _WIDE, _NARROW)
    found = lambda k: F.regexp_extract_all(part, F.lit(f"(?U){PREDICTED}"), F.lit(k))
    return last_wins(F.transform(found(1), lambda n: n.cast("int")), found(2))


def subjective_roles(text: Column) -> Column:
    """What a note says about roles, up to the end of its line; null if nothing."""
    return stripped(_first(F.concat(text, F.lit("\n")), SUBJECTIVE))


def prompt_digest(prompt: Column) -> Column:
    """The parts of a prompt that say what happened so far, a line for each."""
    return F.when(prompt.isNotNull(), F.concat(*[F.coalesce(F.concat(F.lit(lead), _first(prompt, form), F.lit("\n")), F.lit("")) for lead, form in PROMPT_PARTS.items()]))


def vote_response(text: Column) -> Column:
    """note, reason and vote (-1 abstains) of a free answer: the first number after the last conclusion, else the last number, unless it abstains."""
    plain = F.translate(text, _WIDE, _NARROW)
    numbers = lambda t: F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    concluded = F.get(numbers(F.substring_index(plain, "综上", -1)), F.lit(0))
    other = F.when(F.contains(text, F.lit("弃票")), F.lit(None)).otherwise(F.try_element_at(numbers(plain), F.lit(-1)))
    vote = F.coalesce(F.when(F.contains(text, F.lit("综上")), concluded).otherwise(other).cast("int"), F.lit(-1))
    return F.when(text.isNotNull(), F.struct(note(text)["note"].alias("note"), vote_reason(text).alias("reason"), vote.alias("vote")))


def noted_vote(text: Column) -> Column:
    """note, reason and vote of an answer that is a JSON object, or like one; empty texts for what it lacks."""
    as_json = json_like(text)
    of = lambda name: stripped(F.coalesce(F.get_json_object(as_json, f"$['{name}']"), F.lit("")))
    return F.when(text.isNotNull(), F.struct(of("笔记").alias("note"), of("投票原因").alias("reason"), vote_target(text).alias("vote")))


def night_action(role: Column, text: Column) -> Column:
    """fault, action (map of what it names) and reason of a night's answer.

    Faults: unsupported_role, not_an_object, ``missing:name`` (the first one).
    """
    kept = F.when(F.json_object_keys(text).isNotNull() & F.try_parse_json(text).isNotNull(), F.json_object_keys(text))
    fault, action = F.lit("unsupported_role"), F.lit(None).cast("map<string,string>")
    for name, fields in NIGHT_ACTIONS.items():
        wrong = F.when(kept.isNull(), "not_an_object")
        for f in fields:
            wrong = wrong.when(~F.array_contains(kept, f), f"missing:{f}")
        fault = F.when(role == name, wrong).otherwise(fault)
        said = F.create_map(*[x for f in fields for x in (F.lit(f), F.get_json_object(text, f"$['{f}']"))])
        action = F.when(role == name, said).otherwise(action)
    reason = F.coalesce(F.get_json_object(text, "$['原因']"), F.lit(""))
    return F.struct(fault.alias("fault"), F.when(fault.isNull(), action).alias("action"), F.when(fault.isNull(), reason).alias("reason"))


def speech_form(text: Column) -> Column:
    """speech (the whole answer if it gives none), shown_role, labels (map), call (whom to vote for) and template of an answer that is a JSON object; null for any other."""
    said = lambda name: F.coalesce(F.get_json_object(text, f"$['{name}']"), F.lit(""))
    labels = F.coalesce(F.from_json(F.get_json_object(text, "$['身份标签']"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    listed = F.array_join(F.transform(F.map_entries(labels), lambda e: F.concat(F.lit("把"), e["key"], F.lit("贴上身份标签："), e["value"], F.lit("。"))), "")
    template = F.concat(F.lit("展现自己身份为"), said("想要展示的身份"), F.lit("。"), listed, F.lit("。归票："), said("归票"), F.lit("。"))
    speech = F.when(said("发言") != "", said("发言")).otherwise(text)
    fits = F.json_object_keys(text).isNotNull() & F.try_parse_json(text).isNotNull()
    return F.when(fits, F.struct(speech.alias("speech"), said("想要展示的身份").alias("shown_role"), labels.alias("labels"), said("归票").alias("call"), template.alias("template")))


def fenced_json(text: Column) -> Column:
    """The content of the first block fenced as json, if it is JSON; else null."""
    return let(_first(text, r"```json\s*([\s\S]*?)\s*```"), lambda block: F.when(F.try_parse_json(block).isNotNull(), block))
