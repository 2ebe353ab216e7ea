"""A triage reply in free text to its fields; unusable replies become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.text import one_json_value, strip

_FIELDS = "struct<" + ", ".join(
    f"{key}: {'array<string>' if key == 'investigation_steps' else 'string'}" for key in fv.REPLY_KEYS_FULL
) + ">"
_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def json_object(reply: Column) -> Column:
    """The widest ``{…}`` part of a text, null without one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parsed_reply(reply: Column, rule_backed: Column) -> Column:
    """Fields of a reply, or null when it is not one JSON object with the needed keys.

    Rule-backed alerts need fewer keys.  An unknown label counts as ``medium``; at most
    five steps are kept, at least one is required.
    """
    text = json_object(reply)
    keys = F.json_object_keys(F.when(one_json_value(text), text))
    has = lambda needed: F.size(F.array_except(F.array(*[F.lit(k) for k in needed]), keys)) == 0
    complete = F.when(rule_backed, has(fv.REPLY_KEYS_RULE)).otherwise(has(fv.REPLY_KEYS_FULL))
    fields = F.from_json(text, _FIELDS, _JSON)
    label = F.lower(strip(fields["fp_assessment"]))
    steps = fields["investigation_steps"]
    usable = (
        F.coalesce(complete, F.lit(False))
        & label.isNotNull()
        & (F.coalesce(F.size(steps), F.lit(0)) >= 1)
    )
    return F.when(
        usable,
        F.struct(
            fields["attack_technique"].alias("attack_technique"),
            fields["attack_tactic"].alias("attack_tactic"),
            fields["description"].alias("description"),
            F.when(label.isin(*fv.REPLY_CONFIDENCE), label).otherwise(F.lit("medium")).alias("fp_assessment"),
            fields["fp_reasoning"].alias("fp_reasoning"),
            F.slice(steps, 1, fv.REPLY_MAX_STEPS).alias("investigation_steps"),
        ),
    )
