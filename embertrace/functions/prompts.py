"""Prompt text per alert, as one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace.functions.text import first_usable

# Words that stand for something missing.
UNKNOWN = "unknown"
NO_COMMAND = "(not recorded)"
NO_PERCENTILE = "percentile unavailable"
SOME_PERCENTILE = "high percentile"
NO_FEATURES = "(not available — event was scored before feature attribution was added)"

_STEPS = '"investigation_steps": ["first action", "second action", "third action"]'
_LABEL = '"fp_assessment": "low | medium | high"'

_FULL_TASK = (
    "You triage Windows security events and know the ATT&CK matrix. The event below is "
    "statistically unusual for this specific environment: it ranks at the "
)
_FULL_REPLY = (
    "\n\nWeigh that rank and the listed features. Reply with one JSON object and nothing else, with exactly "
    "these keys:\n{\n"
    '  "attack_technique": "best single technique id, such as T1059.001",\n'
    '  "attack_tactic": "name of its tactic",\n'
    '  "description": "one plain sentence that mentions the percentile rank",\n'
    f"  {_LABEL} (low: surely real, high: surely harmless),\n"
    '  "fp_reasoning": "one sentence on why",\n'
    f"  {_STEPS}\n"
    "}\nJSON only:"
)
_RULE_REPLY = (
    "\n\nThe ATT&CK technique is already known from the rule. Judge only whether this event is real or a false "
    "positive here, and name the three next steps. Reply with one JSON object and nothing else:\n{\n"
    f"  {_LABEL},\n"
    '  "fp_reasoning": "one sentence on why, for this event",\n'
    f"  {_STEPS}\n"
    "}\nJSON only:"
)


def decimals(value: Column, places: int, plus: bool = False) -> Column:
    """A number with a fixed count of decimals, rounded by its exact binary value.

    69.85 is stored a little below that and so shows as 69.8; only true halves go to the
    even neighbour.  The doubled product is taken without error (its rounding error is
    recovered by splitting the factor), so halves are recognised exactly.
    """
    size = F.abs(value.cast("double"))
    factor = float(2 * 10**places)
    spread = size * 134217729.0
    high = spread - (spread - size)
    low = size - high
    product = size * factor
    error = (high * factor - product) + low * factor
    doubled = F.floor(product)
    up, down = F.floor((doubled + 1) / 2), F.floor(doubled / 2)
    at_half = (doubled % 2 == 1) & (product == doubled)
    whole = (
        F.when(~at_half | (error > 0), up)
        .when(error < 0, down)
        .otherwise(F.when(up % 2 == 0, up).otherwise(down))
    ).cast("bigint")
    scale = 10**places
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit("+" if plus else ""))
    return F.concat(
        sign,
        F.floor(whole / scale).cast("string"),
        F.lit("."),
        F.lpad((whole % scale).cast("string"), places, "0"),
    )


def feature_text(top_features: Column) -> Column:
    """Top features as ``name (z=+1.23, above baseline); …``; a text when there are none."""
    def one(f: Column) -> Column:
        z = F.coalesce(f["z_score"], F.lit(0.0))
        side = F.when(z > 0, F.lit("above")).otherwise(F.lit("below"))
        return F.concat(f["feature"], F.lit(" (z="), decimals(z, 2, plus=True), F.lit(", "), side, F.lit(" baseline)"))

    listed = F.array_join(F.transform(F.slice(top_features, 1, 3), one), "; ")
    return F.when(F.coalesce(F.size(top_features), F.lit(0)) > 0, listed).otherwise(F.lit(NO_FEATURES))


def percentile_text(percentile: Column, missing: str) -> Column:
    return F.when(percentile.isNotNull(), F.concat(decimals(percentile, 1), F.lit("th percentile"))).otherwise(
        F.lit(missing)
    )


def _or(value: Column, missing: str = UNKNOWN) -> Column:
    return first_usable(value, F.lit(missing))


def event_lines(alert) -> Column:
    """The facts of an alert, one ``name: value`` line each."""
    rank = percentile_text(alert("ml.anomaly_percentile"), NO_PERCENTILE)
    score = decimals(F.coalesce(alert("ml.anomaly_score"), F.lit(0.0)), 4)
    return F.concat(
        F.lit("anomaly_score: "), score, F.lit("  ("), rank, F.lit(")"),
        F.lit("\nevent.category: "), _or(alert("event.category")),
        F.lit("\nevent.channel: "), _or(alert("event.channel")),
        F.lit("\nprocess.name: "), _or(alert("process.name")),
        F.lit("\nprocess.parent.name: "), _or(alert("process.parent.name")),
        F.lit("\nprocess.command_line: "), _or(alert("process.command_line"), NO_COMMAND),
        F.lit("\nuser.name: "), _or(alert("user.name")),
        F.lit("\nhost.name: "), _or(alert("host.name")),
        F.lit("\nsource_dataset: "), _or(alert("source_dataset")),
        F.lit("\ntop_contributing_features: "), feature_text(alert("ml.top_features")),
    )


def full_prompt(alert=F.col) -> Column:
    """Prompt that asks for the technique and the assessment."""
    rank = percentile_text(alert("ml.anomaly_percentile"), NO_PERCENTILE)
    return F.concat(F.lit(_FULL_TASK), rank, F.lit(".\n\nEvent:\n"), event_lines(alert), F.lit(_FULL_REPLY))


def rule_prompt(alert=F.col) -> Column:
    """Shorter prompt for an alert that a rule already explains."""
    rank = percentile_text(alert("ml.anomaly_percentile"), SOME_PERCENTILE)
    score = decimals(F.coalesce(alert("ml.anomaly_score"), F.lit(0.0)), 4)
    return F.concat(
        F.lit("You triage security alerts. Rule "), alert("wazuh.rule.id"), F.lit(' fired:\n"'),
        F.coalesce(alert("wazuh.rule.description"), F.lit("")), F.lit('"\n\nEvent:'),
        F.lit("\n  process: "), _or(alert("process.name")),
        F.lit("\n  host: "), _or(alert("host.name")),
        F.lit("\n  user: "), _or(alert("user.name")),
        F.lit("\n  ml.anomaly_score: "), score, F.lit(" ("), rank,
        F.lit("), statistically unusual for this specific environment"),
        F.lit(_RULE_REPLY),
    )
