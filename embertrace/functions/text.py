"""Column expressions on text: first usable value, base names, word tests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace import fixed_values as fv


def non_empty(value: Column) -> Column:
    """Null for an empty string, the value otherwise."""
    return F.nullif(value, F.lit(""))


def first_usable(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[non_empty(v) for v in values])


def strip(value: Column) -> Column:
    """Trim all Unicode white space on both ends."""
    return F.btrim(value, F.lit(fv.WHITESPACE))


def base_name(path: Column) -> Column:
    """Lower-case last component of a path with either slash; empty gives null."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    return non_empty(F.lower(F.substring_index(unified, "/", -1)))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` contains one of the words."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


def folded(text: Column) -> Column:
    """Text for matching ASCII words in any letter case, as a Unicode-aware regex would.

    Besides lower-casing, the long s and the dotted and dotless i become plain letters.
    """
    for special, plain in (("\u017f", "s"), ("\u0130", "i"), ("\u0131", "i")):
        text = F.replace(text, F.lit(special), F.lit(plain))
    return F.lower(text)


def choose(rules: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule that holds."""
    chain = None
    for test, value in rules:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return default if chain is None else chain.otherwise(default)


def lookup(key: Column, table: Mapping, default) -> Column:
    """Constant-table lookup with a default for unknown or null keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def event_category(channel: Column, event_id: Column) -> Column:
    """Category of a Windows event: channel word first, then the id inside that channel."""
    name = F.lower(F.coalesce(channel, F.lit("")))
    code = event_id.cast("string")
    monitor = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for item in fv.SYSMON_CATEGORY.items() for x in item]), event_id.try_cast("int")
        ),
        F.concat(F.lit("sysmon_"), code),
    )
    audit = choose(
        [(event_id.isin(*ids), F.lit(cat)) for cat, ids in fv.SECURITY_CATEGORY.items()],
        F.concat(F.lit("security_"), code),
    )
    return choose(
        [
            (F.contains(name, F.lit("sysmon")), monitor),
            (F.contains(name, F.lit("security")), audit),
            (F.contains(name, F.lit("powershell")), F.lit("script_execution")),
            (F.contains(name, F.lit("wmi")), F.lit("wmi_activity")),
        ],
        F.lit("other"),
    )


def joined_groups(groups: Column) -> Column:
    """Rule groups as one lower-case string."""
    return F.lower(F.array_join(F.coalesce(groups, F.array().cast("array<string>")), " "))


def group_category(groups: Column) -> Column:
    """Category of an alert from its rule groups."""
    text = joined_groups(groups)
    return choose(
        [(has_any(text, words), F.lit(cat)) for cat, words in fv.RULE_GROUP_CATEGORY],
        F.lit(fv.RULE_GROUP_DEFAULT),
    )


def group_tactic(groups: Column) -> Column:
    """Tactic of an alert from its rule groups."""
    text = joined_groups(groups)
    return choose(
        [(F.contains(text, F.lit(word)), F.lit(tactic)) for word, tactic in fv.RULE_GROUP_TACTIC],
        F.lit(fv.TACTIC_DEFAULT),
    )


def one_json_value(text: Column) -> Column:
    """True when a text is exactly one JSON value, with nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def string_or_list(value: Column) -> Column:
    """A JSON text holding one string or a list of strings, as ``array<string>``.

    The reader declares such a field as a string; a list arrives as its JSON text.
    """
    listed = F.from_json(value, "array<string>", {"allowSingleQuotes": "false"})
    return (
        F.when(non_empty(value).isNull(), F.array().cast("array<string>"))
        .when(F.startswith(F.ltrim(value), F.lit("[")) & listed.isNotNull(), listed)
        .otherwise(F.array(value))
    )
