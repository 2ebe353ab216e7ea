"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with the references of its language: the shares of character
classes and of the most common words, summed over all documents of that language.  The
measure is the Jensen-Shannon distance (base 2, so 0 to 1).  Short documents are left to
the plain rules, since their histograms say little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.llm.staging import settled, split_words

#: Character classes in the order in which they are taken off a text.
CLASSES = ("lower", "white", "upper", "digit", "symbol", "stop", "letter", "rest")
_PATTERNS = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?'\"()-]+", r"\p{L}+")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    ``languages`` bounds how many languages have references; documents of further
    languages, and documents without one, pass when any reference fits them.
    """

    common_words: int = 12
    languages: int = 64
    min_words: int = 50
    min_chars: int = 200
    word_distance: float = 0.42
    class_distance: float = 0.28


def character_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``classes array<bigint>``, code points per class; each class is taken off what the ones before left."""
    df = df.withColumn("_left", F.coalesce(F.col(text), F.lit("")))
    counts = []
    for name, pattern in zip(CLASSES, _PATTERNS):
        df = df.withColumn("_shorter", F.regexp_replace("_left", pattern, ""))
        df = df.withColumn(f"_n_{name}", (F.length("_left") - F.length("_shorter")).cast("bigint"))
        df = df.drop("_left").withColumnRenamed("_shorter", "_left")
        counts.append(f"_n_{name}")
    df = df.withColumn("classes", F.array(*counts, F.length("_left").cast("bigint")))
    return df.drop("_left", *counts)


def _covered(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``_words``; the windows are sorted, so equal ones are neighbours."""
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    hashes = F.col("_hashes")
    df = df.withColumn(
        "_windows",
        F.when(
            F.size(hashes) >= 3,
            F.zip_with(
                F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.xxhash64(a, b)),
                F.slice(hashes, F.lit(3), F.size(hashes)),
                lambda ab, c: F.xxhash64(ab, c),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_windows", F.slice("_windows", F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0))))
    plain = F.size(F.array_distinct("_windows")) == F.size("_windows")
    df = df.withColumn(
        "_ordered",
        F.when(~plain, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    ordered = F.col("_ordered")
    df = df.withColumn(
        "_places",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        ordered,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
                                | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
                            ).alias("again"),
                        ),
                    ),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    places = F.col("_places")
    gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(places, k - 1), F.lit(3))))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop(
        "_hashes", "_windows", "_ordered", "_places"
    )


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words``, ``classes`` and the plain counts of the rules to every row."""
    df = character_classes(df, text)
    df = df.withColumn("_words", split_words(F.col(text)))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit("\t\x0b\f\r "))) > 0)
    df = df.withColumn("_lines", lines)
    df = (
        df.withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .drop("_lines")
    )
    df = df.withColumn("n_symbols", F.get("classes", F.lit(CLASSES.index("symbol"))))
    chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, c: s + c)
    df = df.withColumn("word_chars", chars - F.get("classes", F.lit(CLASSES.index("white"))))
    return _covered(df)


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> list:
    """Per language: its common words with their shares, and the shares of the character classes.

    Counted over all documents; at most ``rules.languages`` rows come to the driver.
    Languages are those with most documents, names breaking ties, and so are words.
    """
    known = docs.filter(F.col(lang).isNotNull())
    sums = (
        character_classes(known.select(F.col(lang).alias("lang"), F.col(text).alias("text")))
        .groupBy("lang")
        .agg(F.count("*").alias("docs"), *(F.sum(F.get("classes", F.lit(k))).alias(c) for k, c in enumerate(CLASSES)))
        .orderBy(F.desc("docs"), "lang")
        .limit(rules.languages)
        .collect()
    )
    if not sums:
        return []
    counted = (
        known.filter(F.col(lang).isin([r["lang"] for r in sums]))
        .select(F.col(lang).alias("lang"), F.explode(split_words(F.lower(F.col(text)))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rules.common_words)
    common: dict[str, list] = {}
    for row in top.orderBy("lang", "k").collect():
        common.setdefault(row["lang"], []).append((row["word"], row["n"]))
    totals = {
        r["lang"]: r["n"]
        for r in known.filter(F.col(lang).isin([r["lang"] for r in sums]))
        .select(F.col(lang).alias("lang"), F.size(split_words(F.col(text))).cast("bigint").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    found = []
    for row in sums:
        chars, total = sum(row[c] for c in CLASSES), totals[row["lang"]]
        if chars and total:
            words = common[row["lang"]]
            shares = [n / total for _, n in words]
            found.append((row["lang"], [w for w, _ in words], [*shares, max(0.0, 1 - sum(shares))], [row[c] / chars for c in CLASSES]))
    return found


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2))


def _literal(found: list) -> Column:
    kind = "array<struct<lang:string,words:array<string>,shares:array<double>,classes:array<double>>>"
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    rows = [
        F.struct(F.lit(name).alias("lang"), texts(words).alias("words"), texts(shares).alias("shares"), texts(classes).alias("classes"))
        for name, words, shares, classes in found
    ]
    return F.array(*rows).cast(kind)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows with the plain counts, ``base_failed``, the two distances and ``kept``.

    A null or empty text has no words and fails the plain rules.  Distances are null where
    the text has fewer than ``min_words`` words or ``min_chars`` characters, or no language
    has a reference; such a row is judged by the plain rules alone.  A row with no language,
    or one without references, takes the nearest reference.  Columns of the input that share
    a name with a result are replaced; repeated rows are judged alike.
    """
    found = references(docs, rules, text, lang)
    df = measures(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    if not found:
        empty = F.lit(None).cast("double")
        df = df.withColumns({"word_distance": empty, "class_distance": empty, "kept": ~F.col("base_failed")})
        return settled(df, "base_failed", "kept").drop("_words", "classes")
    vocabulary = sorted({w for _, words, _, _ in found for w in words})
    chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, c: s + c)
    judged = (F.col("n_words") >= rules.min_words) & (chars >= rules.min_chars)
    df = df.withColumn("_judged", judged)
    lowered = F.transform(F.filter("_words", lambda w: F.length(w) <= max(map(len, vocabulary)) * 2), lambda w: F.lower(w))
    df = df.withColumn("_common", F.when(F.col("_judged"), F.filter(lowered, lambda w: w.isin(vocabulary))))
    own = F.filter(_literal(found), lambda r: r["lang"] == F.col(lang))
    df = df.withColumn("_own", own)
    df = df.withColumn("_refs", F.when(F.size("_own") > 0, F.col("_own")).otherwise(_literal(found)))
    df = df.withColumn("_classes", F.transform("classes", lambda c: c / F.greatest(chars, F.lit(1))))
    df = df.withColumn(
        "_counts",
        F.transform(
            "_refs",
            lambda r: F.transform(r["words"], lambda v: F.size(F.filter(F.col("_common"), lambda c: c == v)).cast("double")),
        ),
    )
    df = df.withColumn(
        "_shares",
        F.transform(
            "_counts",
            lambda k: F.transform(
                F.concat(k, F.array(F.col("n_words") - F.aggregate(k, F.lit(0.0), lambda s, x: s + x))),
                lambda x: x / F.greatest(F.col("n_words"), F.lit(1)),
            ),
        ),
    )
    df = df.withColumn(
        "_distances",
        F.zip_with(
            "_shares",
            "_refs",
            lambda s, r: F.struct(
                distance(s, r["shares"]).alias("word"), distance(F.col("_classes"), r["classes"]).alias("class")
            ),
        ),
    )
    nearest = F.array_min("_distances")
    df = df.withColumn("_nearest", F.when(F.col("_judged"), nearest))
    df = df.withColumn("word_distance", F.col("_nearest.word")).withColumn("class_distance", F.col("_nearest.class"))
    far = (F.col("word_distance") > rules.word_distance) | (F.col("class_distance") > rules.class_distance)
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    df = settled(df, "base_failed", "word_distance", "class_distance", "kept")
    return df.drop("_words", "classes", "_judged", "_common", "_own", "_refs", "_classes", "_counts", "_shares", "_distances", "_nearest")
