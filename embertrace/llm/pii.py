"""Personal data, and terms that give protected entities away.

Mail addresses, network addresses, cards and telephone numbers are the protected entities.
Terms near them are held against the whole corpus: with N distinct texts, n_e of them naming
entity e, n_t holding term t and n_et holding t near e, the share of the information about e
that t discloses is log(N n_et / (n_e n_t)) / log(N / n_e).  A term that discloses
``generalise_at`` of it is replaced by its class, one that discloses ``remove_at`` is removed,
wherever it stands: also far from the entity and in texts that do not name it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.staging import staged
from embertrace.session import ship_package

KINDS = ("email", "ip", "card", "phone")
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,entity:string>>"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Disclosure:
    """``reach`` terms on each side count as near; a pair needs ``support`` distinct texts to say anything.
    One pass over the texts looks for about ``terms`` terms, which bounds what is broadcast."""

    reach: int = 6
    support: int = 3
    min_letters: int = 4
    generalise_at: float = 0.7
    remove_at: float = 0.9
    terms: int = 500_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str):
    """Mail addresses, looked up from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and normalised value of every entity, by start and then kind."""
    found = []
    if "@" in text:
        found += [("email", a, b, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end(), m[0]))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end(), digits))
        for m in _PHONE.finditer(text) if "+" in text else ():
            digits = "".join(_DIGIT.findall(m[0]))
            if 9 <= len(digits) <= 15:
                found.append(("phone", m.start(), m.end(), digits))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def neighbours(text: str, spans: list[tuple[str, int, int, str]], rule: Disclosure) -> list[dict]:
    """The terms near each entity that are no part of any entity."""
    if not spans:
        return []
    inside = sorted((a, b) for _, a, b, _ in spans)
    terms, k, busy = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(inside) and inside[k][0] < m.end():
            busy = max(busy, inside[k][1])
            k += 1
        if busy <= m.start():
            terms.append((m.start(), m.end(), m[0].lower()))
    starts = [t[0] for t in terms]
    out = []
    for _, a, b, entity in spans:
        left, right = bisect_left(starts, a), bisect_left(starts, b)
        for s, e, term in terms[max(0, left - rule.reach) : left] + terms[right : right + rule.reach]:
            if len(term) >= rule.min_letters:
                out.append({"entity": entity, "term": term, "start": s, "end": e})
    return out


def _key(text: str) -> bytes:
    """What stands for a text where equal texts count once."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def entity_pairs(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """``key, entities, pairs``: the distinct texts that name an entity, what they name and the terms near each.

    A null or empty text names none.
    """
    ship_package(docs.sparkSession)
    pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, pairs = [], [], []
            for value in batch.column(0).to_pylist():
                if value and (own := entities(value)):
                    near = {(x["entity"], x["term"]) for x in neighbours(value, own, rule)}
                    keys.append(_key(value))
                    names.append(sorted({e for _, _, _, e in own}))
                    pairs.append([{"entity": e, "term": t} for e, t in sorted(near)])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names, pa.list_(pa.string())), pa.array(pairs, pair)], ["key", "entities", "pairs"])

    ddl = "key binary, entities array<string>, pairs array<struct<entity:string,term:string>>"
    return docs.select(text).mapInArrow(found, ddl).dropDuplicates(["key"])


def _passes(terms: DataFrame, most: int):
    """The rows of ``terms`` in runs of about ``most``, by hashed term."""
    runs = -(-terms.count() // most)
    for run in range(runs):
        yield terms.filter(F.pmod(F.xxhash64("term"), F.lit(runs)) == run).collect()


def term_counts(docs: DataFrame, terms: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """``term, n_t``: in how many distinct texts each of ``terms.term`` occurs.

    Texts that hold terms travel as a key and the numbers of the terms, so that equal ones count once; each task then
    hands on one sum a term.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "term string, n_t bigint")
    for rows in _passes(terms, rule.terms):
        names = sorted(r["term"] for r in rows)
        shared = spark.sparkContext.broadcast({t: k for k, t in enumerate(names)})

        def held(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            number = shared.value
            for batch in batches:
                keys, own = [], []
                for value in batch.column(0).to_pylist():
                    if here := {w.lower() for w in _TERM.findall(value or "")} & number.keys():
                        keys.append(_key(value))
                        own.append(sorted(number[w] for w in here))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own, pa.list_(pa.int32()))], ["key", "terms"])

        def summed(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        once = docs.select(text).mapInArrow(held, "key binary, terms array<int>").dropDuplicates(["key"])
        sums = once.select("terms").mapInArrow(summed, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n_t"))
        named = spark.createDataFrame([(k, t) for k, t in enumerate(names)], "at bigint, term string")
        out = out.unionByName(staged(sums.join(named, "at").select("term", "n_t"), "pii-counts"))
        shared.unpersist()
    return out


def disclosing(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """``entity, term, disclosure`` of the pairs at or above ``generalise_at``.

    Equal texts count once in all four numbers, so copies of a page change nothing.  A term is in at least as many
    texts as it is near entities in, and its share falls with that number: pairs whose share is too small already by
    the texts near entities are dropped before the corpus is counted.
    """
    total = docs.select(F.md5(F.col(text).cast("binary"))).distinct().count()
    once = staged(entity_pairs(docs, rule, text), "pii-found")
    named = once.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    near = once.select(F.explode(F.array_distinct("pairs.term")).alias("term")).groupBy("term").agg(F.count("*").alias("m_t"))
    pairs = (
        once.select(F.explode("pairs").alias("p"))
        .groupBy("p.entity", "p.term")
        .agg(F.count("*").alias("n_et"))
        .filter(F.col("n_et") >= rule.support)
    )

    def share(n_t: str) -> Column:
        pmi = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col(n_t)))
        return pmi / F.log(F.lit(float(total)) / F.col("n_e"))

    known = pairs.join(named, "entity").filter(F.col("n_e") < total).join(near, "term")
    # a rounding error must not drop a pair that the full count keeps
    pairs = staged(known.filter(share("m_t") >= rule.generalise_at - 1e-9), "pii-pairs")
    counted = pairs.join(term_counts(docs, pairs.select("term").distinct(), rule, text), "term")
    return counted.select("entity", "term", share("n_t").alias("disclosure")).filter(F.col("disclosure") >= rule.generalise_at)


_ORDER = {kind: k for k, kind in enumerate((*KINDS, "term", "term-removed"))}


def _spans_of(shared, first: bool):
    """The spans of a text, as a column function: entities (found in the first pass) and terms of a broadcast table outside them."""

    @F.arrow_udf(returnType=SPAN_DDL)
    def spans(texts: pa.Array, before: pa.Array) -> pa.Array:
        wanted, out = shared.value, []
        for t, b in zip(texts.to_pylist(), before.to_pylist()):
            value = t or ""
            own = entities(value) if first else [(x["kind"], x["start"], x["end"], x["entity"]) for x in b]
            inside = sorted((x[1], x[2]) for x in own if x[0] in KINDS)
            more, k, busy = [], 0, 0
            for m in _TERM.finditer(value) if wanted else ():
                if x := wanted.get(m[0].lower()):
                    while k < len(inside) and inside[k][0] < m.end():
                        busy = max(busy, inside[k][1])
                        k += 1
                    if busy <= m.start():
                        more.append((x[0], m.start(), m.end(), x[1]))
            own = sorted(own + more, key=lambda x: (x[1], _ORDER[x[0]], x[2]))
            out.append([dict(zip(("kind", "start", "end", "entity"), x)) for x in own])
        return pa.array(out, SPAN)

    return spans


def disclosure_spans(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``spans array<struct<kind, start, end, entity>>``.

    Entities keep their kinds; disclosing terms follow as kind ``term`` (to generalise) or
    ``term-removed`` at all their places outside entities, each with the entity it discloses most
    of.  Spans count code points, ends exclusive, by start and then kind.  A null
    or empty text has none, an empty table gives an empty table, repeated rows (equal or
    null keys included) are all kept, and an input column ``spans`` is replaced; other names are free.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    terms = staged(disclosing(rows, rule, "_text"), "pii-terms")
    best = terms.groupBy("term").agg(
        F.max_by("entity", F.struct("disclosure", "entity")).alias("entity"), F.max("disclosure").alias("share")
    )
    kind = F.when(F.col("share") >= rule.remove_at, "term-removed").otherwise("term")
    best = staged(best.select("term", "entity", kind.alias("kind")), "pii-best")
    found = rows.withColumn("_spans", F.array().cast(SPAN_DDL))
    for k, run in enumerate([*_passes(best, rule.terms)] or [[]]):
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: (r["kind"], r["entity"]) for r in run})
        if k:  # one broadcast table at a time
            found = staged(found, "pii-spans")
        found = found.withColumn("_spans", _spans_of(shared, not k)(F.col("_text"), F.col("_spans")))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != "spans"]
    return found.select(*kept, F.col("_spans").alias("spans"))


def sanitised(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of :func:`disclosure_spans` with the spans applied to the text, without them.

    Entities become ``[EMAIL]`` and so on, terms ``[NUMBER]``, ``[NAME]`` or ``[WORD]`` by
    their form, removed terms vanish.
    """
    ship_package(found.sparkSession)

    @F.arrow_udf(returnType="string")
    def applied(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts, places):
            value, parts, done = t.as_py(), [], 0
            if value is None:
                out.append(None)
                continue
            for x in p.as_py() or ():
                if x["start"] < done:
                    continue
                word = value[x["start"] : x["end"]]
                mark = f"[{x['kind'].upper()}]"
                if x["kind"] == "term":
                    mark = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
                parts += [value[done : x["start"]], "" if x["kind"] == "term-removed" else mark]
                done = x["end"]
            out.append("".join([*parts, value[done:]]))
        return pa.array(out, pa.string())

    return found.withColumn(text, applied(F.col(text), F.col("spans"))).drop("spans")
