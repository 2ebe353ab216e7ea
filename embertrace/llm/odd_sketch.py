"""Near-duplicate detection by MinHash bands, odd sketches and exact confirmation.

Each set of word shingles gives ``bands * rows`` MinHash samples.  Bands of samples name
buckets; an odd sketch, a bitmap in which each sample flips one bit, estimates the similarity
of two members of a bucket from the population count of the XOR.  A second, wider one over all
elements of the set bounds the difference of two sets exactly: an XOR count never exceeds it.
What neither rules out is confirmed on the full sets.

No bucket is turned into all of its pairs.  First every member meets the smallest member of
its bucket.  What then still lies outside the largest component of a bucket meets there the
members of other components that the sketches do not rule out; the sketches are compared inside
the join, so pairs they rule out never become rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.components import components
from embertrace.llm.shingles import mixed, pieces, shingle_hashes, shingle_set
from embertrace.llm.staging import staged
from embertrace.session import ship_package


@dataclass(frozen=True)
class Plan:
    """A link needs ``100 * intersection >= percent * union`` of ``width``-word shingle sets.

    A pair at the limit of 85 % shares no band with probability (1 - 0.85**6)**30 < 7e-7.
    ``errors`` is how many standard errors below the limit an estimate may lie.
    """

    width: int = 5
    percent: int = 85
    bands: int = 30
    rows: int = 6
    bits: int = 512
    set_bits: int = 2048
    errors: float = 5.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """The largest XOR count of a pair that may be a link.

        D differing samples flip 2 D bits; the count has mean n/2 (1 - (1 - 2/n)**(2 D)).  D is
        binomial, and the bits that fall together add the noise of balls in bins.
        """
        miss = 1 - self.percent / 100
        differ = self.samples * miss + self.errors * math.sqrt(self.samples * miss * (1 - miss))
        mean = self.bits / 2 * (1 - (1 - 2 / self.bits) ** (2 * differ))
        noise = math.sqrt(max(1.0, self.bits / 4 * (1 - (1 - 4 / self.bits) ** (2 * differ))))
        return math.ceil(mean + self.errors / 2 * noise)


SKETCH_DDL = "struct<n_shingles:bigint,sum_a:bigint,sum_b:bigint,bands:array<bigint>,odd:array<bigint>,whole:array<bigint>>"


def _samples(hashes: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """MinHash samples of non-empty sets that lie one after the other."""
    turns = np.random.default_rng(29).integers(0, 1 << 31, plan.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(high)
    out = np.empty((len(starts), plan.samples), np.uint32)
    for j in range(plan.samples):
        np.multiply(high, turns[j], out=turned)
        out[:, j] = np.minimum.reduceat(turned, starts)
    return out


def _bands(samples: np.ndarray, plan: Plan) -> np.ndarray:
    keys = np.repeat(mixed(np.arange(1, plan.bands + 1, dtype=np.uint64))[None, :], len(samples), 0)
    for r in range(plan.rows):
        keys = mixed(keys * np.uint64(31) + samples[:, r :: plan.rows].astype(np.uint64))
    return keys.view(np.int64)


def _parities(owner: np.ndarray, hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bitmap for each of ``n`` owners in which each of its hashes flips a bit."""
    flat = owner * bits + (hashes % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1).view(np.int64)


def _odd(samples: np.ndarray, plan: Plan) -> np.ndarray:
    named = samples.astype(np.uint64) | (np.arange(plan.samples, dtype=np.uint64) << np.uint64(32))[None, :]
    return _parities(np.repeat(np.arange(len(samples)), plan.samples), mixed(named).ravel(), len(samples), plan.bits)


def _sketched(texts: pa.Array, plan: Plan) -> pa.Array:
    n = len(texts)
    sizes, sums = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    bands, odd = np.zeros((n, plan.bands), np.int64), np.zeros((n, plan.bits // 64), np.int64)
    whole = np.zeros((n, plan.set_bits // 64), np.int64)
    for first, raw, at in pieces(texts.to_pylist()):
        hashes, counts = shingle_hashes(raw, at, plan.width)
        starts = np.cumsum(counts) - counts
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        rows, members = first + full, []
        for k, doc in zip(rows, full):
            own = np.unique(hashes[starts[doc] : starts[doc] + counts[doc]])
            members.append(own)
            sizes[k] = len(own)
            sums[k] = own.sum(dtype=np.uint64).view(np.int64), mixed(own ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)
        samples = _samples(hashes, starts[full], plan)
        bands[rows], odd[rows] = _bands(samples, plan), _odd(samples, plan)
        owner = np.repeat(np.arange(len(full)), sizes[rows])
        whole[rows] = _parities(owner, mixed(np.concatenate(members)), len(full), plan.set_bits)
    lists = [
        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for x in (bands, odd, whole)
    ]
    return pa.StructArray.from_arrays(
        [pa.array(sizes), pa.array(sums[:, 0]), pa.array(sums[:, 1]), *lists], ["n_shingles", "sum_a", "sum_b", "bands", "odd", "whole"]
    )


def sketches(docs: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, n_shingles, sum_a, sum_b, bands, odd`` of every row; equal sets have equal sums."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(returnType=SKETCH_DDL)
    def sketched(texts: pa.Array) -> pa.Array:
        return _sketched(texts, plan)

    return docs.select(F.col(key).alias("id"), sketched(F.col(text)).alias("s")).select("id", "s.*")


def _fields(plan: Plan) -> list[Column]:
    """Size and sketches of a set as plain numbers, which joins read faster than arrays."""
    odd = [F.get("odd", F.lit(k)).alias(f"o{k}") for k in range(plan.bits // 64)]
    return [F.col("n_shingles").alias("n"), *odd, *(F.get("whole", F.lit(k)).alias(f"w{k}") for k in range(plan.set_bits // 64))]


def _xor_count(x: Column, y: Column, name: str, bits: int) -> Column:
    total = F.lit(0)
    for k in range(bits // 64):
        total = total + F.bit_count(x[f"{name}{k}"].bitwiseXOR(y[f"{name}{k}"]))
    return total


def _may_link(x: Column, y: Column, plan: Plan) -> Column:
    """Whether the sketches of two sets leave a link open.

    Sets of a and b elements are a link if they differ in at most (100 - percent) (a + b) /
    (100 + percent) elements, and the XOR count of the set bitmaps is never more than that.
    """
    differ = _xor_count(x, y, "w", plan.set_bits)
    most = (100 - plan.percent) * (x["n"] + y["n"])
    return (_xor_count(x, y, "o", plan.bits) <= plan.most_bits) & ((100 + plan.percent) * differ <= most)


def _confirmed(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are a link."""

    @F.arrow_udf(returnType="boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, held = [], None, None
        for x, y in zip(left, right):
            x, y = x.as_py(), y.as_py()
            if held is None or x != last:
                last, held = x, shingle_set(x, plan.width)
            other = shingle_set(y, plan.width)
            both = len(np.intersect1d(held, other, assume_unique=True))
            out.append(both > 0 and 100 * both >= plan.percent * (len(held) + len(other) - both))
        return pa.array(out, pa.bool_())

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").filter(linked("text_a", "text_b")).select("a", "b")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id`` and ``kept``.

    The component is named by its smallest key.  A null or empty text, or one without words,
    has no shingles and is linked with nothing.  A row with a null key cannot name a group: it
    is linked with nothing, its component is null and it is kept.  Rows that share a key share
    a component.  An empty table gives an empty table; other columns are not looked at.
    """
    drawn = staged(sketches(docs, plan, text, key), "sketches")
    full = drawn.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    sets = staged(
        full.groupBy("n_shingles", "sum_a", "sum_b").agg(
            F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("whole").alias("whole")
        ),
        "sets",
    )
    in_band = sets.select("node", F.explode("bands").alias("band"))
    several = in_band.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter(F.col("n") > 1)
    members = staged(in_band.join(several.select("band", "lead"), "band"), "buckets")
    wanted = members.select("node").distinct()
    sources = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = staged(sources.join(wanted, F.col("id") == F.col("node"), "left_semi"), "candidates")
    odd = staged(sets.join(wanted, "node", "left_semi").select("node", F.struct(*_fields(plan)).alias("sketch")), "odd-sketches")

    pairs = members.filter(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    left, right = (odd.select(F.col("node").alias(n), F.col("sketch").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    near = pairs.join(right, "b").join(left, "a").filter(_may_link(F.col("x"), F.col("y"), plan))
    links = staged(_confirmed(near.select("a", "b"), texts, plan), "found")
    labels = components(links)
    found = staged(_confirmed(_meetings(_open_members(members, labels, odd), plan), texts, plan), "found")
    if not found.isEmpty():
        labels = components(links.unionByName(found))

    node_of = sets.select("n_shingles", "sum_a", "sum_b", "node")
    named = (
        drawn.select("id", "n_shingles", "sum_a", "sum_b")
        .join(node_of, ["n_shingles", "sum_a", "sum_b"], "left")
        .join(labels, "node", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id"))
    return named.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _open_members(members: DataFrame, labels: DataFrame, odd: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components; ``main`` marks the largest one there."""
    labelled = members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    ranked = per.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top"))
    several = ranked.filter(F.col("parts") > 1).select("band", F.col("top.label").alias("top"))
    return staged(
        labelled.join(several, "band")
        .select("band", "node", "label", (F.col("label") == F.col("top")).alias("main"))
        .join(odd, "node"),
        "open",
    )


def _meetings(open_: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of members of different components that their sketches do not rule out; one side is
    outside the main component of the bucket."""
    x = open_.filter(~F.col("main")).select("band", F.col("node").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("x"))
    y = open_.select("band", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("y"), "main")
    apart = (F.col("la") != F.col("lb")) & (F.col("main") | (F.col("a") < F.col("b")))
    met = x.join(y, (x["band"] == y["band"]) & apart & _may_link(F.col("x"), F.col("y"), plan))
    return met.select("a", "b").distinct()
