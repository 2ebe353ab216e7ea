"""Language identification by a small convolutional network over bytes, trained here with numpy.

Bytes fall into classes (letters without case, white space, digits, other ASCII, and the lead and
continuation bytes of UTF-8).  Filters of several widths slide over fixed-length windows; the
maximum of each filter over a window goes through a softmax.  A text is cut into windows from its
first to its last byte, and their probabilities are averaged by how many letter bytes they hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.shingles import pieces
from embertrace.llm.staging import unit
from embertrace.session import ship_package


@dataclass(frozen=True)
class Shape:
    """``per_label`` bounds the training sample: at most that many labelled documents a language,
    of each a stretch of at most ``stretch`` characters."""

    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    window: int = 256
    per_label: int = 1500
    stretch: int = 1024
    steps: int = 500
    batch: int = 192
    rate: float = 0.02
    seed: int = 23


def _classes() -> np.ndarray:
    """Class of each byte; 0 is padding, 1 to 26 the letters."""
    table = np.full(256, 29, np.int32)
    table[0] = 0
    for k in range(26):
        table[97 + k] = table[65 + k] = k + 1
    table[[9, 10, 11, 12, 13, 32]] = 27
    table[48:58] = 28
    table[128:192] = 30 + np.arange(64) % 32  # continuation bytes
    table[192:256] = 62 + np.arange(64) % 16  # lead bytes
    return table


CLASSES = _classes()
N_CLASSES = 78
_LETTER = (CLASSES >= 1) & ((CLASSES <= 26) | (CLASSES >= 30))
PAD = b"\0" * 4


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # per width: width x classes x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def _convolved(classes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Filter sums at every place of the last axis from which the widest filter fits."""
    widest = max(t.shape[0] for t in tables)
    n = classes.shape[-1] - widest + 1
    out = []
    for table in tables:
        total = table[0][classes[..., :n]]
        for k in range(1, table.shape[0]):
            total += table[k][classes[..., k : k + n]]
        out.append(total)
    return np.concatenate(out, axis=-1)


def train(samples: list[tuple[str, str]], shape: Shape = Shape()) -> Network | None:
    """The network fitted to ``(label, text)`` pairs, every label taken equally often."""
    rng = np.random.default_rng(shape.seed)
    texts: dict[str, list[np.ndarray]] = {}
    for label, text in samples:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if _LETTER[raw].any():
            texts.setdefault(label, []).append(raw)
    labels = sorted(texts)
    if not labels:
        return None
    widest, f = max(shape.widths), shape.filters
    tables = [rng.standard_normal((w, N_CLASSES, f)).astype(np.float32) * 0.3 for w in shape.widths]
    bias = np.zeros(f * len(shape.widths), np.float32)
    dense = rng.standard_normal((len(bias), len(labels))).astype(np.float32) * 0.1
    offset = np.zeros(len(labels), np.float32)
    network = Network(labels, tables, bias, dense, offset)
    weights = [*tables, bias, dense, offset]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, shape.steps + 1):
        answers = rng.integers(len(labels), size=shape.batch)
        given = np.zeros((shape.batch, shape.window + widest - 1), np.int32)
        for row, answer in enumerate(answers):
            raw = texts[labels[answer]][rng.integers(len(texts[labels[answer]]))]
            length = int(rng.integers(16, shape.window + 1))
            at = int(rng.integers(0, max(1, len(raw) - length + 1)))
            piece = CLASSES[raw[at : at + length]]
            given[row, : len(piece)] = piece
        sums = _convolved(given, tables)
        where = sums.argmax(axis=1)
        pooled = np.take_along_axis(sums, where[:, None, :], axis=1)[:, 0, :]
        hidden = np.maximum(pooled + bias, 0)
        shares = network.probabilities(pooled)
        error = shares
        error[np.arange(shape.batch), answers] -= 1
        error /= shape.batch
        back = (error @ dense.T) * (hidden > 0)
        slopes = []
        for k, table in enumerate(tables):
            slope = np.zeros_like(table)
            own = slice(k * f, (k + 1) * f)
            for j in range(table.shape[0]):
                at = np.take_along_axis(given, where[:, own] + j, axis=1)
                np.add.at(slope[j], (at, np.arange(f)[None, :]), back[:, own])
            slopes.append(slope)
        slopes += [back.sum(0), hidden.T @ error, error.sum(0)]
        rate = shape.rate * min(1.0, 2 * (1 - step / (shape.steps + 1)))
        for w, g, m, v in zip(weights, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def predict(network: Network, texts: list[str | None], shape: Shape = Shape()) -> np.ndarray:
    """Probabilities of the labels for each whole text; zeros for a text without bytes."""
    pairs, single = [], []
    for table in network.tables:  # tables of two bytes at once, the first of all widths side by side
        pairs.append((table[0][:, None, :] + table[1][None, :, :]).reshape(N_CLASSES**2, -1))
    start = np.ascontiguousarray(np.concatenate(pairs, axis=1))
    f = shape.filters
    rest = {}
    for k, table in enumerate(network.tables):
        for j in range(2, table.shape[0], 2):
            if j + 1 < table.shape[0]:
                rest[k, j] = np.ascontiguousarray((table[j][:, None, :] + table[j + 1][None, :, :]).reshape(N_CLASSES**2, f))
            else:
                single.append((k, j, np.ascontiguousarray(table[j])))
    out = np.zeros((len(texts), len(network.labels)))
    for first, raw, at in pieces(texts, 1 << 18, 512, PAD):
        ends = np.append(at[1:], len(raw)) - len(PAD)
        n_windows = np.maximum(0, -(-(ends - at) // shape.window))
        if not n_windows.sum():
            continue
        owner = np.repeat(np.arange(len(at)), n_windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        starts = at[owner] + inside * shape.window
        stops = np.minimum(starts + shape.window, ends[owner])
        classes = np.append(CLASSES[raw], np.zeros(8, np.int32))
        double = classes[:-1] * N_CLASSES + classes[1:]
        pooled = np.empty((len(starts), start.shape[1]), np.float32)
        for w in range(0, len(starts), 64):
            low, high = int(starts[w]), int(stops[min(w + 64, len(starts)) - 1])
            sums = start[double[low:high]]
            for (k, j), table in rest.items():
                sums[:, k * f : (k + 1) * f] += table[double[low + j : high + j]]
            for k, j, table in single:
                sums[:, k * f : (k + 1) * f] += table[classes[low + j : high + j]]
            for i in range(w, min(w + 64, len(starts))):
                pooled[i] = sums[starts[i] - low : stops[i] - low].max(axis=0)
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        weight = letters[stops] - letters[starts] + 1e-6
        shares = network.probabilities(pooled) * weight[:, None]
        total = np.zeros((len(at), shares.shape[1]))
        np.add.at(total, owner, shares)
        out[first : first + len(at)] = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    return out


def held_out(key: Column) -> Column:
    """Rows that are never learned from; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, shape: Shape, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """A bounded training sample: of each label the documents with the smallest hashes."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), unit(F.lit(shape.seed), key, text).alias("u")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)
    for name, n in counts.items():
        near = near | ((F.col("lang") == name) & (F.col("u") < 1.5 * shape.per_label / n))
    room = F.greatest(F.lit(0), F.length("text") - shape.stretch)
    at = (F.col("u") * 1e6 % 1 * room).cast("int") + 1
    rows = known.filter(near).select("lang", "u", F.substring("text", at, F.lit(shape.stretch)).alias("text")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["u"], r["text"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= shape.per_label:
            out.append((r["lang"], r["text"]))
    return out


def identified(docs: DataFrame, network: Network | None, shape: Shape = Shape(), text: str = "text") -> DataFrame:
    """All rows with ``lang_pred`` and ``score`` (mean probability, 0 to 1).

    A null text, or one without a letter, gives ``und`` and 0, as does having learned nothing.
    Input columns of these names are replaced.
    """
    ship_package(docs.sparkSession)
    if network is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf(returnType="struct<lang:string,score:double>")
    def named(texts: pa.Array) -> pa.Array:
        shares = predict(shared.value, texts.to_pylist(), shape)
        best = shares.argmax(axis=1)
        names = [shared.value.labels[k] for k in best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares[np.arange(len(best)), best])], ["lang", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("_named", named(F.col(text)))
        .withColumn("lang_pred", F.when(lettered, F.col("_named.lang")).otherwise(F.lit("und")))
        .withColumn("score", F.when(lettered, F.least(F.lit(1.0), F.col("_named.score"))).otherwise(F.lit(0.0)))
        .drop("_named")
    )


def identify_languages(docs: DataFrame, shape: Shape = Shape(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learns from the rows that are not held out and names the language of all rows.

    Adds ``held_out``, ``lang_pred`` and ``score``.  An empty table gives an empty table.
    """
    network = train(sample(docs, shape, text, lang, key), shape)
    return identified(docs.withColumn("held_out", held_out(F.col(key))), network, shape, text)
