"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF rows over their terms, with document frequencies counted over
all documents; every term keeps a positive weight, a common one a small one.  A randomised SVD
of these rows, whose products with the rows are summed by Spark, gives a latent space.  Every text is projected block by block of words; sums of neighbouring
blocks are its windows at several lengths.  Windows whose cosine with a benchmark passage is high
enough, and which hold enough of its weight (a window with three words of it does not), are
candidates, and those are confirmed by the longest common subsequence of words and, for
looser paraphrases, by finding the end of the passage (its answer) in the window.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.shingles import LETTERS, pieces, words_of
from embertrace.llm.staging import staged
from embertrace.session import ship_package


@dataclass(frozen=True)
class Retrieval:
    """``items`` is how many benchmark passages one pass over the documents looks for; with their
    terms and ``rank`` it bounds what is broadcast.  A window needs ``least_terms`` known words, or as
    many as the shortest passage has.  ``cosine`` is asked of passages of a block of words or more;
    a shorter one fills less of its windows and needs less by the root of its part of a block.
    ``scales`` are doubled on until a window is as long as the longest passage."""

    rank: int = 64
    least_terms: int = 3
    block_words: int = 12
    scales: tuple[int, ...] = (2, 4)
    cosine: float = 0.55
    cover: float = 0.4
    sure: float = 0.75
    likely: float = 0.55
    answer_words: int = 8
    answer_share: float = 0.75
    items: int = 4_000
    seed: int = 17


HIT = pa.list_(pa.struct([("item", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))
HIT_DDL = "array<struct<item:bigint,cosine:double,lcs:double,answer:boolean>>"


def _words(texts: list[str | None]):
    """Per run of texts: number of the first, how many, and of each word its text, place there and hash.

    Case does not count.
    """
    for first, raw, at in pieces([t and t.lower() for t in texts]):
        hashes, starts, _ = words_of(raw, LETTERS)
        owner = np.searchsorted(at, starts, "right") - 1
        n = np.bincount(owner, minlength=len(at))
        yield first, len(at), owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), hashes


def _known(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are among the sorted terms, and the numbers of those terms."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    mine = np.flatnonzero(terms[at] == hashes)
    return mine, at[mine]


def document_frequencies(docs: DataFrame, terms: np.ndarray, text: str = "text") -> np.ndarray:
    """In how many documents each term occurs, counted over all of them; last, their number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches):
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for _, n, owner, _, hashes in _words(batch.column(0).to_pylist()):
                mine, term = _known(hashes, shared.value)
                once = np.unique(owner[mine] * len(total) + term)
                total += np.bincount(once % len(total), minlength=len(total))
                total[-1] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    found = np.zeros(len(terms) + 1, np.int64)
    for row in docs.select(text).mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[row["term"]] = row["n"]
    return found


def _rows(texts: list[str], terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF rows of the texts."""
    out = np.zeros((len(texts), len(terms)))
    for first, _, owner, _, hashes in _words(texts):
        mine, term = _known(hashes, terms)
        np.add.at(out, (first + owner[mine], term), weights[term])
    return out


def latent_space(passages: DataFrame, terms: np.ndarray, weights: np.ndarray, rule: Retrieval) -> np.ndarray:
    """Right singular vectors (terms x rank) of the unit TF-IDF rows of ``passages.text``.

    Spark sums A'(A X) over parts of the passages; X and the sums are bounded by terms x rank.
    One power step sharpens the random start, then a small eigenproblem gives the vectors.
    """
    context = passages.sparkSession.sparkContext
    fixed = context.broadcast((terms, weights))

    def through(matrix: np.ndarray) -> np.ndarray:
        shared = context.broadcast(matrix)

        def products(batches):
            total, some = np.zeros_like(shared.value), False
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for k in range(0, len(texts), 16):
                    rows = _rows(texts[k : k + 16], *fixed.value)
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                    total += rows.T @ (rows @ shared.value)
                    some = True
            if some:
                k, j = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(total[k, j])], ["k", "j", "x"])

        out = np.zeros_like(matrix)
        sums = passages.select("text").mapInArrow(products, "k bigint, j bigint, x double").groupBy("k", "j").agg(F.sum("x").alias("x"))
        for r in sums.toLocalIterator():
            out[r["k"], r["j"]] = r["x"]
        shared.unpersist()
        return out

    basis = np.random.default_rng(rule.seed).standard_normal((len(terms), min(rule.rank, len(terms))))
    for _ in range(2):
        basis, _ = np.linalg.qr(through(basis))
    _, turns = np.linalg.eigh(basis.T @ through(basis))
    return (basis @ turns[:, ::-1]).astype(np.float32)


def common_subsequence(masks: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word in the other text."""
    row = 0
    for word in words:
        if mask := masks.get(word):
            both = row | mask
            row = both & ~(both - ((row << 1) | 1))
    return row.bit_count()


def closest_share(masks: dict[int, int], n: int, region: list[int]) -> float:
    """The largest share of ``n`` words in a stretch half as long again, which keeps chance out of short passages."""
    starts = [k for k, word in enumerate(region) if word in masks]
    return max((common_subsequence(masks, region[k : k + n + n // 2]) for k in starts), default=0) / n


def place_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


@dataclass(frozen=True)
class Stock:
    """What one pass looks for: passages as word hashes, their ids and latent rows, and the space."""

    name: str
    ids: list[int]
    words: list[list[int]]
    latent: np.ndarray
    weight: np.ndarray  # length of each passage's row, as far as the space holds it
    terms: np.ndarray
    weighed: np.ndarray  # terms x rank, the projection times the weights


def _wider(x: np.ndarray, scale: int, owner: np.ndarray) -> np.ndarray:
    """Sums over ``2 * scale`` blocks of a text from each block on, from those over ``scale`` blocks."""
    out = x.copy()
    if scale < len(x):
        out[:-scale] += x[scale:] * (owner[scale:] == owner[:-scale]).reshape(-1, *[1] * (x.ndim - 1))
    return out


def _scales(longest: int, rule: Retrieval) -> list[int]:
    """The scales of the rule, doubled on until a window is as long as the longest passage."""
    scales = sorted(rule.scales)
    while scales[-1] * rule.block_words < longest:
        scales.append(2 * scales[-1])
    return scales


def _searched(texts: list[str | None], stock: Stock, rule: Retrieval, masks: dict) -> list[list[dict]]:
    """The hits of each text; one list per text."""
    hits: list[dict[int, dict]] = [{} for _ in texts]
    items, latent = stock.words, stock.latent
    sizes = np.array([len(w) for w in items])
    least = min(rule.least_terms, int(sizes.min()))
    limits = (rule.cosine * np.sqrt(np.minimum(1.0, sizes / rule.block_words))).astype(np.float32)
    for first, n_texts, owner, place, hashes in _words(texts):
        mine, term = _known(hashes, stock.terms)
        if not len(mine):
            continue
        n_words = np.bincount(owner, minlength=n_texts)
        n_blocks = -(-n_words // rule.block_words)
        block_at, word_at = np.cumsum(n_blocks) - n_blocks, np.cumsum(n_words) - n_words
        blocks = np.zeros((int(n_blocks.sum()), latent.shape[1]), np.float32)
        block = block_at[owner[mine]] + place[mine] // rule.block_words
        weighty = np.bincount(block, minlength=len(blocks))
        for k in range(0, len(mine), 1 << 14):
            part = block[k : k + (1 << 14)]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            blocks[part[cuts]] += np.add.reduceat(stock.weighed[term[k : k + (1 << 14)]], cuts, axis=0)
        block_owner = np.repeat(np.arange(n_texts), n_blocks)
        sums, enough, reached = blocks, weighty, 1
        for scale in _scales(int(sizes.max()), rule):
            while reached < scale:
                sums, enough, reached = _wider(sums, reached, block_owner), _wider(enough, reached, block_owner), 2 * reached
            # Wider windows than those of the rule are for passages that do not fit into one of half the width.
            wanted = np.arange(len(sizes)) if scale in rule.scales else np.flatnonzero(sizes > scale * rule.block_words // 2)
            own, asked, weight = latent[wanted], limits[wanted], stock.weight[wanted]
            chosen = np.flatnonzero(enough >= least)
            for low in range(0, len(chosen), 2048):
                at = chosen[low : low + 2048]
                windows = sums[at]
                length = np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
                windows /= length
                cosines = windows @ own.T
                near = np.flatnonzero(cosines.max(axis=1) >= asked.min())
                w_near, found = np.nonzero(cosines[near] >= asked)
                w_near = near[w_near]
                covers = cosines[w_near, found] * length[w_near, 0] >= rule.cover * weight[found]
                for w, column in zip(w_near[covers], found[covers]):
                    item = int(wanted[column])
                    doc = int(block_owner[at[w]])
                    known = hits[first + doc].get(item)
                    if known and known["lcs"] >= 1:
                        continue
                    if item not in masks:
                        words = items[item]
                        masks[item] = place_masks(words), place_masks(words[-rule.answer_words :])
                    words = items[item]
                    start = int(at[w] - block_at[doc]) * rule.block_words
                    more = max(rule.block_words, len(words) // 2)
                    a, b = max(0, start - more), min(int(n_words[doc]), start + scale * rule.block_words + more)
                    region = hashes[word_at[doc] + a : word_at[doc] + b].tolist()
                    whole, answer = masks[item]
                    brief = len(words) < rule.block_words
                    share = closest_share(whole, len(words), region) if brief else common_subsequence(whole, region) / len(words)
                    short = min(rule.answer_words, len(words))
                    ends = common_subsequence(answer, region) >= rule.answer_share * short
                    if share >= rule.sure or share >= rule.likely and ends and not brief:
                        if not known or share > known["lcs"]:
                            hits[first + doc][item] = {
                                "item": item, "cosine": float(cosines[w, column]), "lcs": share, "answer": ends
                            }
    return [sorted(h.values(), key=lambda x: x["item"]) for h in hits]


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, rule: Retrieval = Retrieval(), text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """All rows of ``docs`` with ``hits array<struct<item, cosine, lcs, answer>>`` by item.

    ``item`` is the passage's integer id.  Null or empty texts and texts without words have no
    hits; neither do passages without words.  Passages with a null id are left out; repeated
    passages give a hit each.  Empty tables on either side give rows with no hits.  A column named
    ``hits`` is replaced.  Benchmarks larger than ``rule.items`` are searched in blocks, one pass each.
    """
    ship_package(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = docs.drop("hits")
    none = F.array().cast(HIT_DDL)
    passages = benchmark.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item).cast("bigint").alias("id"), F.col(item_text).alias("text")
    )
    passages = staged(passages, "passages")
    runs = -(-passages.count() // rule.items)
    parts, found = [], docs
    for run in range(runs):
        own = passages.filter(F.pmod(F.xxhash64("id", "text"), F.lit(runs)) == run)
        if stock := _stock(docs, own, rule, text):
            parts.append(f"_hits_{run}")
            found = found.withColumn(parts[-1], _searcher(context.broadcast(stock), rule)(F.col(text)))
    if not parts:
        return docs.withColumn("hits", none)
    return found.withColumn("hits", F.array_sort(F.concat(*parts))).drop(*parts)


def _stock(docs: DataFrame, passages: DataFrame, rule: Retrieval, text: str) -> Stock | None:
    """The passages of one pass with their latent space; None if they have no words."""
    own = passages.orderBy("id", "text").collect()
    words: list[list[int]] = [[] for _ in own]
    for first, _, owner, _, hashes in _words([r["text"] for r in own]):
        for k, h in zip(owner.tolist(), hashes.tolist()):
            words[first + k].append(h)
    filled = [k for k, w in enumerate(words) if w]
    if not filled:
        return None
    terms = np.unique(np.concatenate([np.array(words[k], np.uint64) for k in filled]))
    counts = document_frequencies(docs, terms, text)
    weights = np.log((counts[-1] + 2) / (counts[:-1] + 1))
    space = latent_space(passages, terms, weights, rule)
    parts = [_rows([own[j]["text"] for j in filled[k : k + 16]], terms, weights) @ space for k in range(0, len(filled), 16)]
    latent = np.concatenate(parts)
    weight = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    latent = (latent / weight[:, None]).astype(np.float32)
    weighed = space * weights[:, None].astype(np.float32)
    return Stock(uuid.uuid4().hex, [own[k]["id"] for k in filled], [words[k] for k in filled], latent, weight, terms, weighed)


#: Place masks of the passages of a pass, by its name, kept between the batches of a task.
_MASKS: dict[str, dict] = {}


def _searcher(shared, rule: Retrieval):
    """The search for a broadcast stock as a column function."""

    @F.arrow_udf(returnType=HIT_DDL)
    def search(texts: pa.Array) -> pa.Array:
        stock = shared.value
        hits = _searched(texts.to_pylist(), stock, rule, _MASKS.setdefault(stock.name, {}))
        return pa.array([[x | {"item": stock.ids[x["item"]]} for x in h] for h in hits], HIT)

    return search


def decontaminated(docs: DataFrame, benchmark: DataFrame, rule: Retrieval = Retrieval(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    return benchmark_hits(docs, benchmark, rule, text).filter(F.size("hits") == 0).drop("hits")
