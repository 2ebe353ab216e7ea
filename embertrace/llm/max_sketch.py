"""Ranked lexical search through hashed max-sketches.

A term's impact in a document, ``(10**9 tf) div (1000 tf + 20 m)``, does not depend on the query.  Each
document's impacts fold into a sketch: its coordinate ``c`` holds the largest impact among the terms hashed to
``c``.  For a batch of documents one matrix product looks up all items: the weights of an item's terms, summed by
coordinate, times the sketch bound the item's score from above.  Documents are scored exactly in the order of
falling bounds until the bound is below the score that the item's last hit has, which holds from batch to batch.

A task hands on at most ``top`` hits an item, and those are ranked in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertrace.llm.shingles import LETTERS, pieces, words_of
from embertrace.llm.staging import staged
from embertrace.session import ship_package


@dataclass(frozen=True)
class Search:
    """``items`` is how many benchmark items one pass over the documents ranks: it bounds what is broadcast
    and what a task holds.  A sketch has ``2**bits`` coordinates; ``step`` documents an item are scored between
    two looks at the threshold."""

    top: int = 50
    items: int = 2_000
    bits: int = 10
    step: int = 64


_NO_ID = np.iinfo(np.int64).max


def _tokens(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts: number of the first, how many; of each term its text and hash, by text."""
    for first, raw, at in pieces(texts):
        hashes, starts, _ = words_of(raw, LETTERS)
        yield first, len(at), np.searchsorted(at, starts, "right") - 1, hashes


class Queries:
    """The terms of a block of items: ``terms`` sorted, and for each item the places of its own there."""

    def __init__(self, texts: list[tuple[int | None, str | None]]):
        sets: dict[int | None, set[int]] = {}
        for item, text in texts:
            found = sets.setdefault(item, set())
            for _, _, _, hashes in _tokens([text]):
                found.update(hashes.tolist())
        self.ids = list(sets)
        self.terms = np.array(sorted(set().union(*sets.values())), np.uint64)
        own = [np.searchsorted(self.terms, np.array(sorted(sets[i]), np.uint64)) for i in self.ids]
        self.ends = np.cumsum([0, *map(len, own)])
        self.places = np.concatenate(own).astype(np.int64) if own else np.empty(0, np.int64)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of the items, and which terms."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        mine = np.flatnonzero(self.terms[at] == hashes)
        return mine, at[mine]


def counted(docs: DataFrame, queries: Queries) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents with terms, and all their terms, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        size = len(queries.terms)
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for _, _, owner, hashes in _tokens(batch.column(0).to_pylist()):
                mine, term = queries.known(hashes)
                total[:size] += np.bincount(np.unique(owner[mine] * size + term) % max(size, 1), minlength=size)[:size]
                total[size:] += len(np.unique(owner)), len(owner)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["at", "n"])

    sums = np.zeros(len(queries.terms) + 2, object)
    for row in docs.mapInArrow(partial, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[row["at"]] = row["n"]
    shared.unpersist()
    return sums[:-2].astype(np.int64), int(sums[-2]), int(sums[-1])


class Ranking:
    """The best hits of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[item]
        if not good.any():
            return
        item, doc, score = (np.concatenate([old, new[good]]) for old, new in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stays = place < self.top
        order = order[stays]
        self.item, self.doc, self.score = item[stays], doc[order], score[order]
        last = place == self.top - 1
        self.least[item[last]] = self.score[np.flatnonzero(last[stays])]


@dataclass
class Corpus:
    """What the scores need to know of all documents: term weights, documents with terms, all their terms."""

    weights: np.ndarray
    docs: int
    terms: int

    def mean_parts(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents with ``n`` terms."""
        wide = int(n.max(initial=0)) * 50 * self.docs > _NO_ID
        return (50 + (50 * (n.astype(object) if wide else n) * self.docs) // max(self.terms, 1)).astype(np.int64)


class Searcher:
    """One task's search for a block of items."""

    def __init__(self, queries: Queries, corpus: Corpus, rule: Search):
        self.queries, self.corpus, self.rule = queries, corpus, rule
        self.best = Ranking(len(queries.ids), rule.top)
        self.shift = np.uint64(64 - rule.bits)
        # single precision: sums of as many products as there are coordinates stay below this
        self.over = 1 + 2.0**-22 * (1 << rule.bits)
        self.lookup = np.zeros((1 << rule.bits, len(queries.ids)), np.float32)
        item = np.repeat(np.arange(len(queries.ids)), np.diff(queries.ends))
        coordinate = (queries.terms[queries.places] >> self.shift).astype(np.int64)
        np.add.at(self.lookup, (coordinate, item), corpus.weights[queries.places].astype(np.float32))

    def read(self, ids: np.ndarray, n: int, owner: np.ndarray, hashes: np.ndarray) -> None:
        """Rank ``n`` documents by their terms."""
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])[: len(owner)])
        tf = np.diff(np.append(first, len(owner)))
        m = self.corpus.mean_parts(np.bincount(owner, minlength=n))
        owner, hashes = owner[first], hashes[first]
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])
        mine, term = self.queries.known(hashes)
        hits = owner[mine] * len(self.queries.terms) + term, impact[mine] * self.corpus.weights[term]

        sketch = np.zeros((n, 1 << self.rule.bits), np.float32)
        np.maximum.at(sketch.reshape(-1), (owner << self.rule.bits) + (hashes >> self.shift).astype(np.int64), impact.astype(np.float32))
        bound = (sketch @ self.lookup) * np.float32(self.over) + 1
        doc, item = np.nonzero(bound > np.maximum(self.best.least, 2))
        height = bound[doc, item]
        order = np.lexsort((-height, item))
        doc, item, height = doc[order], item[order], height[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        while len(item):
            now = place < self.rule.step
            self.best.add(item[now], ids[doc[now]], self.scores(doc[now], item[now], *hits))
            rest = ~now & (height > self.best.least[item])
            doc, item, height, place = doc[rest], item[rest], height[rest], place[rest] - self.rule.step

    def scores(self, doc: np.ndarray, item: np.ndarray, at: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Exact scores of documents for items; ``at`` and ``gain``: the batch's known terms by document."""
        starts = self.queries.ends[item]
        sizes = self.queries.ends[item + 1] - starts
        if not len(at) or not sizes.sum():
            return np.zeros(len(doc), np.int64)
        ends = np.cumsum(sizes)
        term = self.queries.places[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]
        wanted = np.repeat(doc, sizes) * len(self.queries.terms) + term
        place = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        sums = np.concatenate([[0], np.cumsum(np.where(at[place] == wanted, gain[place], 0))])
        return sums[ends] - sums[ends - sizes]


def _hits(docs: DataFrame, queries: Queries, corpus: Corpus, rule: Search) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((queries, corpus))

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        searcher = Searcher(queries, corpus, rule)
        for batch in batches:
            ids = batch.column(1).fill_null(_NO_ID).to_numpy()
            for first, n, owner, hashes in _tokens(batch.column(0).to_pylist()):
                searcher.read(ids[first : first + n], n, owner, hashes)
        best = searcher.best
        items = pa.array(queries.ids, pa.int64()).take(pa.array(best.item))
        found = [items, pa.array(best.doc, mask=best.doc == _NO_ID), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(found, ["item_id", "doc_id", "score"])

    return docs.mapInArrow(searched, "item_id bigint, doc_id bigint, score bigint")


def ranked_documents(docs: DataFrame, items: DataFrame, rule: Search = Search()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents that score highest for each item, best first.

    Every row of ``docs`` is a document.  Null texts have no terms; an item or document without terms is in no hit.
    Rows of ``items`` that share an item_id are one item with the terms of all of them.  Equal scores go by doc_id,
    documents without one last.  Terms are known by 64 bits of a hash.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / rule.items))
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        queries = Queries([(r["item_id"], r["text"]) for r in mine.collect()])
        df, n, terms = counted(texts, queries)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        hits = _hits(texts, queries, Corpus(weights, n, terms), rule)
        if blocks > 1:
            hits = staged(hits, "search-hits")
        found = hits if found is None else found.unionByName(hits)
    best_first = F.desc("score"), F.asc_nulls_last("doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    some = F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*best_first))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))
    first = found.withColumn("_part", part).withColumn("_rank", some).filter(F.col("_rank") <= rule.top)
    return first.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= rule.top)
