"""How the sources of a language differ in the words they use.

Every task gathers texts into shards and builds, over the shard's Arrow buffer, a pointer to the start
of each word.  The pointers are sorted by the words they point to, eight bytes at a time: a multikey
quicksort whose slices, pointers with equal words so far, are sorted on by the next eight bytes.  A run of
equal words, seen by document and source, gives the word's document frequency and its count in each source.
Words are compared by all of their bytes; no hash stands for them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.llm.staging import staged
from embertrace.session import ship_package

#: Bytes of terms: ASCII letters and all beyond ASCII; A-Z count as a-z.
_IN_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first k bytes of eight.
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
#: A shard ends after so many bytes of text; its pointers take about ten times as much while they are sorted.
SHARD_BYTES = 8 << 20
#: Runs of longer terms are told apart by comparing the rest of their bytes at once.
_LONG = 64
#: Numbers in a block of counts, terms times sources.
_CELLS = 1 << 17

TALLY = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TALLY_DDL = "lang string, source string, term string, n bigint, docs bigint"


def term_pointers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every term of the texts that lie in ``raw`` between ``offsets``."""
    inside = _IN_TERM[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    starts = np.flatnonzero(inside & ~before).astype(kind)
    lengths = np.flatnonzero(inside & ~after).astype(kind) - starts + kind(1)
    return starts, lengths, np.searchsorted(offsets, starts, "right").astype(kind) - kind(1)


def equal_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their terms' bytes, and for each the number of its run of equal terms.

    ``raw`` has eight more bytes at its end.
    """
    eight = np.ndarray(len(raw) - 7, np.uint64, raw.data, strides=(1,))

    def keys(at: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[at] - depth, 0, 8)
        return eight[np.where(left > 0, starts[at] + depth, 0)].byteswap() & _FIRST[left]

    order = np.arange(len(starts), dtype=np.int32 if len(starts) < 1 << 31 else np.int64)
    new = np.ones(len(starts), bool)
    key = keys(order, 0)
    turned = np.argsort(key)
    order, key = order[turned], key[turned]
    new[1:] = key[1:] != key[:-1]
    depth = 8
    while True:
        edges = np.append(np.flatnonzero(new), len(new))
        goes_on = np.logical_or.reduceat(lengths[order] > depth, edges[:-1]) if len(new) else np.zeros(0, bool)
        sizes = np.diff(edges)
        tied = np.flatnonzero(np.repeat(goes_on & (sizes > 1), sizes))
        if not len(tied):
            return order, np.cumsum(new) - 1
        run = np.repeat(np.arange(len(sizes)), sizes)[tied]
        mine = order[tied]
        if depth < _LONG:
            key = keys(mine, depth)
            depth += 8
        else:
            rest = [raw[starts[p] + depth : starts[p] + lengths[p]].tobytes() for p in mine]
            place = {b: k for k, b in enumerate(sorted(set(rest)))}
            key = np.array([place[b] for b in rest], np.uint64)
            depth = int(lengths.max())
        turned = np.lexsort((key, run))
        order[tied], key = mine[turned], key[turned]
        new[tied[1:]] |= key[1:] != key[:-1]


def _gathered(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The terms that the pointers point to, as strings."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[at])).cast(pa.string())


def shard_tally(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Table:
    """Occurrences and documents of each term by language and source; the arrays hold no nulls."""
    pairs = pa.StructArray.from_arrays([langs, sources], ["l", "s"])
    seen: dict[tuple[str, str], int] = {}
    group = np.array([seen.setdefault((p["l"], p["s"]), len(seen)) for p in pairs.to_pylist()], np.int64)
    by_group = np.argsort(group, kind="stable")
    texts = texts.take(pa.array(by_group)).cast(pa.large_string())
    group = group[by_group]
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    raw = np.zeros(len(bytes_) + 8, np.uint8)
    raw[: len(bytes_)] = _LOWER[bytes_]
    starts, lengths, doc = term_pointers(raw[: len(bytes_)], offsets - offsets[0])
    if not len(starts):
        return TALLY.empty_table()
    order, run = equal_runs(raw, starts, lengths)
    heads = order[np.searchsorted(run, np.arange(run[-1] + 1))]
    code = run * len(texts)
    code += doc[order]
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    in_doc = np.diff(np.append(first, len(code)))
    run_of, doc_of = np.divmod(code[first], len(texts))
    cell = run_of * len(seen) + group[doc_of]
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    run_of, group_of = np.divmod(cell[edge], len(seen))
    terms = _gathered(raw, starts[heads], lengths[heads])
    names = list(seen)
    take = pa.array(group_of)
    return pa.table(
        [
            pa.array([n[0] for n in names], pa.string()).take(take),
            pa.array([n[1] for n in names], pa.string()).take(take),
            terms.take(pa.array(run_of)),
            np.add.reduceat(in_doc, edge),
            np.diff(np.append(edge, len(cell))),
        ],
        schema=TALLY,
    )


def _tallies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from shard_tally(*(table[c].combine_chunks() for c in ("text", "lang", "source"))).to_batches(1 << 16)

    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch["text"]), np.int64)
        full = (np.cumsum(lengths) + size) // SHARD_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(full)) + 1), len(lengths)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if k:
                yield from closed()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(lengths[a:b].sum())
        if size >= SHARD_BYTES:
            yield from closed()
            held, size = [], 0
    yield from closed()


def shares(count, total, terms):
    """``1 + floor(10**9 (count + 2) / (total + 2 terms))`` for arrays of whole numbers."""
    wide = np.asarray(count).max(initial=0) > 9_000_000_000
    over = (np.asarray(count).astype(object) if wide else count) + 2
    return (1 + over * 1_000_000_000 // (total + 2 * terms)).astype(np.int64)


def pair_sums(table: pa.Table) -> pa.Table:
    """For a shard of a language's terms: the summed divergence of each pair of its sources.

    Rows with a source but no term give the source's total and the language's number of terms.
    """
    is_total = np.asarray(table["term"].is_null())
    totals, cells = table.filter(pa.array(is_total)), table.filter(pa.array(~is_total))
    names = sorted(totals["source"].to_pylist(), key=lambda s: s.encode("utf-8", "surrogatepass"))
    place = {s: k for k, s in enumerate(names)}
    total = np.zeros((len(names), 1), np.int64)
    for s, n in zip(totals["source"].to_pylist(), totals["n"].to_pylist()):
        total[place[s], 0] = n
    terms = cells["term"].combine_chunks().dictionary_encode()
    count = np.zeros((len(names), len(terms.dictionary)), np.int64)
    of = cells["source"].combine_chunks().dictionary_encode()
    rank = np.array([place[s] for s in of.dictionary.to_pylist()], np.int64)
    if len(cells):
        count[rank[np.asarray(of.indices)], np.asarray(terms.indices)] = cells["n"].to_numpy()
    out_a, out_b, out_v = [], [], []
    p = shares(count, total, totals["terms"][0].as_py()) if len(cells) else count
    for k in range(len(names) - 1):
        far = p[k] - p[k + 1 :]
        near = p[k] + p[k + 1 :]
        out_v.append((far * far // np.maximum(near, 1)).sum(axis=1))
        out_a += [names[k]] * (len(names) - k - 1)
        out_b += names[k + 1 :]
    value = np.concatenate(out_v) if out_v else np.empty(0, np.int64)
    lang = pa.array([table["lang"][0].as_py()] * len(value), pa.string())
    return pa.table([lang, pa.array(out_a, pa.string()), pa.array(out_b, pa.string()), value], names=["lang", "a", "b", "value"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    wide = (count + 2).cast("decimal(38,0)") * F.lit(1_000_000_000)
    return F.lit(1) + F.call_function("div", wide, (total + 2 * terms).cast("decimal(38,0)"))


def term_tallies(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, over all texts.

    Nulls in text, lang and source count as ''.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return plain.mapInArrow(_tallies, _TALLY_DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every occurring pair of language and source.

    Part ``pair`` tells how far each other source of the language is, part ``term`` which terms a source uses more
    than its language, the first ``top_terms`` of them.  A language keeps the terms found in ``min_docs`` of its
    documents; rows are documents, also where ids repeat.  Nulls count as '', further columns are ignored, an empty
    table gives no rows, and a source that is alone in its language has no ``pair`` rows.
    """
    by_term = Window.partitionBy("lang", "term")
    tallied = term_tallies(docs).select(
        "lang", "source", "term", "n", F.sum("docs").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("lang_n"), F.min("source").over(by_term).alias("_least")
    )
    kept = staged(
        tallied.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("_least")).alias("head")),
        "kept-terms",
    )
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("bigint")).alias("heads"))
    totals = occurring.join(per_source, ["lang", "source"], "left").na.fill(0, ["total", "heads"])
    per_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"), F.count("*").alias("sources"))
    totals = staged(totals.join(per_lang, "lang").select("lang", "source", "total", "lang_total", "terms", "sources"), "source-totals")

    p, q = F.col("p"), F.col("q")
    term = (
        kept.join(totals, ["lang", "source"])
        .select(
            "lang", "source", F.col("term").alias("item"),
            _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
        .filter(p > q)
        .select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    )

    langs = totals.select("lang", "terms", "sources").distinct()
    shards = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / _CELLS)).cast("int")
    cells = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"), "source", "term", "n", "terms")
    heads = totals.select(
        "lang", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms"
    )
    sums = cells.unionByName(heads).groupBy("lang", "shard").applyInArrow(lambda t: pair_sums(t.drop_columns("shard")), "lang string, a string, b string, value bigint")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pair = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    ranked = []
    for part, most in ((pair, None), (term, top_terms)):
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        part = part.withColumn("rank", rank)
        ranked.append(part.filter(F.col("rank") <= most) if most else part)
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
