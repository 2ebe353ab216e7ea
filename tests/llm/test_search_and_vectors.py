"""Source divergence, near-duplicate vectors and ranked search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from embertrace.llm import max_sketch, source_divergence
from embertrace.llm.max_sketch import Search, ranked_documents
from embertrace.llm.quantised_tiles import Tiles, groups_of, near_vectors, products
from embertrace.llm.source_divergence import equal_runs, term_pointers

DOCS = "doc_id long, text string, lang string, source string, term string, n long, value string, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, letters="abcdeé", longest=4):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(5)
    rows = [(k, prose(rng, 60), ["en", "fr", None][k % 3], ["s1", "s2", "", None, "é"][k % 5]) for k in range(90)]
    rows += [(90, None, "en", "silent"), (91, "", "xx", "alone"), (92, "12 34 -- \n\t", "de", "a"), (93, "99", "de", "b")]
    rows += [(94, "Long" * 9000 + " tail", "en", "s1"), (95, "Long" * 9000 + "X tail", "en", "s1")] + [(96, "same Same SAME", "fr", "s2")] * 12
    rows += [(None, "x" * 200_000, None, None), (None, "x" * 200_000 + "y", None, None), (97, "NUL\x00in a_b-c'd ÀÉ", "en", "s2")]
    rows += [(98, "x" * 8 + " " + "x" * 16 + " " + "x" * 24, "en", "s1")] * 3
    return rows


def divergence(rows, min_docs=10):
    groups = defaultdict(Counter)
    found = defaultdict(Counter)
    for _, text, lang, source in rows:
        lang = lang or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang, source or ""].update(terms)
        found[lang].update(set(terms))
    out = []
    for lang in found:
        kept = [t for t, n in found[lang].items() if n >= min_docs]
        sources = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = share(sum(sources.values(), Counter()))
        p = {s: share(c) for s, c in sources.items()}
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, 10)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_divergence_against_brute_force(spark, odd_docs):
    got = source_divergence.source_divergence(documents(spark, odd_docs).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence(odd_docs)
    assert source_divergence.source_divergence(documents(spark, odd_docs).limit(0)).count() == 0
    # no term reaches the limit: pairs of value 0, no terms
    few = [(1, "a", "en", "u"), (2, "b", "en", "v"), (3, "c", None, "w")]
    assert sorted(map(tuple, source_divergence.source_divergence(documents(spark, few)).collect())) == divergence(few)


def test_small_shards_and_blocks_give_the_same(spark, odd_docs, monkeypatch):
    """Shards of a few texts, and blocks of a few terms, as a long text or a large vocabulary makes them."""
    monkeypatch.setattr(source_divergence, "_CELLS", 64)
    docs = documents(spark, odd_docs)
    langs = source_divergence.source_divergence(docs)
    assert sorted(map(tuple, langs.collect())) == divergence(odd_docs)
    batches = docs.na.fill("", ["text", "lang", "source"]).select("text", "lang", "source").coalesce(1)._collect_as_arrow()
    whole, parts = Counter(), Counter()
    for size, into in ((1 << 30, whole), (300, parts)):
        monkeypatch.setattr(source_divergence, "SHARD_BYTES", size)
        for b in source_divergence._tallies(batches):
            for r in b.to_pylist():
                into[r["lang"], r["source"], r["term"], "n"] += r["n"]
                into[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert whole == parts and whole["fr", "s2", "same", "docs"] >= 12


def test_pointer_sort_is_a_sort_by_bytes():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"ab", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 72, 200]))) for _ in range(3000)] + [b"a" * 500] * 5
    text = b" ".join(words)
    raw = np.frombuffer(text + b"\0" * 8, np.uint8)
    starts, lengths, owner = term_pointers(raw[:-8], np.array([0, 0, len(text), len(text)]))
    order, run = equal_runs(raw, starts, lengths)
    ordered = [words[k] for k in order]
    assert ordered == sorted(words) and set(owner) == {1}
    assert [ordered[k] == ordered[k - 1] for k in range(1, len(words))] == [run[k] == run[k - 1] for k in range(1, len(words))]
    # texts that touch in the buffer do not join their words
    assert [list(x) for x in term_pointers(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 2, 4]))] == [[0, 2], [2, 2], [0, 2]]
    assert [len(x) for x in equal_runs(np.zeros(8, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


VECTORS = "vec_id long, embedding array<float>, label int, kept string, vector string, links int"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in range(3):
        for _ in range(12):
            centre = rng.standard_normal(24)
            for _ in range(rng.integers(1, 9)):
                noise = rng.standard_normal(24) * rng.choice([0.05, 0.25, 0.38, 0.45])
                rows.append((k, [float(x) for x in (centre + noise).astype(np.float32)], int(label)))
                k += 1
    rows += [(k + n, rows[3][1], 0) for n in range(6)] + [(rows[5][0], rows[5][1], 0)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [-0.0] * 24, [nan] * 24, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0], [2.0], [-3.0], [1.0, 0.0], [1.0, -0.0], [1e-40] * 24, [3e38] * 24]
    rows += [(k + 10 + n, v, 1) for n, v in enumerate(odd)] + [(k + 40, rows[0][1], None), (k + 41, rows[0][1], None)]
    return rows


def linked(rows, limit):
    fit = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if fit(v, label) else None for _, v, label in rows]
    near = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = unit[a], unit[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= limit:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for a, (key, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            todo += [n for n in near[todo.pop()] if n not in seen and not seen.add(n)]
        first = min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)
        out.append((str(key), len(near[a]), str(first), key == first))
    return sorted(out)


@pytest.mark.parametrize("plan", [Tiles(), Tiles(rows=7), Tiles(cosine=0.5, rows=20), Tiles(cosine=0.99)])
def test_near_vectors_against_all_pairs(spark, odd_vectors, plan):
    got = near_vectors(vectors(spark, odd_vectors), plan)
    assert got.columns == ["vec_id", "embedding", "label", "vector", "links", "n_links", "component_id", "kept"]
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got.collect()) == linked(odd_vectors, plan.cosine)


def test_near_vectors_of_nothing_and_of_rows_without_ids(spark):
    assert near_vectors(vectors(spark, [])).count() == 0
    rows = [(None, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.1], 1), (None, [0.0, 1.0], 2)]
    got = near_vectors(vectors(spark, rows)).orderBy("label", "vec_id").collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(None, 2, 7, False)] * 2 + [(7, 2, 7, True), (None, 0, None, True)]


def test_a_common_vector_is_not_one_task(spark):
    """Beyond the broadcast bound, copies of one vector are answered by a broadcast of the heavy vectors only."""
    rows = [(k, [1.0, 0.0, 0.0], 1) for k in range(3000)] + [(3000 + k, [0.0, 1.0, float(k)], 1) for k in range(50)]
    got = near_vectors(vectors(spark, rows))
    by = Counter((r["n_links"], r["component_id"]) for r in got.collect() if r["vec_id"] < 3000)
    assert by == {(2999, 0): 3000}


def test_tile_parts():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-127, 128, (5, 3000)).astype(np.int8) for _ in range(2))
    a[0], b[0] = 127, 127
    assert (products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    chain = np.zeros((4, 4), bool)  # a2-b1, a2-b2, a1-b2: one component although no smallest neighbours meet
    chain[2, 1] = chain[2, 2] = chain[1, 2] = True
    group = groups_of(chain)
    assert list(group) == [-1, 1, 1, -1, -1, 1, 1, -1]


def search(docs, items, top=50):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    found = [(key, Counter(words(text))) for key, text, _, _ in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(words(text))
    out = []
    for item, terms in asked.items():
        hits = []
        for (key, c), size in zip(found, sizes):
            m = 100 - 50 + 50 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                hits.append((-score, key is None, key or 0, key))
        out += [(item, k, key, -score) for k, (score, _, _, key) in enumerate(sorted(hits)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.choice([1, 5, 60, 400]), "abcdefg1é"), "en", "s") for k in range(300)]
    rows += [(300, None, "en", "s"), (301, " -- ", "en", "s"), (302, "a" * 5000 + " b", "en", "s"), (303, "Z9", "en", "s"), (None, "z9 z9", "en", "s")]
    rows += [(400 + k, "equal words here", "en", "s") for k in range(70)] + [(304, "z9 b", "en", "s")] * 2
    return rows


ITEMS = [(1, "a b c d e f g ab ba cab"), (2, "EQUAL words"), (3, None), (4, "..."), (5, "unseen thing"), (6, "z9"), (7, "é 1 gg fa"), (7, "bad dab"), (None, "b")]


@pytest.mark.parametrize("rule", [Search(), Search(items=2, bits=3, step=2), Search(top=1, bits=2)])
def test_search_against_brute_force(spark, corpus, rule):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_documents(documents(spark, corpus).repartition(5), items, rule)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == search(corpus, ITEMS, rule.top)


def test_search_of_nothing(spark, corpus):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_documents(documents(spark, []), items).count() == 0
    assert ranked_documents(documents(spark, corpus[:5]), items.limit(0)).count() == 0
    assert ranked_documents(documents(spark, [(1, None, "en", "s")]), items).count() == 0


def test_bounds_hold_and_spare_work(corpus):
    """No bound lies below a score, and far fewer documents are scored than the table has."""
    queries = max_sketch.Queries([(k, t) for k, t in ITEMS[:2]])
    texts = [r[1] for r in corpus]
    sizes = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for t in texts]
    weights = np.full(len(queries.terms), 3000)
    searcher = max_sketch.Searcher(queries, max_sketch.Corpus(weights, sum(s > 0 for s in sizes), sum(sizes)), Search(top=3, step=4))
    asked = []
    exact = searcher.scores
    searcher.scores = lambda doc, *rest: asked.append(len(doc)) or exact(doc, *rest)
    for first, n, owner, hashes in max_sketch._tokens(texts):
        searcher.read(np.arange(first, first + n), n, owner, hashes)
    assert sum(asked) < len(texts)
    assert sorted(Counter(searcher.best.item).values()) == [3, 3]
