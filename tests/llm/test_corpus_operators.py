"""Quality, near-duplicates, decontamination, mixing, sharding against brute force, laws and odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrace.llm.components import components
from embertrace.llm.latent import benchmark_hits, common_subsequence, place_masks
from embertrace.llm.mixing import Mix, source_plan, temperature_mix
from embertrace.llm.odd_sketch import Plan, near_duplicates
from embertrace.llm.quality import distance, quality_rules
from embertrace.llm.sharding import Deal, hypergeometric, hypergeometric_shards, shard_plan
from embertrace.llm.staging import unit

SCHEMA = "doc_id long, text string, lang string, source string, kept string, shard int"


def prose(seed, n):
    rng = random.Random(seed)
    common = "the of and to in that it is was for".split()
    return [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeinorstlm", k=rng.randint(3, 9))) for _ in range(n)]


def text(seed, n=120):
    return " ".join(prose(seed, n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white, tiny and long texts, repeated rows, null keys, and names that results use."""
    rows = [
        (1, None, "en", "a", "x", 1), (2, "", "en", "a", "x", 1), (3, " \n\t ", None, None, "x", 1), (4, "Word", "en", None, None, None),
        (5, text(1, 20_000), "en", "a", "x", 1), (6, text(2), "en", "b", "x", 1), (6, text(2), "en", "b", "x", 1),
        (None, text(3), "en", "b", "x", 1), (None, text(3), None, "b", "x", 1), (7, text(2), "xx", "b", "x", 1), (8, "Word", None, "a", "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_quality_of_odd_rows(spark, odd):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(isinstance(r["kept"], bool) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [by[k][0]["n_words"] for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 20_000]
    assert all(by[k][0]["base_failed"] and not by[k][0]["kept"] for k in (1, 2, 3, 4))
    assert by[6][0] == by[6][1] and by[5][0]["kept"] and by[None][0]["kept"] == by[None][1]["kept"]
    assert quality_rules(odd.limit(0)).count() == 0
    assert quality_rules(odd.filter("lang is null")).filter("word_distance is not null").count() == 0


def test_divergent_documents_are_rejected(spark):
    rows = [(k, text(100 + k), "en", "a", None, None) for k in range(40)]
    rows += [(90, " ".join(w + "&&&%%%" for w in prose(5, 100)), "en", "a", None, None)]
    rows += [(91, " | ".join("".join(random.Random(k).choices("qwxzk", k=9)) for k in range(150)), "en", "a", None, None)]
    rejected = {r["doc_id"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).filter("not kept").collect()}
    assert rejected == {90, 91}


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def shingles(value):
    words = (value or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = prose(family, 150)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(150)] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b", "A  b", "a", "", None, "A b c d e"])]
    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        k: (len(sets[k]), label[k], label[k] == k) for k, _ in rows
    }


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert got[(None, None, True)] == 2 and got[(6, 6, True)] == 2 and got[(7, 6, False)] == 1 and got[(8, 4, False)] == 1
    assert near_duplicates(odd.limit(0)).count() == 0


def test_sketch_limits():
    assert Plan().samples == 180 and (1 - 0.85**6) ** 30 < 7e-7
    assert 30 < Plan().most_bits < 256


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_hypergeometric_law(spark):
    n, good, taken = 60, 25, 20
    draws = (
        spark.range(20_000)
        .select(hypergeometric(F.lit(float(n)), F.lit(float(good)), F.lit(float(taken)), unit(F.lit(1), "id")).alias("k"))
        .groupBy("k").count().collect()
    )
    seen = {r["k"]: r["count"] / 20_000 for r in draws}
    for k in range(21):
        expected = math.comb(good, k) * math.comb(n - good, taken - k) / math.comb(n, taken)
        assert abs(seen.get(k, 0) - expected) < 0.012


def test_shards_are_exact_and_uniform(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = hypergeometric_shards(docs, Deal(shards=7, block_rows=100)).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 5000 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    low = Counter(r["shard"] for r in rows if r["doc_id"] < 700)
    assert all(60 < low[s] < 145 for s in range(7))
    assert abs(np.corrcoef([r["doc_id"] for r in rows], [r["slot"] for r in rows])[0, 1]) < 0.06


def test_shards_of_odd_rows(spark, odd):
    rows = hypergeometric_shards(odd).collect()
    assert len(rows) == odd.count() and max(Counter(r["shard"] for r in rows).values()) == 1
    assert sorted(rows[0].asDict()) == sorted(odd.columns + ["slot"])
    assert hypergeometric_shards(odd.limit(0)).count() == 0
    plan = {r["doc_id"]: r for r in shard_plan(odd).collect()}
    assert plan[1]["size"] == 1 and plan[1]["text_crc32"] == 0 and plan[4]["size"] == 5


def test_mixture_meets_its_targets(spark):
    rows = [(k, text(k, 30), None, "big" if k % 10 else ("small" if k % 20 else "tiny"), None, None) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    plan = {r["source"]: r for r in source_plan(docs, Mix(max_repeats=3.0)).collect()}
    assert {s: r["tokens"] for s, r in plan.items()} == tokens
    repeats = {s: r["repeats"] for s, r in plan.items()}
    assert abs(repeats["big"] - 1) < 1e-9 and abs(max(repeats.values()) - 3) < 1e-6
    level = [r for r in source_plan(docs, Mix(entropy=1.2)).collect()]
    assert abs(-sum(r["weight"] * math.log2(r["weight"]) for r in level) - 1.2) < 1e-6
    assert source_plan(docs, Mix(entropy=9.0)).first()["exponent"] == 0.0
    read = temperature_mix(docs, Mix(max_repeats=3.0, blocks=4, piece_rows=16)).collect()
    times = Counter(r["doc_id"] for r in read)
    assert set(times) == {r[0] for r in rows} and set(times.values()) <= {1, 2, 3}
    for s, plan_row in plan.items():
        got = sum(len(r["text"].split()) for r in read if r["source"] == s)
        assert plan_row["budget"] - 1e-6 <= got < plan_row["budget"] + 40
        by_block = Counter(r["block"] for r in read if r["source"] == s)
        assert set(by_block) == {0, 1, 2, 3} and max(by_block.values()) - min(by_block.values()) <= 4


def test_mixture_of_odd_rows(spark, odd):
    read = temperature_mix(odd).collect()
    assert Counter(r["doc_id"] for r in read).keys() == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert sum(r["doc_id"] == 6 for r in read) >= 2 and sum(r["doc_id"] is None for r in read) >= 2
    assert temperature_mix(odd.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(place_masks(a), b) == table[-1][-1]


def test_benchmark_passages_are_found(spark, odd):
    items = [(k, " ".join(prose(500 + k, 30 + k))) for k in range(20)]
    rng = random.Random(2)

    def loose(words, share):
        return [f"other{rng.random()}" if rng.random() < share else w for w in words]

    rows = [(k, text(900 + k, 400)) for k in range(60)]
    for k in range(20):
        around = prose(2000 + k, 300)
        rows.append((100 + k, " ".join(around[:150] + loose(items[k][1].split(), 0.0 if k % 2 else 0.12) + around[150:])))
    benchmark = spark.createDataFrame([*items, (None, "x y"), (77, None), (78, ""), (3, items[3][1])], "item_id long, text string")
    got = {r["doc_id"]: {h["item"] for h in r["hits"]} for r in benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {**{k: set() for k in range(60)}, **{100 + k: {k} for k in range(20)}}
    assert benchmark_hits(odd, benchmark).count() == odd.count()
    assert benchmark_hits(odd.limit(0), benchmark).count() == 0
    assert benchmark_hits(odd, benchmark.limit(0)).filter("size(hits) > 0").count() == 0


def test_passages_of_many_documents_and_of_common_words_are_found(spark):
    hot = " ".join(f"hot{k}" for k in range(30))
    rows = [(k, text(3000 + k, 300) + (f" {hot} " if k % 3 == 0 else " ") + text(4000 + k, 40)) for k in range(90)]
    asked = "was it for the that is"
    around = prose(5000, 200)
    rows += [(500, " ".join([*around[:95], asked, *around[95:]]))]
    benchmark = spark.createDataFrame([(1, hot), (2, asked)] + [(10 + k, " ".join(prose(700 + k, 30))) for k in range(5)], "item_id long, text string")
    got = {r["doc_id"]: {h["item"] for h in r["hits"]} for r in benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert {k for k, items in got.items() if 1 in items} == set(range(0, 90, 3))
    assert 2 in got[500] and sum(2 in items for items in got.values()) <= 4


def test_long_passages_are_found(spark):
    items = [(k, " ".join(prose(6000 + k, n))) for k, n in enumerate((40, 150, 400, 1500))]
    rows = [(k, " ".join([text(7000 + k, 200), passage, text(8000 + k, 200)])) for k, passage in items] + [(9, text(9000, 2000))]
    found = benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: [h["item"] for h in r["hits"]] for r in found.collect()} == {0: [0], 1: [1], 2: [2], 3: [3], 9: []}
