"""The five stages against what plain Python finds in their inputs and outputs."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({"kept": F.lit("mine"), "block": F.lit(1), "hits": F.lit(2), "n_words": F.lit(3)})
    held = [extra]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, held[-1], SF).write.parquet(path)
        held.append(spark.read.parquet(path))
    return [x.collect() for x in held]


def test_each_stage_keeps_what_it_should(spark, stages):
    raw, good, distinct, clean, mixed, sharded = stages
    columns = set(raw[0].asDict())
    for rows in (good, distinct, clean, mixed):
        assert set(rows[0].asDict()) == columns and all(r["kept"] == "mine" and r["block"] == 1 for r in rows)
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(good) < ids(raw) and all(len(r["text"].split()) >= 50 for r in good)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [r for r in raw if len(r["text"].split()) >= 50 and quality.get(r["doc_id"]) == 1]
    assert ids(long) <= ids(good)

    sets = {r["doc_id"]: shingles(r["text"]) for r in good}
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert sorted(r["doc_id"] for r in distinct) == sorted(set(label.values()))

    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in distinct if any(x in " ".join(r["text"].lower().split()) for x in items)}
    assert holds and ids(clean) == ids(distinct) - holds

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) == ids(clean) and set(times.values()) <= {1, 2}

    assert Counter(r["doc_id"] for r in sharded) == times
    sizes = Counter(r["shard"] for r in sharded)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in sharded if r["shard"] == s) == list(range(n))


def test_near_copies_of_eighty_percent_go(spark):
    """Copies with 80 to 85 of 100 shingles shared, which the contract's limit of the operator's own query would keep."""
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    rows, near = [], 0
    for k in range(30):
        text = words(300)
        copy = text[:]
        for at in rng.sample(range(0, 300, 12), 7):
            copy[at] = "x" + copy[at]
        a, b = shingles(" ".join(text)), shingles(" ".join(copy))
        near += 100 * len(a & b) < 85 * len(a | b)
        assert 100 * len(a & b) >= 78 * len(a | b)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        if 100 * len(a & b) < 80 * len(a | b):
            rows.pop()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF).collect()}
    assert near and kept == {2 * k for k in range(30)}


def test_stages_take_odd_rows(spark):
    text = " ".join(random.Random(1).choices("the of and to in that it is was for".split(), k=400))
    rows = [(None, text, "en", None, 1), (None, text, "en", None, 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, text, None, "a", 1), (3, text, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        counts[name] = stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert counts["near duplicates"] == 5 and counts["benchmark decontamination"] == 6 and counts["sharding"] == 6
    assert counts["mixing"] >= 6
