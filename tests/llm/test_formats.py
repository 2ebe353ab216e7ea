"""Preference pairs, token records and language identification."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embertrace.llm import byte_cnn, records
from embertrace.llm.preference import Template, _ranked, conversations_of, formatted, sibling_pairs
from embertrace.session import setting

CODING = records.Coding(public_tokenizers.path("byte_bpe_50k.json"), batch=3)


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_pairs_share_their_prompt(spark):
    talks = {}
    for k in range(9):
        talks[k] = [("user", "hello"), ("assistant", "hi"), ("user", f"q{k % 3}"), ("assistant", "long " * k)]
    talks[20] = [("user", "alone"), ("assistant", "yes")]
    talks[21] = [("system", None), (None, "other"), ("assistant", "no")]
    rows = [(c, n, r, t) for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (20, 1, "assistant", "yes")]  # a conversation without id, a repeated turn
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks[20] += [("assistant", "yes")]
    talks[21] = [("system", ""), ("user", "other"), ("assistant", "no")]
    talks[None] = [("user", "no id")]
    for template in (Template(), Template(piece_rows=2)):
        got = formatted(sibling_pairs(conversations_of(turns), template), template).collect()
        ids = Counter(x for r in got for x in (r["chosen_id"], r["rejected_id"]))
        assert len(got) == 6 and sum(ids.values()) == 12 and all(ids[k] == 1 for k in talks if k is not None) and ids[None] == 1
        siblings = [r for r in got if r["chosen_id"] in range(9) and r["rejected_id"] in range(9)]
        assert len(siblings) == 4
        for r in got:
            a, b = talks[r["chosen_id"]], talks[r["rejected_id"]]
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, rendered(a[:n]), rendered(a[n:]), rendered(b[n:]))
            score = lambda t: sum(len(x) for role, x in t if role == "assistant")
            assert score(a) >= score(b)
            for side, mask, left in ((r["chosen"], r["chosen_mask"], a[n:]), (r["rejected"], r["rejected_mask"], b[n:])):
                at, learned = 0, []
                for run in filter(None, mask.split(",")):
                    flag, length = run.split(":")
                    if flag == "1":
                        learned.append(side[at : at + int(length)])
                    at += int(length)
                assert at == len(side) and learned == [t + "<|end|>\n" for role, t in left if role == "assistant"]
    assert formatted(sibling_pairs(conversations_of(turns.limit(0)))).count() == 0


def test_a_conversation_left_over_has_no_rejected_side(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = formatted(sibling_pairs(conversations_of(turns))).collect()
    assert len(got) == 2 and sum(r["rejected_id"] is None for r in got) == 1


def test_a_common_opening_is_ordered_in_pieces(spark):
    """Two thousand conversations of one first turn: each piece of them is a group of its own for the shuffle."""
    template = Template(piece_rows=100)
    first = F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text"))
    talks = spark.range(2000).select(
        F.col("id").cast("string").alias("name"), F.col("id").alias("conv_id"), F.array(first).alias("turns"),
        F.when(F.col("id") < 1990, "hot").otherwise(F.col("id").cast("string")).alias("opening"), F.lit(0).cast("bigint").alias("score"),
        F.lit("mine").alias("piece"), F.lit(1).alias("n"),
    )
    ranked = _ranked(talks.select("name", "opening"), template)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [opening" in plan and "piece" in plan
    rows = ranked.collect()
    assert sorted(r["place"] for r in rows if r["opening"] == "hot") == list(range(1990))
    with setting(spark, "spark.sql.adaptive.enabled", "false"):  # which would put such small pieces together again
        pieces = _ranked(talks.select("name", "opening"), template).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in pieces) < 1000
    pairs = sibling_pairs(talks, template).collect()
    assert len(pairs) == 1000 and all(r["rejected"] is not None for r in pairs)


def test_pairs_of_odd_rows(spark):
    rows = [(1, 0, "user", "x" * 200_000), (1, 1, "assistant", None), (2, 0, "user", "x" * 200_000), (2, None, None, None), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clash = turns.withColumns({"prompt": F.lit("p"), "opening": F.lit("o"), "name": F.lit("n"), "pair_id": F.lit(1)})
    got = formatted(sibling_pairs(conversations_of(clash)))
    assert got.count() == 2 and got.columns == formatted(sibling_pairs(conversations_of(turns))).columns
    assert formatted(sibling_pairs(conversations_of(clash.limit(0)))).count() == 0


@pytest.fixture(scope="module")
def model():
    return records.WordEncoder(CODING)


ODD = ["", " a", "a  b", "a\n\nb", "a\n b", "a \nb", "x y", "it's they'll 'tis", "<|endoftext|> x", "\n", "é à\tb", "a\r\nb", "a\x85b c", "日本 語\nです", "\x1c a"]


@given(st.text(alphabet="aé1.' \n\t  日", max_size=30))
@settings(max_examples=300, deadline=None)
def test_word_encoder_equals_the_tokenizer(text):
    encoder = test_word_encoder_equals_the_tokenizer.__dict__.setdefault("encoder", records.WordEncoder(CODING))
    fresh = test_word_encoder_equals_the_tokenizer.__dict__.setdefault("fresh", Tokenizer.from_file(CODING.tokenizer))
    values = [text, *ODD, text + " " + text]
    wanted = [fresh.encode(value, add_special_tokens=False).ids + [2] for value in values]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(values)] == wanted
    assert fresh.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    fresh = Tokenizer.from_file(CODING.tokenizer)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé1.'", k=rng.randint(1, 9))) for _ in range(300)]
    texts = ["".join(rng.choice(words) + rng.choice(" \n") for _ in range(400)) + "end" for _ in range(6)]
    texts += ["x" * 500, "a b" + "y" * 300 + "\nz", texts[0] + "  two", "", " ", texts[1] + "<|endoftext|>"]
    for part, memo in ((50, 10_000), (7, 10_000), (1 << 21, 40), (100, 1)):
        monkeypatch.setattr(records, "_PART", part)
        encoder = records.WordEncoder(records.Coding(CODING.tokenizer, memo=memo))
        for _ in range(2):
            got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
            assert got == [fresh.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_records_round_trip(spark, model, tmp_path):
    rows = [(5, "five words are in here"), (None, "no id"), (None, None), (2, ""), (2, ""), (9, "long " * 20_000), (1, "first\nline")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/records"
    files = records.write_records(docs, folder, CODING)
    assert sum(f.records for f in files) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for seed in (None, 4):
        got = sorted(records.read_records(spark, folder, files, seed).collect(), key=lambda r: r["start"])
        assert [r["id"] for r in got] == [r[0] for r in ordered]
        start = 0
        texts = defaultdict(list)
        for k, t in rows:
            texts[k].append(model.model.encode(t or "", add_special_tokens=False).ids + [2])
        for r in got:
            crcs = {zlib.crc32(np.array(ids, "<u4").tobytes()): len(ids) for ids in texts[r["id"]]}
            assert r["start"] == start and crcs[r["ids_crc32"]] == r["n_tokens"]
            start += r["n_tokens"]
    assert records.write_records(docs.limit(0), folder, CODING) == []
    assert records.read_records(spark, folder, []).count() == 0


def test_damage_is_noticed():
    import io

    frame = records.framed(b"payload")
    assert records.unframed(io.BytesIO(frame).read) == b"payload"
    for at in range(len(frame)):
        broken = bytearray(frame)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed(io.BytesIO(bytes(broken)).read)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_cnn.identify_languages(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog are here " * 9, "en"), (2, "der hund und die katze sind hier " * 9, "de"), (3, None, "en"), (5, "123 ...", None)]
    rows += [(None, "the cat is here with the dog", None), (None, "", None), (7, "der hund ist hier " * 3000, None), (1, rows[0][1], "en")]
    rows += [(k, rows[k % 2][1], rows[k % 2][2]) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    shape = byte_cnn.Shape(steps=150)
    got = byte_cnn.identify_languages(docs, shape).collect()
    assert len(got) == len(rows)
    assert [r["lang_pred"] for r in got[:7]] == ["en", "de", "und", "und", "en", "und", "de"]
    assert byte_cnn.identify_languages(docs.limit(0), shape).count() == 0
    assert {r["lang_pred"] for r in byte_cnn.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")), shape).collect()} == {"und"}
