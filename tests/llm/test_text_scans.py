"""Spans of personal data and secrets: kernels against plain patterns, layers, disclosure, odd rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embertrace.llm import pii, secret_scan

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
HEX = re.compile(r"[0-9a-f]+")


@given(st.text(alphabet="a.@-%é 1\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_mail_addresses_are_those_of_the_pattern(text):
    expected = [(m.start(), m.end()) for m in EMAIL.finditer(text)]
    assert [(a, b) for k, a, b, _ in pii.entities(text) if k == "email"] == expected


@given(st.text(alphabet="0129. -+(", max_size=40))
@settings(max_examples=400, deadline=None)
def test_addresses_cards_and_phones_are_those_of_the_patterns(text):
    expected = [(m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found = pii.entities(text)
    assert [(a, b) for k, a, b, _ in found if k == "ip"] == expected
    cards = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    digits = [[int(c) for c in m[0] if c.isdigit()] for m in cards]
    right = [12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0 for d in digits]
    assert [(a, b) for k, a, b, _ in found if k == "card"] == [(m.start(), m.end()) for m, r in zip(cards, right) if r]
    phones = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert [(a, b) for k, a, b, _ in found if k == "phone"] == [(m.start(), m.end()) for m in phones]


@given(st.text(alphabet="abf09g AKIZ:='tokenſ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_plain_secrets_are_those_of_the_patterns(text):
    found = secret_scan.direct(text)
    assert [(a, b) for k, a, b in found if k == "hex"] == [(m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    assert [(a, b) for k, a, b in found if k == "access"] == [
        (m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20
    ]


SECRET = "password = hunter2hunter2"


def nested(text):
    return [(x["kind"], x["start"], x["end"], x["layers"]) for x in secret_scan.scan(text) if x["kind"].startswith("nested")]


def test_layers_are_unwrapped_and_mapped():
    url = quote(SECRET, safe="")
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    plain64 = base64.b64encode(SECRET.encode()).decode()
    zipped = base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode()
    twice = base64.b64encode(plain64.encode()).decode()
    for inner, layers in ((url, "url"), (escaped, "unicode"), (plain64, "base64"), (zipped, "base64+compressed"), (twice, "base64>base64")):
        text = f"é before {inner} after"
        ((kind, start, end, path),) = nested(text)
        assert (kind, path) == ("nested-assign", layers)
        assert 9 <= start < end <= 9 + len(inner)
    assert nested(f"x {quote(plain64 + '=%', safe='')}%41 y")  # base64 inside a percent-encoded run
    start = len("see ")
    ((_, a, b, _),) = nested(f"see {url}&more=1")
    assert (a, b) == (start, start + len(url))


def test_equal_parts_are_found_at_every_place():
    url = quote(SECRET, safe="")
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    plain64 = base64.b64encode(SECRET.encode()).decode()
    twice = base64.b64encode(plain64.encode()).decode()
    for inner in (url, escaped, plain64, twice):
        text = f"a {inner} b {inner}\nc {inner}"
        found = nested(text)
        assert len(found) == 3
        for (_, a, b, _), start in zip(found, (m.start() for m in re.finditer(re.escape(inner), text))):
            assert start <= a < b <= start + len(inner)
    both = base64.b64encode(f"{plain64} and {plain64}".encode()).decode()
    assert len({(a, b) for _, a, b, _ in nested(f"x {both} y")}) == 2


def test_base64_over_lines_and_out_of_step():
    prose = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:7] for k in range(60))
    for raw in (f"{prose} {SECRET} {prose}".encode(), gzip.compress(f"{prose} {SECRET}".encode(), mtime=0)):
        blob = base64.b64encode(raw).decode()
        for width in (64, 76):
            for brk in ("\n", "\r\n", "\n  "):
                lines = brk.join(blob[k : k + width] for k in range(0, len(blob), width))
                text = f"see:\n{lines}\nafter this"
                ((kind, a, b, _),) = nested(text)
                assert kind == "nested-assign" and 5 <= a < b <= 5 + len(lines)
                values = [x["value"] for x in secret_scan.scan(text)]
                assert values == [SECRET]
    for inner in (SECRET.encode(), gzip.compress(SECRET.encode(), mtime=0)):
        blob = base64.b64encode(inner).decode()
        for before in ("io/", "a-", "ab_", "https://example.io/path/", "x" * 13 + "/"):
            found = [x for x in secret_scan.scan(before + blob) if x["value"] and x["value"].startswith(SECRET)]
            assert found and found[0]["start"] >= before.rfind("/") - len(before) and found[0]["end"] <= len(before + blob)


def test_members_and_long_streams_are_read_to_the_end():
    two = gzip.compress(b"nothing here", mtime=0) + gzip.compress(SECRET.encode(), mtime=0)
    assert [x[0] for x in nested(base64.b64encode(two).decode())] == ["nested-assign"]
    small = secret_scan.Limits(decoded_chars=1000, longest=4000)
    for k in (0, 400, 985, 995, 4000):
        long = base64.b64encode(gzip.compress(("é" * k + f" {SECRET} " + "zé " * 3000).encode(), mtime=0)).decode()
        assert [x["kind"] for x in secret_scan.scan(long, small)] == ["nested-assign"] + ["unfinished"] * (k == 4000)


def test_pieces_find_what_the_whole_content_shows():
    """Streams read in pieces of a few hundred bytes, with secrets and encoded blocks at every border."""
    rng = random.Random(6)

    def word():
        kind = rng.random()
        if kind < 0.04:
            return rng.choice([SECRET, "AKIA" + "Z" * rng.randint(16, 90), "".join(rng.choices("0123456789abcdef", k=rng.randint(24, 200)))])
        if kind < 0.06:
            return base64.encodebytes(f"some words and a {SECRET} {rng.random()}".encode()).decode().strip()
        if kind < 0.08:
            return quote(f"token={rng.random()}x{'y' * rng.randint(1, 99)}", safe="")
        return "".join(rng.choices("klmnop é", k=rng.randint(1, 12)))

    found = lambda x: sorted((f["kind"], f["start"], f["end"]) for f in x)
    for _ in range(25):
        content = "".join(word() + rng.choice([" ", "\n", "\r\n"]) for _ in range(300))
        packed = "see " + base64.b64encode(gzip.compress(content.encode(), mtime=0)).decode() + " end"
        for size in (150, 400, 1000):
            small = secret_scan.Limits(decoded_chars=size, overlap=size // 4, longest=1 << 20)
            assert found(secret_scan.scan(packed, small)) == found(secret_scan.scan(packed))
            raw = base64.b64decode(packed[4:-4])
            pieces = [t for t, split in secret_scan._streams(raw, small) if not split]
            plain = lambda t: {(k, t[a:b]) for k, a, b in secret_scan.direct(t)}
            assert set().union(*map(plain, pieces)) >= plain(content)
            assert len(pieces) > len(content) // (8 * size)


def test_a_long_stream_takes_little_memory():
    """Eighty megabytes of words and forty of one endless word, inflated from texts of some hundred kilobytes."""
    code = """
import base64, resource, sys, zlib
sys.path.insert(0, sys.argv[1])
from embertrace.llm import secret_scan
for part, size in ((b"some plain words and so on " * 4000, 80_000_000), (b"z" * 100_000, 40_000_000)):
    packer = zlib.compressobj(9)
    packed = b"".join(packer.compress(part) for _ in range(size // len(part))) + packer.flush()
    text = base64.b64encode(packed).decode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    secret_scan.scan(text)
    print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
"""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert max(map(int, out.stdout.split())) < 400


def test_layers_end():
    assert secret_scan.scan("%25" * 50 + "41") == []
    assert [x["kind"] for x in secret_scan.scan("A" * 4000)] == []
    bomb = base64.b64encode(gzip.compress(b"z" * 100_000, mtime=0)).decode()
    assert [x["kind"] for x in secret_scan.scan(bomb, secret_scan.Limits(decoded_chars=1000, longest=4000))] == ["unfinished"]


def test_secret_spans_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "token: abcdef", 3), (None, "token: abcdef", 3), (4, "x " * 50_000 + SECRET, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    found = secret_scan.secret_spans(df).collect()
    assert [len(r["secrets"]) for r in found] == [0, 0, 1, 1, 1]
    assert found[4]["secrets"][0]["start"] == 100_000
    assert secret_scan.secret_spans(df.limit(0)).count() == 0


def test_terms_that_disclose_an_entity(spark):
    filler = ["alpha bravo charlie delta echo", "golf hotel india juliet kilo", "lima mike november oscar papa"]
    rows = [(k, f"{filler[k % 3]} word{k} something other", None) for k in range(60)]
    rows += [(100 + k, f"{filler[k % 3]} Zebrafish contact zoe@example.com today {k} times", "x") for k in range(4)]
    rows += [(200, None, None), (201, "", None), (None, "mail a@b.cd now", None), (None, "mail a@b.cd now", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.disclosure_spans(docs)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["spans"]])
    assert sum(map(len, by_id.values())) == len(rows)
    assert by_id[200] == [[]] and by_id[201] == [[]] and len(by_id[None]) == 2
    text = rows[60][1]
    kinds = {text[a:b]: k for k, a, b in by_id[100][0]}
    assert kinds["zoe@example.com"] == "email" and kinds["Zebrafish"].startswith("term") and "alpha" not in kinds
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(found.filter("doc_id is not null")).collect()}
    assert "Zebrafish" not in clean[100] and "[EMAIL]" in clean[100] and clean[200] is None and clean[5] == rows[5][1]
    assert pii.disclosure_spans(docs.limit(0)).count() == 0


def test_terms_are_found_despite_copies_and_far_from_the_entity(spark):
    rows = [(k, f"word{k} something other plain text number {k}") for k in range(300)]
    far = " ".join(f"filler{k}" for k in range(20))
    rows += [(1000 + k, f"Zebrafish contact zoe@example.com today item{k} {far} again Zebrafish there{k}") for k in range(5)]
    rows += [(2000 + k, rows[300][1]) for k in range(200)]
    rows += [(3000, "a Zebrafish alone, zebrafish@example.org not as a term")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.disclosure_spans(docs)
    text = dict(rows)
    terms = {r["doc_id"]: [text[r["doc_id"]][x["start"] : x["end"]] for x in r["spans"] if x["kind"].startswith("term")] for r in found.collect()}
    assert all(terms[k].count("Zebrafish") == 2 for k in (*range(1000, 1005), *range(2000, 2200)))
    assert terms[3000] == ["Zebrafish"] and terms[5] == []
    assert not any("Zebrafish" in r["text"] for r in pii.sanitised(found).collect())
    blocks = pii.disclosure_spans(docs, pii.Disclosure(terms=2))
    assert sorted(blocks.select("doc_id", "spans").collect()) == sorted(found.select("doc_id", "spans").collect())


def disclosed(texts, rule):
    """Shares of all pairs, and the spans of every text, straight from the definition."""
    distinct = set(texts)
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t or "")} for t in distinct}
    named = {t: pii.entities(t or "") for t in distinct}
    n_e, n_et = Counter(), Counter()
    for t in distinct:
        own = {e for _, _, _, e in named[t]}
        n_e.update(own)
        free = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t or "") if not any(a < m.end() and b > m.start() for _, a, b, _ in named[t])]
        pairs = set()
        for _, a, b, e in named[t]:
            near = [w for x, w in free if x < a][-rule.reach :] + [w for x, w in free if x >= b][: rule.reach]
            pairs |= {(e, w) for w in near if len(w) >= rule.min_letters}
        n_et.update(pairs)
    n, best = len(distinct), {}
    for (e, w), both in n_et.items():
        n_t = sum(w in words[t] for t in distinct)
        if both >= rule.support and n_e[e] < n:
            share = math.log(n * both / (n_e[e] * n_t)) / math.log(n / n_e[e])
            if share >= rule.generalise_at:
                best[w] = max(best.get(w, (0, "")), (share, e))
    spans = {}
    for t in distinct:
        own = [(k, a, b) for k, a, b, _ in named[t]]
        for m in re.finditer(r"[^\W_]+", t or ""):
            if m[0].lower() in best and not any(a < m.end() and b > m.start() for _, a, b, _ in named[t]):
                own.append(("term-removed" if best[m[0].lower()][0] >= rule.remove_at else "term", m.start(), m.end()))
        spans[t] = sorted(own, key=lambda x: (x[1], (*pii.KINDS, "term", "term-removed").index(x[0])))
    return best, spans


def test_shares_and_spans_against_brute_force(spark):
    rng = random.Random(8)
    people = [(f"p{k}@mail.example", f"name{k}", f"town{k % 4}") for k in range(12)]
    texts = [" ".join(rng.choices([f"plain{n}" for n in range(60)], k=rng.randint(3, 30))) for _ in range(150)]
    for mail, name, town in people:
        for _ in range(rng.randint(2, 9)):
            some = rng.choices([f"plain{n}" for n in range(60)], k=rng.randint(4, 20)) + [f"{name.title()} of {town} ({mail})"]
            rng.shuffle(some)
            texts.append(" ".join(some) + rng.choice(["", f" and {name}", f" +49 30 1234567 {town}", " 10.0.0.1 " + name]))
    texts += [texts[-1]] * 40 + [None, None, "", f"{people[0][1]} alone", "x" * 100_000]
    rows = [(k if k % 9 else None, t, 1, "a", "b", "c", "d", "e") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near int, entities string, more string, _found string, text_id string, spans string").repartition(3)
    for rule in (pii.Disclosure(), pii.Disclosure(terms=3, support=2, generalise_at=0.5)):
        best, spans = disclosed(texts, rule)
        assert len(best) > 5
        terms = pii.disclosing(docs, rule).groupBy("term").agg(F.max("disclosure").alias("d")).collect()
        assert {r["term"]: round(r["d"], 9) for r in terms} == {w: round(x, 9) for w, (x, _) in best.items()}
        found = pii.disclosure_spans(docs, rule)
        assert found.columns == ["doc_id", "text", "near", "entities", "more", "_found", "text_id", "spans"]
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            assert [(x["kind"], x["start"], x["end"]) for x in r["spans"]] == spans[r["text"]]
