from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from wordmine.llm import pii
from wordmine.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == 1:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == 2:
                d = [int(x) for x in digits[::-1]]
                total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
                ok = 13 <= len(d) <= 19 and total % 10 == 0
            elif kind == 3:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_against_plain_regexes():
    rng = random.Random(4)
    alphabet = "a.@-+ (1)20459é_%A"
    for _ in range(30000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "+1 " * 100_000, "1.2." * 80_000, "+1" + " " * 200_000):
        base = pii.base_spans(text)
        pii.added_spans([text], [base], pii.Field())


def graphs(texts):
    made = [pii.graph(t, pii.base_spans(t)) for t in texts]
    return [g[1:] for g in made]


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"


def test_labels_spread_to_repetitions():
    rng = random.Random(6)
    texts = []
    for _ in range(200):
        p = phone(rng)
        texts.append(f"call {p} or later {p} now, version {rng.randrange(9)}.0 of {rng.randrange(1000, 99999)} rows")
        m = f"bo.smith{rng.randrange(99)}@mail.example.com"
        texts.append(f"write to {m} or to {m} on {rng.randrange(2000)}")
    field = pii.fit_field(graphs(texts))
    p = phone(rng)
    text = f"call {p} first. Again: {p[3:]} and 17 times 4.0 or 20000 rows. Mail jo.doe@x.example.org, I am jo.doe there."
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], field)[0]
    assert {text[s:e] for _, s, e in added} == {p[3:].strip(), "jo.doe"}
    clean = "Version 3.0 has 12345 rows and 17 pages. See 10.5 and 1.2.3, or 4.0."
    assert pii.added_spans([clean], [[]], field) == [[]]
    assert pii.masked(text, base + added).count("<phone>") == 2


def test_labels_reach_fifty_repetitions():
    rng = random.Random(6)
    texts = []
    for _ in range(200):
        p = phone(rng)
        texts.append(f"call {p} or later {p} now, version {rng.randrange(9)}.0 of {rng.randrange(1000, 99999)} rows")
        m = f"bo.smith{rng.randrange(99)}@mail.example.com"
        texts.append(f"write to {m} or to {m} on {rng.randrange(2000)}")
    field = pii.fit_field(graphs(texts))
    p = phone(rng)
    far = " and so it goes on for a while with many words, of which none says anything"
    names = "Mail jo.doe@x.example.org." + (far + ", said jo.doe again") * 50
    calls = f"call {p} first." + (far + f": {p[3:]} it was") * 50
    for text, kind, value in ((names, 0, "jo.doe"), (calls, 3, p[3:].strip())):
        added = pii.added_spans([text], [pii.base_spans(text)], field)[0]
        assert [(k, text[s:e]) for k, s, e in added] == [(kind, value)] * 50


def card(rng):
    digits = "4" + "".join(rng.choices("0123456789", k=14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def test_planted_variants(spark):
    """Known values in other writings, among numbers that look alike but are others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    field = pii.fit(docs)
    rng = random.Random(9)
    plain_texts = [re.sub(r"[0-9@+]", "", r["text"]) for r in docs.limit(300).collect()]
    wanted = found = false = 0
    for k, filler in enumerate(plain_texts):
        words = filler.split() or ["so"]
        half = len(words) // 2
        p, c = phone(rng), card(rng)
        area = re.sub("[^0-9]", "", p)[1:]
        name = f"{rng.choice(['ana', 'bo', 'li'])}.{rng.choice(['lopez', 'weber', 'smith'])}{k}"
        first, again = [
            (f"call {p} now", rng.choice([area, f"{area[:3]} {area[3:6]} {area[6:]}", f"({area[:3]}) {area[3:]}"])),
            (f"pay with {c} please", ".".join(c[i : i + 4] for i in range(0, 16, 4))),
            (f"mail {name}@mail.example.com today", name),
        ][k % 3]
        # Neither a match nor a repetition of one: other numbers of these sizes.
        wrong = c[:-1] + str((int(c[-1]) + 1) % 10)
        noise = f"order {wrong} of {rng.randrange(10**9, 10**10)} parts, {rng.randrange(10**6)} rows"
        text = " ".join([*words[:half], first, *words[half:], "as said:", again, "and", noise])
        added = pii.added_spans([text], [pii.base_spans(text)], field)[0]
        got = [text[s:e] for _, s, e in added]
        wanted += 1
        found += again in got
        false += sum(x != again for x in got)
    assert found >= 0.9 * wanted and not false, (found, false, wanted)


def test_messages_settle_along_a_chain():
    field = pii.Field()
    known = np.array([3] + [0] * 30)
    log_node = pii._clamped(np.zeros((31, 5)), known)
    edges = np.array([(i, i + 1, 1) for i in range(30)])
    belief, _ = field.marginals(log_node, edges, settle=True)
    agree = np.exp(5.0) / (np.exp(5.0) + 4)
    step = agree - (1 - agree) / 4  # a tree, so beliefs are exact
    want = 0.2 + 0.8 * step ** np.arange(31)
    assert np.abs(belief[:, 3] - want).max() < 0.02


def test_query_and_mask(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = all_queries()["op2_personal_data"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == x for x, *_ in want) for k in range(4)]
        assert not joined or set(joined.split(",")) <= set(r["spans"].split(","))


def test_odd_tables(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a@b.cd", 5), (4, "x" * 90_000 + " 10.0.0.1", 5), (4, "10.0.0.1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    field = pii.fit(docs)
    got = {(r["doc_id"], r["spans"]) for r in pii.find(docs, field).collect()}
    assert got == {(1, ""), (2, ""), (None, "email:0:6"), (4, "ip:90001:90009"), (4, "ip:0:8")}
    out = pii.mask(docs, field)
    assert out.columns == docs.columns
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "", "<email>", "<ip>", "x" * 90_000 + " <ip>"]
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_numbers_with_thousands_of_digits(spark):
    texts = ["0" * 5000 + "1.1.1.1", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 4999 + "4", "1" * 20_000, "x 10.0.0.1"]
    found = [[s for s in pii.base_spans(t) if s[0] == 1] for t in texts]
    assert found == [[(1, 0, 5007)], [], [(1, 0, 5006)], [], [(1, 2, 10)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["n_ip"] for r in pii.find(docs, pii.fit(docs)).collect()}
    assert rows == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}
    assert "0000" not in pii.mask(docs, pii.fit(docs)).where("doc_id = 0").first()["text"]
