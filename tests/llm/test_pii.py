"""Personal data: base spans against the plain patterns, what the classifier adds, redaction, edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.llm import pii, queries

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """(start, kind, end) by the patterns as they are written down."""
    out = []
    for k, (name, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            if name == "email" or name == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or name == "card" and 14 <= len(d) <= 19 and luhn or name == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    parts = ["a", "@", ".", "-", "1", "23", "+1", "255", "256", "007", " ", "(", "4111111111111111", "0", "a@b.c", "1.2.3.4", "é", "+4915112345678"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert [s[:3] for s in pii.candidates(text) if s[3]] == plain(text)


@pytest.mark.parametrize("part", ["a", "1", "1.", "1 ", "+1", "a@", "a@b.", "(at)", "A1b2", "Mr ", "aB3:", "AB12"])
def test_long_texts_take_no_longer(part):
    start = time.perf_counter()
    pii.candidates(part * (400_000 // len(part)))
    assert time.perf_counter() - start < 5


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op13_weak_pii(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(",")) or not base


def made(n=300, seed=3):
    """Texts with known personal data: numbers that pass or fail the check digit, tokens and harmless long words."""
    r = random.Random(seed)
    words = "river stone window garden music paper light cloud".split()
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    texts, truth = [], []
    for i in range(n):
        kind = i % 6
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
        number = "".join(r.choice("0123456789") for _ in range(15))
        digit = next(c for c in "0123456789" if pii.luhn(number + c))
        good, bad = number + digit, number + str((int(digit) + 1 + r.randrange(9)) % 10)
        what = [("secret", f'token = "{hexa}"', hexa), ("card", f"{good}", good), (None, f"{bad}", ""), ("phone", "call (415) 555-2671 now", "(415) 555-2671"), (None, f"{r.choice(words)}-{r.randrange(9)}-{'-'.join(words[:4])}", ""), ("email", "write to jane.doe (at) example.org please", "jane.doe (at) example.org")][kind]
        before = say(5) + " "
        texts.append(before + what[1] + " " + say(5))
        at = texts[-1].find(what[2]) if what[0] else 0
        truth.append(f"{what[0]}:{at}:{at + len(what[2])}" if what[0] else "")
    return texts, truth


def test_classifier_on_known_spans(spark):
    texts, truth = made()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(d).collect()}
    right = sum(got[i] == t for i, t in enumerate(truth))
    assert right >= 0.95 * len(truth), [(texts[i], got[i], t) for i, t in enumerate(truth) if got[i] != t][:5]


def test_label_model_finds_what_labelers_are_worth():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    says = np.array([[0.95, 0.1], [0.99, 0.05], [0.9, 0.2], [0.6, 0.6], [0.9, 0.9], [0.8, 0.3], [0.95, 0.5]])
    cast = np.where(rng.random((20_000, 7)) < np.where(truth[:, None], says[:, 0], says[:, 1]), 1, -1)
    cast[rng.random(cast.shape) < 0.2] = 0
    rows, which, n = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    post, learned = pii.label_model(np.full(len(rows), pii.CARD), rows, n.astype(float))
    assert ((post[which] > 0.5) == truth).mean() > 0.97
    assert np.abs(learned[1, pii.CARD, :3] - says[:3, 0]).max() < 0.05 and np.abs(learned[0, pii.CARD, :3] - says[:3, 1]).max() < 0.08


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "mail a.b@c.de"), (3, "mail a.b@c.de"), (3, "mail a.b@c.de"), (4, "+1 (415) 555-2671 and 10.0.0.1, 4111 1111 1111 1111"), (5, "x" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("spans", "kind", "start", "pattern", "n_email", "base_sha256", "count")})
    out = pii.personal_data(d)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted((r.doc_id or 0, r.spans) for r in out.collect())
    assert got == [(0, "email:5:13"), (1, ""), (2, ""), (3, "email:5:13"), (3, "email:5:13"), (4, "phone:0:17,ip:22:30,card:32:51"), (5, "")]
    assert pii.personal_data(d.limit(0)).count() == 0
    done = pii.redacted(d)
    assert done.columns == d.columns and all(r["spans"] == "x" for r in done.collect())
    assert sorted((r.doc_id or 0, (r.text or "")[:60]) for r in done.filter("doc_id < 5 or doc_id is null").collect()) == [(0, "mail <email>"), (1, ""), (2, ""), (3, "mail <email>"), (3, "mail <email>"), (4, "<phone> and <ip>, <card>")]
    assert done.filter("doc_id = 1").first().text is None and pii.redacted(d.limit(0)).count() == 0
