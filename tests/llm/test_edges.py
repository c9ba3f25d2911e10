"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from lidarloom.llm import ann, archives, mixing, packing, quality, quotes, rules, simhash, suffixes, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"{w}{i}" for i in range(3000) for w in ("ab", "cd", "ef"))
ROWS = [
    (1, WORDS, "en", "s1", 10), (2, WORDS, "en", "s1", 10), (2, WORDS, "en", "s1", 10), (3, None, None, None, None), (4, "", "en", "s2", 0),
    (5, LONG, "en", "s2", 5), (6, "   \n\t ", "de", "s2", 5), (None, WORDS + ".", "de", "s3", 5), (None, None, None, None, None), (7, "one", "en", "s3", 3), (2, "other words than those of the row with one id", "en", "s3", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASH = ["size", "votes", "kept", "n_words", "fp", "doc", "dup", "u", "p", "need", "score", "quality", "part", "ids", "first", "url", "host", "v", "block", "__row", "posterior", "__v", "__id", "__copies", "__copy", "__uid", "copies", "odds", "rate", "target", "slice", "source_key", "n", "group", "root", "class", "band", "h", "__n", "dup", "doc", "grp", "n_chars_", "kept_", "base_failed", "size_"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    r = mixing.pareto_mix(docs).collect()
    assert len(r) == len(ROWS) and all(x.taken <= 3 * x.size for x in r)
    assert all(x["size"] == 0 and x.taken == 0 for x in r if x.doc_id in (3, 4, 6))
    assert mixing.pareto_mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert all(row[c] == "x" for row in mixed.collect() for c in CLASH)
    assert mixing.mixed_documents(none).count() == 0


def test_simhash(docs, none):
    r = simhash.near_duplicates(docs).collect()
    assert len(r) == len(ROWS)
    group = {x.component_id for x in r if x.fingerprint == "0" * 16}
    assert group == {3}
    assert {x.component_id for x in r if x.doc_id == 1} == {1}
    assert simhash.near_duplicates(none).count() == 0
    one = simhash.keep_one(docs)
    kept = one.collect()
    assert one.columns == docs.columns and sorted(x.doc_id for x in kept if x.text and x.text.startswith("alpha")) == [1]
    assert simhash.keep_one(none).count() == 0


def test_suffixes(docs, none):
    r = {(x.doc_id, x.n_bytes): x for x in suffixes.remove_repeats(docs).collect()}
    n = len(WORDS)
    assert r[(1, n)].n_removed == 0 and r[(2, n)].n_removed == n and r[(None, n + 1)].n_removed == n
    assert r[(3, 0)].n_removed == 0 and r[(4, 0)].n_bytes == 0
    assert suffixes.remove_repeats(none).count() == 0
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert sum(x.text is None for x in cut.collect()) == 2
    assert suffixes.cut_repeats(none).count() == 0


def test_packing(docs, none):
    r = packing.pack(docs).collect()
    assert sum(x.length for x in r if x.doc_id == 4) == 1 and sum(x.length for x in r if x.start == 0 and x.doc_id is None) > 1
    assert len({(x.sequence_id, x.offset) for x in r}) == len(r)
    assert packing.pack(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (7, 0), (4, None), (9, 5)], "doc_id long, quality int")
    r = quality.score_quality(docs, labels).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)
    assert {x.score for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0


def test_rules(docs, none):
    r = rules.rule_report(docs).collect()
    assert len(r) == len(ROWS) and not any(x.kept for x in r if x.doc_id in (3, 4, 6, 7))
    assert rules.keep_good(docs).columns == docs.columns
    assert rules.rule_report(none).count() == 0 and rules.keep_good(none).count() == 0
    judged = rules.weak_supervision(docs)
    assert judged.count() == len(ROWS) and judged.columns == [c for c in docs.columns if c not in rules.JUDGED] + list(rules.JUDGED)
    assert all(x["__v"] == x["__row"] == x["votes"] == "x" and isinstance(x.kept, bool) and 0 <= x.posterior <= 1 for x in judged.collect())
    assert all(x["posterior"] == "x" for x in rules.keep_good(docs).collect())


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nI have a list.", "x"), (1, 1, "assistant", "> How do I sort?\nUse sorted.", "x"), (1, 2, "user", ">> how  do I SORT?\n> Use sorted.\n\nThanks!", "x"),
        (1, 2, "user", ">> how  do I SORT?\n> Use sorted.\n\nThanks!", "x"), (1, 3, None, None, "x"), (None, None, "user", "> How do I sort?", "x"), (2, 0, "user", "", "x"), (2, 1, "user", "> never said", "x"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")
    r = quotes.linked_conversations(m).collect()
    by = {(x.conv_id, x.turn): x for x in r}
    assert len(r) == len(rows)
    assert by[(1, 1)].parent_turn == 0 and by[(1, 1)].text == "Use sorted."
    assert by[(1, 2)].parent_turn == 1 and by[(1, 2)].root_turn == 0 and by[(1, 2)].depth == 2 and by[(1, 2)].text == "Thanks!"
    assert by[(2, 1)].parent_turn is None and by[(2, 1)].n_quoted == 1 and by[(2, 1)].text == "> never said"
    assert quotes.linked_conversations(m.limit(0)).count() == 0


def test_urls_with_many_keys(spark):
    keys = "&".join(f"k{chr(97 + i)}=1" for i in range(20))
    rows = [(f"http://a.b.c.example.com/pills/{i}?{keys}", True) for i in range(20)] + [(f"http://a.b.c.example.com/news/{i}?{keys}", False) for i in range(20)]
    rows += [(f"ftp://a.b.c.example.com/news/{i}?{keys}&buy=1", i % 10 > 0) for i in range(40)]
    d = spark.createDataFrame(rows, "url string, bad boolean").withColumn("tokens", urls.tokens(F.col("url")))
    mined = urls.mine(d.select("tokens", "bad"))
    got = {tuple(r.antecedent): (round(r.confidence, 3), round(r.support, 3)) for r in mined.collect()}
    assert got[("path:pills",)] == (1.0, 0.25) and got[("scheme:ftp",)] == got[("key:buy",)] == (0.9, 0.45)
    assert got[("key:kt",)] == (0.7, 0.7) and not any(len(k) > 1 and "key:kt" in k for k in got)
    asked = spark.createDataFrame([(f"http://x.y.example.org/pills/1?{keys}&l=1&m=1&n=1",)], "key string").withColumn("tokens", urls.tokens(F.col("key")))
    assert [r.rule_confidence for r in urls.match(asked, mined).collect()] == [1.0]


def test_sure_pair_of_common_tokens(spark):
    rows = [(f"http://s.org/{'a' if i % 10 < 6 else 'c'}/{'b' if i % 10 in (0, 1, 2, 3, 6, 7) else 'd'}", i % 10 < 4) for i in range(100)]
    d = spark.createDataFrame(rows, "url string, bad boolean").withColumn("tokens", urls.tokens(F.col("url")))
    got = {tuple(r.antecedent): r.confidence for r in urls.mine(d.select("tokens", "bad")).collect()}
    assert got[("path:a", "path:b")] == 1.0 and set(got) == {("path:a", "path:b"), ("path:a",), ("path:b",)}


def test_classes_are_not_multiplied_out(spark):
    """Two classes of 40 tokens that are only together sure: 1,600 spelled rules of two, were they spelled out."""
    a, b = ("&".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}=1" for i in range(40)) for c in "pq")
    urls_ = [f"http://s.org/x?{a}&{b}"] * 30 + [f"http://s.org/x?{a}"] * 15 + [f"http://s.org/x?{b}"] * 15 + ["http://s.org/x"] * 30
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)] + [(900, "http://t.org/?paa=1&qbn=2"), (901, "http://t.org/?paa=1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 30 or i % 5 == 0 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    rules_, classes = urls.mine_classes(spark.createDataFrame([(u, i < 30 or i % 5 == 0) for i, u in enumerate(urls_)], "url string, bad boolean").select(urls.tokens(F.col("url")).alias("tokens"), "bad"))
    assert rules_.count() <= 4 and classes.count() >= 80
    judged = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert judged[900].rule_confidence == 1.0 and judged[900].verdict == "block" and judged[901].rule_confidence < 0.8


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/en/7x", "x"), (2, "https://COM/en/", "x"), (3, None, "x"), (4, "no scheme", "x"), (5, "http://b.example.net/de/8", "x"), (5, "http://b.example.net/de/8", "x"), (6, "http://x.net/de/8?q", "x"), (7, "http://xcom/en/", "x"), (None, "ftp://org/es/?a://b", "x")],
        "page_id long, url string, verdict string",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    r = {x.page_id: x for x in urls.judge(pages, labels).collect()}
    assert (r[1].rule, r[1].verdict) == ("example.com/en/7", "allow") and (r[2].host, r[2].rule, r[2].verdict) == ("com", "com/en/", "block")
    assert (r[3].host, r[3].path, r[3].rule, r[3].verdict) == ("", "", None, "allow") and r[4].host == ""
    assert r[5].rule == "example.net/de/8" and r[6].rule == "net/de/" and r[7].rule is None and r[None].rule == "org/es/"
    assert urls.judge(pages, labels).count() == 9
    assert urls.judge(pages.limit(0), labels).count() == 0
    assert urls.judge(pages, labels.limit(0)).count() == 9


def test_archives(spark):
    big = "x" * 200
    rows = [(2, "http://a/ b", big, 1), (1, None, big, 1), (1, None, big, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u\n", "y" * 99, 1), (6, "u", "y" * 99, 1), (None, "u", big, 1), (8, "u", "a\r\n\r\nWARC/1.1\r\n", 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    r = archives.convert_pages(p).collect()
    got = sorted((x.page_id if x.page_id is not None else 99, x.payload_bytes, x.record_type, x.refers_to) for x in r)
    assert got == [(1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None), (8, 15, "response", None), (99, 200, "revisit", 1)]
    assert archives.convert_pages(p.limit(0)).count() == 0


def test_ann(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x"), (20, [0.0, 0.0], "x"), (40, None, "x"), (60, [float("nan"), 1.0], "x"), (80, [1.0, None], "x"), (None, [1.0, 1.0], "x"), (100, [-1.0, 2.0], "x"), (3, [1.0, 2.0, 3.0], "x"), (120, [float("inf"), 1.0], "x"), (140, [], "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    r = ann.nearest(e, k=3).collect()
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in r}
    assert got == {(0, 1): (1, 0.5), (0, 2): (2, 0.5), (0, 3): (2, 0.5), (100, 1): (1, 0.5), (100, 2): (2, 0.5), (100, 3): (2, 0.5)}
    assert ann.nearest(e.limit(0)).count() == 0


def test_very_long_rows(spark):
    """A message, a URL and a page of some hundred thousand words or bytes."""
    said = " ".join(f"w{i}" for i in range(4000))
    quoted = "\n".join("> " + " ".join(f"w{i}" for i in range(k, k + 8)) for k in range(0, 4000, 8))
    m = spark.createDataFrame([(1, 0, "u", said), (1, 1, "u", quoted + "\nso be it")], "conv_id long, turn long, role string, text string")
    r = {x.turn: x for x in quotes.linked_conversations(m).collect()}
    assert r[1].parent_turn == 0 and r[1].n_linked == r[1].n_quoted == 500 and r[1].text == "so be it"
    url = "http://a.example.com/en/" + "/".join(f"seg{chr(97 + i % 26)}{'x' * (i % 50)}" for i in range(20000))
    pages = spark.createDataFrame([(k, url, None) for k in range(3)] + [(9, "http://b.org/de", "y" * 3_000_000), (10, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(0, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {x.page_id: x for x in urls.judge(pages, labels).collect()}
    assert judged[0].path == url[len("http://a.example.com") :] and judged[0].rule == "com/en/" and len(judged) == 5
    back = {x.page_id: x for x in archives.convert_pages(pages).collect()}
    assert (back[10].payload_bytes, back[10].record_type, back[10].refers_to) == (3_000_000, "revisit", 9)
