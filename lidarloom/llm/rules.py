"""Quality rules as weak supervision: rules vote, EM weighs them, a posterior decides (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
ROUNDS = 20
#: Bounds of an estimated accuracy and of the share of good documents; a rule is never taken to be worse than chance.
ACCURACY = (0.55, 0.98)
PRIOR = (0.05, 0.95)


def held(value: Column, use) -> Column:
    """use(value), with value worked out once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(ws: Column) -> Column:
    """How many words stand in 5-word windows that the text has twice or more; windows are told apart by 64-bit hash."""
    starts = F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def covered(at: Column) -> Column:
        # sorted starts of repeated windows: each adds the words up to the next start, at most WINDOW
        ends = F.transform(at, lambda x, k: F.when(k + 1 < F.size(at), F.least(F.lit(WINDOW), F.get(at, k + 1) - x)).otherwise(WINDOW))
        return F.aggregate(ends, F.lit(0).cast("int"), lambda s, x: s + x)

    def repeated(pairs: Column) -> Column:
        same = lambda k, m: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, m)["h"], F.lit(False))
        marked = F.transform(pairs, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["k"]))
        return held(F.sort_array(F.array_compact(marked)), covered)

    def ranked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(held(pairs, repeated))

    return F.when(F.size(ws) < WINDOW + 1, 0).otherwise(held(hashes, ranked)).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_shouts, n_stops, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    stats = F.struct(
        held(words(text), of_words).alias("w"),
        held(lines, of_lines).alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without(CAPITALS).cast("long").alias("n_capitals"),
        without("!").cast("long").alias("n_shouts"),
        without(".,;:?").cast("long").alias("n_stops"),
    )
    names = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_capitals": "n_capitals", "n_shouts": "n_shouts", "n_stops": "n_stops"}
    out = docs.drop(*names, "base_failed").withColumn("__s", stats)
    out = out.withColumns({k: F.col(f"__s.{v}") for k, v in names.items()}).drop("__s")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Most only speak up against a text; two vouch for plain prose."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(n == 0, F.lit(-1)).when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)

    symbols, shouts, stops = F.col("n_symbols"), F.col("n_shouts"), F.col("n_stops")
    return {
        "symbol_words": vote(10 * symbols > n, 50 * symbols <= n),
        "symbol_chars": vote(33 * symbols > chars, 200 * symbols <= chars),
        "symbols_over_stops": vote((symbols > stops) & (20 * symbols > n)),
        "capitals": vote(10 * F.col("n_capitals") > 4 * chars, 10 * F.col("n_capitals") <= chars),
        "shouts": vote(5 * shouts > n),
        "shouts_over_stops": vote((shouts > stops) & (20 * shouts > n)),
        "word_length": vote((chars > 30 * n) | (chars < 2 * n)),
        "stops": vote((n >= 50) & (stops == 0) | (stops > 2 * n)),
        "dup_lines": vote(2 * F.col("n_dup_lines") > F.col("n_lines")),
        "repeats": vote(100 * F.col("n_repeat_words") > 15 * n),
    }


def label_model(patterns: DataFrame, k: int) -> DataFrame:
    """(votes array<int>, n) -> votes, posterior. EM for one share of good documents and one accuracy a rule.

    There are at most 3 ** k patterns however many documents there are, so they fit in one row, where the rounds run.
    """
    gather = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("x"))
    post = "1 / (1 + exp(-(ln(s.p / (1 - s.p)) + aggregate(zip_with(y.votes, s.a, (v, a) -> v * ln(a / (1 - a))), 0D, (t, z) -> t + z))))"
    e_step = f"transform(x, y -> named_struct('votes', y.votes, 'n', cast(y.n as double), 'g', {post}))"
    total = lambda value: f"aggregate(e, 0D, (t, y) -> t + {value})"
    bounded = lambda value, lo, hi: f"least({hi}D, greatest({lo}D, {value}))"
    p = bounded(f"{total('y.n * y.g')} / greatest({total('y.n')}, 1D)", *PRIOR)
    right = total("y.n * case y.votes[j] when 1 then y.g when -1 then 1 - y.g else 0D end")
    cast = total("y.n * abs(y.votes[j])")
    a = f"transform(sequence(0, {k - 1}), j -> {bounded(f'coalesce({right} / nullif({cast}, 0D), 0.8D)', *ACCURACY)})"
    m_step = f"transform(array({e_step}), e -> named_struct('p', {p}, 'a', {a}))[0]"
    start = f"named_struct('p', 0.8D, 'a', array_repeat(0.8D, {k}))"
    model = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {m_step})"
    weighed = gather.withColumn("s", F.expr(model)).selectExpr("explode(" + e_step + ") as y")
    return weighed.select(F.col("y.votes").alias("votes"), F.col("y.g").alias("posterior"))


#: What judged() adds to a row.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_stops", "base_failed", "posterior", "kept")


def judged(slim: DataFrame, threshold: float) -> DataFrame:
    """slim: stored base statistics, and no column called votes, posterior or kept -> slim plus JUDGED's last two."""
    rules = votes()
    d = slim.withColumn("votes", F.array(*rules.values()))
    patterns = stored(d.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    model = F.broadcast(label_model(patterns, len(rules)))  # at most 3 ** rules rows
    out = d.join(model, "votes", "left").drop("votes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def weak_supervision(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs plus the base statistics, base_failed, posterior and kept.

    kept is false where the base rule fails, and else whether the posterior of good quality reaches threshold.
    Null text counts as empty: no words, base_failed. Columns of docs that are called like one of JUDGED are replaced;
    all others pass through, whatever their names. Repeated rows are judged alike; an empty table gives no rows.
    """
    d = docs.select(F.struct("*").alias("__row"), F.col("text").cast("string").alias("text"))
    out = judged(stored(base_statistics(d).drop("text")), threshold)
    keep = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in JUDGED]
    return out.select(*keep, *JUDGED)


def rule_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior; texts are read
    once. Nulls, repeated rows and empty tables as in weak_supervision(); other columns don't take part."""
    out = judged(stored(base_statistics(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")), threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that weak_supervision() keeps, with docs' own columns as they were. Texts are judged once.

    Null, empty and short texts fail the base rule and go. Repeated rows stay or go together; null ids are judged like
    others; an empty table gives no rows. Columns of docs may have any names.
    """
    d = docs.select(F.struct("*").alias("__row"), F.col("text").cast("string").alias("text"))
    return judged(stored(base_statistics(d).drop("text")), threshold).filter("kept").select("__row.*")
