"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Sources up to which tables with a row a source are broadcast; beyond it they are joined by shuffles.
FEW = 10_000
#: A document's expected copies grow with this root of its size; weights are whole, so that sums don't depend on order.
ROOT_UNITS = 1000
#: Slices of a source's rank order; only the slice that holds the cut is looked at row by row.
SLICES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources weigh weights in turn, by code point, null last. Targets share the total by weight; a target stops at
    max_copies times its source's size and what is over goes to the rest by weight. That is water filling: sources
    reach their ceiling in the order of ceiling per weight, so prefix sums over that order find the level at which
    the rest share what is left. One row a source; the windows run over sources, never over documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    by_ceiling = Window.orderBy((F.col("ceiling") / F.col("w")), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sizes.withColumn("w", w)
        .withColumn("ceiling", F.col("source_size").cast("double") * max_copies)
        .withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") * F.col("w") > F.col("ceiling") * F.col("w_left"))
        .withColumn("rate", F.min(F.when(~F.col("full"), F.struct(F.col("ceiling") / F.col("w"), F.col("source").isNull(), "source", (F.col("left") / F.col("w_left")).alias("rate")))).over(whole)["rate"])
    )
    return level.select("source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("w")).alias("target"))


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) fixed by the id: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def weight(size: Column) -> Column:
    """The square root of the size in whole thousandths: a long document is worth more copies, less than in proportion."""
    return F.round(F.sqrt(size.cast("double")) * ROOT_UNITS).cast("long")


def rates(by_size: DataFrame, plan: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """by_size (source_key, size, n), plan (source_key, target) -> source_key, rate: expected copies of a document are
    rate * weight, at most max_copies, and bring its source's words to the target.

    Water filling over a source's different sizes, the largest first: with the larger ones at max_copies, the rest
    shares what is left of the target by weight; the first size that then stays below max_copies gives the rate.
    """
    larger = Window.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    exact = lambda c: c.cast("decimal(20,0)")
    d = by_size.filter("size > 0").join(plan.select("source_key", "target"), "source_key").withColumn("w", weight(F.col("size")))
    full = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0)).cast("double")
    open_ = F.sum(exact(F.col("w") * F.col("size")) * exact(F.col("n"))).over(rest).cast("double")
    d = d.withColumn("rate", (F.col("target") - max_copies * full) / open_)
    return d.filter(F.col("rate") * F.col("w") <= max_copies).groupBy("source_key").agg(F.max_by("rate", "size").alias("rate"))


def keyed(df: DataFrame) -> DataFrame:
    """A join key for source that null has too."""
    return df.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))


def chances(d: DataFrame, plan: DataFrame, max_copies: int, seed: str) -> DataFrame:
    """d (doc_id, size, source_key) plus its source's plan, sure: the whole copies, p: the inclusion probability of one
    more, and odds: random odds over inclusion odds, by which the sample ranks; slice of that order. Without a chance
    (p = 0) the odds are null."""
    d = d.join(plan, "source_key").withColumn("expected", F.least(F.lit(float(max_copies)), F.coalesce("rate", F.lit(1e300)) * weight(F.col("size"))))
    d = d.withColumns({"sure": F.floor("expected").cast("int"), "u": uniform(F.col("doc_id"), seed)}).withColumn("p", F.col("expected") - F.col("sure"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    return d.withColumn("slice", F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * SLICES), F.lit(SLICES - 1)).cast("int"))


def sampled(d: DataFrame, weights: tuple[int, ...], max_copies: int, seed: str):
    """d: stored (doc_id, source, size) of all documents -> a function that adds source_size, target and copies to rows
    with doc_id, source and size, by joins with tables of a row a source."""
    keys = keyed(d)
    by_size = stored(keys.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = keyed(source_targets(sizes, weights, max_copies)).select("source_key", "source_size", "target")
    plan = stored(plan.join(rates(by_size, plan, max_copies), "source_key", "left"))
    few = plan.count() <= FEW
    small = lambda df: F.broadcast(df) if few else df

    # the words that the sample is to bring, beyond the copies for certain
    sure = F.floor(F.least(F.lit(float(max_copies)), F.coalesce("rate", F.lit(1e300)) * weight(F.col("size")))).cast("long")
    certain = by_size.join(small(plan), "source_key").groupBy("source_key").agg(F.max("target").alias("target"), F.sum(F.when(F.col("size") > 0, sure * F.col("size") * F.col("n")).otherwise(0)).alias("words"))
    need = stored(certain.select("source_key", F.greatest(F.round(F.col("target") - F.col("words")).cast("long"), F.lit(0)).alias("need")))
    full_plan = stored(plan.join(need, "source_key"))

    # words by slice of the ranking are summed first, so only the slice with the cut is looked at row by row
    ranked = chances(keys, small(full_plan), max_copies, seed)
    by_slice = ranked.filter(F.col("odds").isNotNull()).groupBy("source_key", "slice").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    in_source = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        by_slice.withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
        .filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")) & (F.col("need") > 0))
        .groupBy("source_key")
        .agg(F.min_by(F.struct("slice", "before"), "slice").alias("c"))
        .select("source_key", F.col("c.slice").alias("cut_slice"), F.col("c.before").alias("cut_before"))
    )
    cut = stored(cut)
    inside = ranked.join(small(cut), "source_key").filter(F.col("odds").isNotNull() & (F.col("slice") == F.col("cut_slice")))
    in_cut = Window.partitionBy("source_key").orderBy("odds", "size", "doc_id")
    inside = inside.withColumn("upto", F.col("cut_before") + F.sum("size").over(in_cut.rowsBetween(Window.unboundedPreceding, 0)))
    # the cut: the last document that fits whole, and the words still open after it
    last = (
        inside.withColumn("place", F.row_number().over(in_cut))
        .groupBy("source_key")
        .agg(F.max(F.when(F.col("upto") <= F.col("need"), F.struct("place", "odds", "size", "doc_id", "upto"))).alias("at"), F.max("need").alias("need"), F.max("cut_before").alias("cut_before"), F.max("cut_slice").alias("cut_slice"))
        .select("source_key", "cut_slice", F.col("at.odds").alias("at_odds"), F.col("at.size").alias("at_size"), F.col("at.doc_id").alias("at_id"), (F.col("need") - F.coalesce(F.col("at.upto"), F.col("cut_before"))).alias("open"))
    )
    last = stored(last)

    def drawn(rows: DataFrame) -> DataFrame:
        return taken_upto(chances(keyed(rows), small(full_plan), max_copies, seed), small(last)).withColumn("gap", F.abs(F.col("size") - F.col("open")))

    # one document more where that brings the sum nearer: the best fit among all that the sample has not taken
    fit = (
        drawn(d).filter((F.col("extra") == 0) & (F.col("open") > 0) & F.col("odds").isNotNull() & (F.col("gap") < F.col("open")))
        .groupBy("source_key")
        .agg(F.min(F.struct("gap", "odds", "size", "doc_id")).alias("fit"))
        .select("source_key", F.col("fit.odds").alias("fit_odds"), F.col("fit.size").alias("fit_size"), F.col("fit.doc_id").alias("fit_id"))
    )
    fit = stored(fit)

    def with_copies(rows: DataFrame) -> DataFrame:
        out = drawn(rows).join(small(fit), "source_key", "left")
        is_fit = (F.col("odds") == F.col("fit_odds")) & (F.col("size") == F.col("fit_size")) & F.col("doc_id").eqNullSafe(F.col("fit_id"))
        copies = F.when(F.col("size") > 0, F.col("sure") + F.greatest(F.col("extra"), F.coalesce(is_fit.cast("int"), F.lit(0)))).otherwise(0)
        return out.withColumn("copies", F.least(copies, F.lit(max_copies)).cast("int"))

    return with_copies


def taken_upto(d: DataFrame, last: DataFrame) -> DataFrame:
    """Adds extra: 1 for documents that rank before their source's cut, or at it."""
    out = d.join(last, "source_key", "left")
    at = F.struct(F.col("odds"), F.col("size"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    upto = F.struct(F.col("at_odds"), F.col("at_size"), F.coalesce(F.col("at_id"), F.lit(-(2**63))))
    before = F.col("slice") < F.col("cut_slice")
    inside = (F.col("slice") == F.col("cut_slice")) & F.col("at_odds").isNotNull() & (at <= upto)
    return out.withColumn("extra", F.when((F.col("need") <= 0) | F.col("cut_slice").isNull() | F.col("odds").isNull(), 0).when(before | inside, 1).otherwise(0))


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document; the text is read and counted once."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, size, source, source_size, target, copies, taken.

    A document's expected number of copies grows with the square root of its size, is max_copies at most, and is such
    that its source's words come to the target. Its whole part is allocated for certain; the rest is the inclusion
    probability p of a Pareto order sample: documents are ranked by random odds over inclusion odds,
    (u / (1 - u)) / (p / (1 - p)), and taken in that order until the source's rest is reached, so the sample's size
    in words is fixed. Where the next document would overshoot, the last place goes to the document, of all that are
    left, whose size is nearest to what is still open, if taking it brings the sum nearer. Documents stay whole.

    Null text: size 0, nothing to take. Null source: a source of its own, last in order. Empty table: no rows. Rows
    with the same doc_id draw the same number; equal ranks go by size, then to the smaller id, and rows alike in all of
    these are taken or left together. Other columns of docs don't matter.
    """
    d = stored(slim(docs))
    out = sampled(d, weights, max_copies, seed)(d)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, each as often as its copies say, with the same columns.

    Copies follow from a row's id, source and size and tables of a row a source, so texts are not shuffled. Nulls,
    repeated ids and empty tables as in pareto_mix(): a null text is never taken, null ids are drawn as one id, and an
    empty table gives no rows. Columns of docs may have any names.
    """
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    out = sampled(stored(slim(docs)), weights, max_copies, seed)(rows).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
