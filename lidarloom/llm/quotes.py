"""Chat formatting by quotation linking (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A quoted line: a mark, and more marks with or without blanks between.
MARKS = r"^[ \t]*>(?:[ \t]*>)*"
UNITS = "array<struct<level:int,lines:array<int>,wide:boolean,h1:bigint,h2:bigint>>"
#: Words of a window.
WINDOW = 5


def level(line: Column) -> Column:
    """Nesting of a line: how many > it starts with, blanks among them left out; 0 for the writer's own lines."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(text: Column) -> Column:
    """Lower case, one blank between words, no marks: what a line keeps however it is quoted."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, MARKS, "")), r"[\s\p{Z}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """What a message's passages are matched by: conv_id, turn, message, level, line, wide, h1, h2.

    A passage is a run of lines of one level, blank ones left out; its words are joined, so where lines break doesn't
    matter. Units are each window of WINDOW words of a passage (wide), a passage of fewer words, and each line. A unit
    has a row for each line that it touches.
    """
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1)
    lines = F.filter(F.transform(raw, lambda x, k: F.struct(k.alias("line"), level(x).alias("level"), F.split(normalised(x), " ").alias("words"))), lambda x: x["words"][0] != "")
    spread = F.flatten(F.transform(lines, lambda x: F.transform(x["words"], lambda w: F.struct(w.alias("w"), x["level"].alias("level"), x["line"].alias("line")))))

    def unit(part: Column, wide: bool) -> Column:
        said = F.array_join(part["w"], " ")
        return F.struct(part[0]["level"].alias("level"), F.array_distinct(part["line"]).alias("lines"), F.lit(wide).alias("wide"), F.xxhash64(said).alias("h1"), F.xxhash64(F.reverse(said)).alias("h2"))

    def of_level(part: Column) -> Column:
        return F.size(F.array_distinct(part["level"])) == 1

    def windows(words: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.slice(words, i, WINDOW))
        return F.transform(F.filter(parts, lambda x: (F.size(x) == WINDOW) & of_level(x)), lambda x: unit(x, True))

    def short(words: Column) -> Column:
        """Passages of fewer words than a window: the words after a change of level up to the next."""
        parts = F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 2)["level"] != F.get(words, i - 1)["level"])), lambda i: F.slice(words, i, WINDOW))
        # words of the level that come back after others within the slice are of a later passage
        whole = F.transform(parts, lambda x: F.slice(x, 1, F.coalesce(F.nullif(F.array_position(F.transform(x["level"], lambda v: v == x[0]["level"]), False), F.lit(0)) - 1, F.size(x)).cast("int")))
        return F.transform(F.filter(whole, lambda x: F.size(x) < WINDOW), lambda x: unit(x, False))

    # an array of one binds the words, so that they are made once and not for each window
    joined = F.flatten(F.transform(F.array(spread), lambda ws: F.when(F.size(ws) > 0, F.concat(windows(ws), short(ws)))))
    single = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), F.array(x["line"]).alias("lines"), F.lit(False).alias("wide"), F.xxhash64(F.array_join(x["words"], " ")).alias("h1"), F.xxhash64(F.reverse(F.array_join(x["words"], " "))).alias("h2")))
    units = messages.select("conv_id", "turn", F.xxhash64("text").alias("message"), F.explode(F.concat(F.coalesce(joined, F.array().cast(UNITS)), single)).alias("u"))
    return units.select("conv_id", "turn", "message", "u.level", F.explode("u.lines").alias("line"), "u.wide", "u.h1", "u.h2")


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines numbered in `gone` (null: as it is, byte for byte), each with one blank line after it; what
    is left of a text that ends with such a line doesn't end with blank lines."""
    lines = F.split(text, "\n", -1)

    def kept(ls: Column) -> Column:
        blank = lambda x: F.length(F.trim(F.translate(x, "\r\t", "  "))) == 0
        own = F.filter(F.transform(ls, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains(gone, s["k"]) & ~(blank(s["x"]) & F.array_contains(gone, s["k"] - 1)))
        said = F.array_join(own["x"], "\n")
        return F.when(F.array_contains(gone, F.size(ls) - 1), F.regexp_replace(said, r"\s+$", "")).otherwise(said)

    return F.when(gone.isNull(), text).otherwise(F.transform(F.array(lines), kept)[0])


def linked_lines(messages: DataFrame) -> DataFrame:
    """Quoted lines and the message of the same conversation that first said them.

    conv_id, turn, message (hash of the text), level, line, source_turn. What a message quotes at level n is looked up among the own words (level
    0) of the conversation's earlier messages, however either is wrapped. A line comes from the message that most
    windows over it were first said in, so a stray equal line goes with its passage; a line or short passage that no
    window links comes from the first message that said it. Both sides are reduced to one row for each conversation and
    hash before they meet, so a line said a thousand times is one row. Conversations without quotes take no part.

    Null text quotes and says nothing; rows without conv_id or turn link to nothing. Rows that repeat a conversation's
    turn count together. Texts may be of any length. An empty table gives no rows; other columns don't take part.
    """
    quoting = messages.filter(F.coalesce("text", F.lit("")).rlike("(?m)" + MARKS)).select("conv_id").distinct()
    p = passages(messages.join(quoting, "conv_id", "left_semi"))
    said = p.filter("level = 0").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("source_turn"))
    quoted = p.filter("level > 0").select("conv_id", "turn", "message", "level", "line", "wide", "h1", "h2").distinct()
    met = quoted.join(said, ["conv_id", "h1", "h2"]).filter(F.col("source_turn") < F.col("turn"))
    line = ["conv_id", "turn", "message", "level", "line"]
    found = met.groupBy(*line, "source_turn").agg(F.count_if("wide").alias("n"))
    first = found.groupBy(*line).agg(F.max(F.struct("n", (-F.col("source_turn")).alias("t"))).alias("b"))
    return first.select(*line, (-F.col("b.t")).alias("source_turn"))


def quote_links(lines: DataFrame) -> DataFrame:
    """linked_lines() -> conv_id, turn, level, source_turn, n_lines."""
    return lines.groupBy("conv_id", "turn", "level", "source_turn").agg(F.count(F.lit(1)).alias("n_lines"))


def linked_conversations(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a message: conv_id, turn, role, text without the quotes that link, n_quoted,
    n_linked, parent_turn, root_turn, depth. Quoted lines that link to nothing stay, since nothing else holds them, and
    texts of which no line links stay byte for byte.

    The parent is the message that the outermost quotes (the lowest level that links) come from, by most lines, then
    the later one. Messages that quote nothing known start threads. (conv_id, root_turn, depth, turn) is the reply
    order. Roots are found by doubling: each round joins on the parent's parent, so chains of length n take log n.

    Null conv_id or turn: the message passes through without a parent. Null text counts as empty. Repeated (conv_id,
    turn) rows all stay and share links. Other columns don't come along.
    """
    m = messages.select("conv_id", "turn", "role", F.col("text"))
    lines = stored(linked_lines(m))
    links = quote_links(lines)
    best = links.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (-F.col("n_lines")).alias("n"), (-F.col("source_turn")).alias("t"))).alias("b"), F.sum("n_lines").alias("n_linked")
    )
    parents = stored(best.select("conv_id", "turn", (-F.col("b.t")).alias("parent_turn"), "n_linked"))
    # (at, hops): how far up each reply has come; only replies take part
    state = parents.select("conv_id", "turn", F.col("parent_turn").alias("at"), F.lit(1).alias("hops"))
    for _ in range(max_rounds):
        up = state.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        step = stored(state.join(up, ["conv_id", "at"], "left"))
        moved = step.filter(F.col("next").isNotNull()).limit(1).count()
        state = step.select("conv_id", "turn", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        if not moved:
            break
    found = parents.join(state, ["conv_id", "turn"])
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1)
    own = m.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("message"), F.size(F.filter(split, lambda x: level(x) > 0)).cast("long").alias("n_quoted"))
    gone = lines.groupBy("conv_id", "turn", "message").agg(F.collect_set("line").alias("gone"))  # lines of one text
    own = own.join(gone, ["conv_id", "turn", "message"], "left").withColumn("text", without_lines(F.col("text"), F.col("gone")))
    out = own.join(found, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn",
        F.coalesce("at", "turn").alias("root_turn"), F.coalesce("hops", F.lit(0)).cast("long").alias("depth"),
    )
