"""Chat formatting of reply trees, with DataFrame functions only.

Messages name the message that they answer. Paths from a root to a leaf are found by iterative
self-joins that double the known stretch of ancestors each time, so a chain of n messages takes
log2(n) joins, not n. A branch is ranked by the sum of its messages' scores; each chosen path is
formatted as one conversation.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every
``<``, any backslashes, ``|`` gets one backslash more before the bar, so no control string occurs
there, and taking that backslash away again restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def reply_paths(messages: DataFrame, top: int | None = None, max_depth_log2: int = 40) -> DataFrame:
    """``(tree, leaf, rank, score, depth, id)``: the messages of each root-to-leaf path.

    ``messages`` has ``tree, id, parent, score``; ``id`` is unique and ``parent`` null at a root. A
    parent that is not there makes its message a root. Paths of a tree are ranked by total score,
    ties by leaf; ``top`` keeps the best so many of each tree, None all. Messages on a cycle reach no
    root and raise.
    """
    own = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = own.select(F.col("id").alias("parent"))
    rooted = stored(
        own.join(known.withColumnRenamed("parent", "found"), F.col("parent") == F.col("found"), "left")
        .select("tree", "id", F.col("found").alias("up"), "score"), "messages")
    # Each row knows its ancestor `up` at distance 2**k and the score and depth of what lies below it.
    # A row that has reached its root is done and is not joined again, so short chains cost few rows
    # however long the longest one is.
    step = rooted.select("tree", "id", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"))
    total, jumps = stored(step, "ancestors-0"), []
    for k in range(max_depth_log2):
        climbing = total.where("up is not null")
        if climbing.isEmpty():
            break
        jumps.append(climbing.select("id", "up"))
        lower, upper = climbing.alias("l"), total.alias("u")
        moved = stored(
            lower.join(upper, F.col("l.up") == F.col("u.id")).select(
                "l.tree", "l.id", F.col("u.up").alias("up"), (F.col("l.sum") + F.col("u.sum")).alias("sum"),
                (F.col("l.depth") + F.col("u.depth")).alias("depth"),
            ), f"ancestors-{k + 1}")
        total = total.where("up is null").unionByName(moved)
    else:
        raise ValueError("a reply cycle has no root")
    inner = rooted.select(F.col("up").alias("id")).where("id is not null").distinct()
    leaves = total.join(inner, "id", "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("sum"), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    # From the leaf upwards: what stands at a distance of 2**k of what is known is known next.
    path = stored(ranked.select("tree", F.col("id").alias("leaf"), "rank", F.col("sum").alias("score"), "id"), "path-0")
    for k, jump in enumerate(reversed(jumps)):
        path = path.unionByName(stored(
            path.join(jump, "id").select("tree", "leaf", "rank", "score", F.col("up").alias("id")), f"path-{k + 1}"))
    return path.join(total.select("id", "depth"), "id").select("tree", "leaf", "rank", "score", "depth", "id")


def format_paths(turns: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of ``by``: ``formatted`` and its loss ``mask``.

    ``turns`` has ``depth, role, text``; null role or text is empty. The mask has an entry for each
    turn: where the turn begins, and the start and length (code points of ``formatted``) of what a
    loss is taken on in it, the text of an assistant turn or nothing. The running length is a window
    over the turns of one conversation, which have to be one row in the end anyway.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    cut = turns.select(
        *by, "depth", F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("loss"),
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    so_far = Window.partitionBy(*by).orderBy("depth", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(so_far), F.lit(0)))
    mask = F.struct(
        F.col("at").alias("turn"), (F.col("at") + F.length("head")).alias("start"),
        F.when(F.col("loss"), F.length("body")).otherwise(0).cast("long").alias("length"),
    )
    rows = placed.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("depth", "at", "piece", mask.alias("mask")))).alias("turns"))
    return rows.select(
        *by, F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["mask"]).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text), and ``loss_texts``, read from ``formatted`` and ``mask``.

    Turns are cut at the end marks, which texts cannot hold, and each is read by itself, so the work
    is linear in the length.
    """
    ended = F.split("formatted", r"<\|im_end\|>\n")
    body_at = F.lit(len(OPEN) + 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, body_at, F.length(piece))
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return formatted.withColumn("_pieces", F.slice(ended, F.lit(1), F.size(ended) - 1)).withColumns({
        "turns": F.transform("_pieces", turn),
        "loss_texts": F.zip_with("_pieces", "mask", lambda p, m: unescape(
            F.substring(p, (m["start"] - m["turn"] + 1).cast("int"), m["length"].cast("int")))),
    }).drop("_pieces")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before (ties by role and text)."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(in_order))
    return numbered.select(
        F.col("conv_id").alias("tree"), F.struct("conv_id", "n").alias("id"),
        F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n"))).alias("parent"),
        F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text",
    )


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """``(tree, leaf, rank, score, formatted, mask)``: a row per chosen path of ``reply_paths``."""
    paths = reply_paths(messages, top)
    turns = paths.join(messages.select("id", "role", "text"), "id")
    return format_paths(turns, ["tree", "leaf", "rank", "score"])
