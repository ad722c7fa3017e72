"""Chat formatting: conversations as paths of reply trees, in one template with an exact loss mask.

Messages (tree, node, parent, role, text, score) form trees. Self-joins that double their reach at each
round give every message its depth and the score of the path that leads to it; a second walk over the
same rounds, from the widest reach to the narrowest, lists the messages of the chosen paths. A chain of n
messages takes log2(n) rounds each way. Only DataFrame functions are used.

Template: every message becomes ``### role: text</turn>`` and a line feed. In a text a backslash is
doubled, ``</turn>`` becomes ``<\\/turn>``, and of three ``#`` or more in a row each that starts such a
three is followed by a backslash; a role also has its colons escaped. So neither control string occurs in
a text, and leaving out each backslash (keeping the character behind it) gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table, sha256_hex

HEAD, END, TRAINED = "### ", "</turn>\n", "assistant"

KEYS = ("tree", "node", "parent", "role", "text", "score")


def escaped(text: Column) -> Column:
    """A text without control strings; null is empty."""
    made = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(made, "#(?=##)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def plain(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_chains(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Turns as messages: each answers the one before it in its conversation.

    Equal turns of a conversation come in the order of role and text, null turns first, and repeated rows
    stay; a null conversation is one of its own. The score of a message is its length.
    """
    order = Window.partitionBy(conversation).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    score = F.coalesce(F.char_length("text"), F.lit(0)).cast("double")
    made = turns.select(F.col(conversation).alias("tree"), node.alias("node"), "role", "text", score.alias("score"))
    return made.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).select(*KEYS)


def _single(messages: DataFrame) -> DataFrame:
    """Messages with an id each: of rows with one id and other contents the smallest stays. A null id gives no message."""
    rest = [c for c in KEYS if c not in ("tree", "node")]
    kept = messages.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in rest])).alias("m"))
    return kept.select("tree", "node", *[F.col(f"m.{c}.v").alias(c) for c in rest])


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, steps, total) of every message that a root leads to, and the rounds behind it.

    Round k names for each message the one 2^k above it (tree, node, up). A message without a parent, or
    whose parent is no message, is a root. Messages of a cycle have no root and are left out.
    """
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    joined = links.join(known, links["tree"].eqNullSafe(known["t"]) & (links["parent"] == known["up"]), "left")
    state = persist_table(joined.select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), "total"))
    ended, rounds = state.where("up is null"), []
    open_ = state.where("up is not null").count()
    for _ in range(open_.bit_length() + 1):  # a longer walk would be a cycle
        if not open_:
            break
        active = state.where("up is not null")
        rounds.append(active.select("tree", "node", "up"))
        above = active.unionByName(ended).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("steps").alias("s"), F.col("total").alias("x"))
        hop = active.join(above, active["tree"].eqNullSafe(above["t"]) & (active["up"] == above["n"]))
        state = persist_table(hop.select("tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("x")).alias("total")))
        ended = ended.unionByName(state.where("up is null"))
        open_ = state.where("up is not null").count()
    return ended.drop("up"), rounds


def chosen_leaves(messages: DataFrame, reached: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, steps, total, rank) of the ``best`` paths of each tree by total score, or of all (rank null).

    Ties go to the longer path, then to the smaller leaf. Ranks are cut off before rows are moved, so a
    tree with most of the messages is ranked by many tasks.
    """
    inner = messages.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p is not null").distinct()
    leaves = reached.join(inner, reached["tree"].eqNullSafe(inner["t"]) & (reached["node"] == inner["p"]), "left_anti").withColumnRenamed("node", "leaf")
    if best is None:
        return leaves.withColumn("rank", F.lit(None).cast("int"))
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "leaf")
    return leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, total, place, node): the messages of every chosen path; place counts from 0 at the root."""
    reached, rounds = reach(messages)
    leaves = persist_table(chosen_leaves(messages, reached, best))
    marks = leaves.select("tree", "leaf", "rank", "total", (F.col("steps") - 1).alias("place"), F.col("leaf").alias("node"))
    for k in reversed(range(len(rounds))):
        far = rounds[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        hop = marks.join(far, marks["tree"].eqNullSafe(far["t"]) & (marks["node"] == far["n"]))
        marks = persist_table(marks.unionByName(hop.select("tree", "leaf", "rank", "total", (F.col("place") - 2**k).alias("place"), F.col("up").alias("node"))))
    return marks


def format_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, total, n_turns, formatted, loss.

    ``loss`` lists (start, length) in code points of ``formatted``, counted from 1: the escaped texts of
    the assistant. A path becomes one string and so must fit one row. Empty tables give no rows; null
    roles and texts are empty; a null score counts as 0.
    """
    single = persist_table(_single(messages.select(*KEYS)))
    marks = paths(single, best)
    text = single.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")).alias("role"), escaped(F.col("text")).alias("text"), F.coalesce(F.col("role") == TRAINED, F.lit(False)).alias("trained"))
    rows = marks.join(text, marks["tree"].eqNullSafe(text["t"]) & (marks["node"] == text["n"]))
    # a message starts where those before it end; its text starts behind the head, the role and the colon
    long_ = F.char_length("role") + F.char_length("text") + len(HEAD) + 2 + len(END)
    before = Window.partitionBy("tree", "leaf", "rank", "total").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(long_).over(before), F.lit(0)) + len(HEAD) + 3 + F.char_length("role"))
    turn = F.struct("place", "role", "text", "trained", F.col("start").cast("int").alias("start"))
    whole = rows.groupBy("tree", "leaf", "rank", "total").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda m: F.concat(F.lit(HEAD), m["role"], F.lit(": "), m["text"])), END)
    loss = F.transform(F.filter("turns", lambda m: m["trained"]), lambda m: F.struct(m["start"].alias("start"), F.char_length(m["text"]).alias("length")))
    return whole.select("tree", "leaf", "rank", "total", F.size("turns").cast("long").alias("n_turns"), F.concat(formatted, F.lit(END)).alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every message of a formatted path."""
    pieces = F.slice(F.split(formatted, END), F.lit(1), F.size(F.split(formatted, END)) - 1)

    def one(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(HEAD) + 1))
        masked = F.regexp_replace(body, r"(?s)\\.", "xx")  # as long as the body; the first colon ends the role
        cut = F.instr(masked, ": ")
        return F.struct(plain(F.substr(body, F.lit(1), cut - 1)).alias("role"), plain(F.substr(body, cut + 2)).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: plain(F.substr(formatted, s["start"], s["length"])))


def digests(paths_: DataFrame) -> DataFrame:
    """What a formatted path holds, read back from the string and its mask alone."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")
    made = paths_.select("tree", "formatted", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"))
    return made.select(
        "tree", "n_turns", sha256_hex(F.col("turns")).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

