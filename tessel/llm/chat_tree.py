"""Conversations from reply trees, by DataFrame functions alone.

Each message names the message it replies to. Iterative self-joins give every message its ancestors 1, 2, 4, ... steps up,
its depth and the sum of scores down to it, in as many rounds as the depth has binary digits. Leaves are ranked within
their tree by the mean score of their path, and the chosen leaves' paths are spelled out by the same jumps, largest first.
A path becomes one text:

    <|im_start|>role\\ntext<|im_end|>\\n

for each message. In roles and texts "<", any number of backslashes and "|" gains one backslash, so no text holds a control
string, and unescape() takes that backslash away again; in roles "%" and line breaks become %25 and %0A. The loss mask is an
array of the assistant texts' spans.

Defined cases: a null text is empty and a null role the empty role; a message whose parent isn't there is a root; a message that
replies to itself or stands on a cycle never reaches a root and is in no path; null ids take no part; of rows that share
tree and id, the least by its other columns counts; ties between leaves go to the smaller id; columns beyond those named
aren't read; a conversation becomes one row however long it is, so it is one task's, which works in proportion to its
length; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear(rows: DataFrame) -> DataFrame:
    """(tree, id, parent, score, role, text) for conversations whose rows follow one another by turn; equal turns by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.where("conv_id is not null").select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, path, rank, step, id, role, text): the messages of each tree's best root-to-leaf paths."""
    messages = messages.where("tree is not null and id is not null").select("tree", "id", F.struct("parent", "score", "role", "text").alias("m"))
    messages = messages.groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.*")
    ids = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = messages.join(ids, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    nodes = cut(nodes)
    parents = nodes.where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    jumps, state = [], nodes
    n = nodes.count()
    # A path is no longer than the table; what still has an ancestor after that many doublings is on a cycle.
    while len(jumps) <= max(1, n).bit_length():
        climbing = state.where("up is not null")  # what has reached its root is done, and only looked up
        jumps.append(climbing.select("tree", "id", "up"))
        above = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        moved = climbing.join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        state = cut(moved.unionByName(state.where("up is null")))
        if state.where("up is not null").isEmpty():
            break
    rooted = state.where("up is null")
    leaves = rooted.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree)
    on = cut(chosen.select("tree", F.col("id").alias("path"), "rank", "id"))
    for jump in reversed(jumps):
        on = on.join(jump, ["tree", "id"], "left").select("tree", "path", "rank", F.explode(F.array_compact(F.array("id", "up"))).alias("id"))
    return on.join(rooted.select("tree", "id", F.col("depth").alias("step")), ["tree", "id"]).join(messages.select("tree", "id", "role", "text"), ["tree", "id"])


def formatted(messages: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, path, rank, conversation, loss): one text for each chosen path; loss: its spans (start, length) in characters that the model learns from."""
    turns = paths(messages, per_tree).withColumn("head", F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))).withColumn("body", escape(F.coalesce("text", F.lit(""))))
    turns = turns.withColumn("all", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "path", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("all").cast("long")).over(before), F.lit(0).cast("long")) + F.length("head")
    turns = turns.select("tree", "path", "rank", "step", "all", F.when(F.col("role") == learn, F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    rows = turns.groupBy("tree", "path", "rank").agg(F.array_sort(F.collect_list(F.struct("step", "all", "span"))).alias("turns"))
    spans = F.array_compact(F.transform("turns", lambda t: t["span"]))
    return rows.select("tree", "path", "rank", F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("conversation"), spans.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """formatted() with turns (role, text) and learned (the loss mask's texts), both read from the conversation itself."""
    # A control string can't be part of an escaped text, so the text splits at them; the last part is empty.
    parts = F.filter(F.split(F.col("conversation"), r"<\|im_end\|>\n"), lambda p: p != "")
    whole = F.transform(parts, lambda p: F.substring(p, len(START) + 1, F.length(p)))
    turns = F.transform(whole, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("conversation"), s["start"] + 1, s["length"])))
    return rows.withColumn("turns", turns).withColumn("learned", learned)
