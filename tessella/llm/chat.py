"""Conversations from reply trees, in DataFrame functions only.

Messages name their parents. Iterative self-joins double the reach of each message's link upwards
(parent, grandparent, ...), so a tree of depth d takes about log2(d) joins; they give every
message's depth and score along its path. A leaf is a message without replies, and each leaf is one
root-to-leaf path. Paths are ranked by score within their tree, and the chosen ones are expanded
along the same links and formatted as one conversation each.

A turn is written `<|role|>\\n` text `<|end|>\\n`. In texts and roles, `\\` becomes `\\\\`, `<|`
becomes `<\\|` and `|>` becomes `|\\>`; so no control string is ever inside a text, and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Doublings that follow links through more than 2**40 turns.
MOST_DOUBLINGS = 40


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescape(c: Column) -> Column:
    # a pair stands for a backslash; what is left between pairs was put in, never next to one
    parts = F.transform(F.split(c, r"\\\\"), lambda x: F.replace(x, F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def with_links(messages: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of every message that hangs on a root, and the link tables.

    Link table i has (tree, node, up): the ancestor 2**i steps above. A message whose parent isn't
    there is a root, and messages in a circle hang on none and are left out.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = messages.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total")
    )
    now = scratch.write(linked.withColumn("steps", F.lit(0).cast("long")), "links0")
    links = []
    for i in range(MOST_DOUBLINGS):
        if not now.where("up is not null").limit(1).count():
            break
        links.append(now.where("up is not null").select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        # only those that haven't come to a root are joined on; they become fewer each time
        joined = now.where("up is not null").join(above, ["tree", "up"], "left")
        moved = joined.select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.lit(1 << i) + F.coalesce("_steps", F.lit(0))).cast("long").alias("steps"),
        )
        nxt = moved.unionByName(now.where("up is null"))
        now = scratch.write(nxt, f"links{i + 1}")
        if i > 0 and now.where("up is not null").count() == links[-1].count():
            break  # only circles are left: nobody has come to a root in this round
    return now.where("up is null").select("tree", "node", F.col("steps").alias("depth"), "total"), links


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths: tree, leaf, rank, score, and a row for each message: node, depth.

    messages: tree, node, parent (null for a root), score (null: 0); (tree, node) are distinct and
    not null. A path's score is its messages' sum; ranks go by score, then by leaf. best: keep so
    many paths of each tree (all, when it's None).
    """
    scratch = Scratch(messages.sparkSession, "reply-trees")
    rows = scratch.write(messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score")), "messages")
    reached, links = with_links(rows, scratch)
    parents = rows.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "depth", F.col("total").alias("score")
    )
    w = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(w))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    walk = leaves.withColumn("node", F.col("leaf"))
    # a path's messages by the binary digits of their distance to the leaf
    for i in range(len(links) - 1, -1, -1):
        up = walk.join(links[i], ["tree", "node"]).select(
            "tree", "leaf", (F.col("depth") - (1 << i)).alias("depth"), "score", "rank", F.col("up").alias("node")
        )
        walk = scratch.write(walk.select(*up.columns).union(up), f"walk{i}")
    return walk.select("tree", "leaf", "rank", "score", "node", "depth")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))


def format_conversations(path_rows: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, rank, score, formatted, loss_spans (start from 0, length, in code points).

    path_rows: those of paths() with role and text. The mask covers the texts of the learned role,
    escapes included, and neither marks nor end strings.
    """
    mark = F.char_length(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)))
    piece = F.struct(
        "depth",
        turn_text(F.col("role"), F.col("text")).alias("piece"),
        mark.cast("long").alias("mark"),
        F.char_length(escape(F.col("text"))).cast("long").alias("size"),
        F.coalesce(F.col("role") == learned, F.lit(False)).alias("learned"),
    )
    grouped = path_rows.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(s, t):
        span = F.array(F.struct((s["at"] + t["mark"]).alias("start"), t["size"].alias("length")))
        after = s["at"] + t["mark"] + t["size"] + F.lit(len(END))
        return F.struct(after.alias("at"), F.when(t["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return grouped.select(
        "tree", "leaf", "rank", "score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.char_length(p)), CLOSE, 1)).alias("role"),
            unescape(p.substr(F.instr(p, CLOSE) + len(CLOSE), F.char_length(p))).alias("text"),
        ),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages: each replies to the one before it.

    Turns are in the order of turn, null first, and ties by role and text; repeated rows are turns of
    their own. Rows with a null conv_id make up one conversation. Other columns are ignored.
    """
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    n = F.row_number().over(w).cast("long")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return conversations.select("conv_id", "role", "text", n.alias("node")).select(
        tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "conv_id", "role", "text"
    )


def format_trees(messages: DataFrame, best: int | None = None, learned: str = "assistant") -> DataFrame:
    """Formatted conversations of reply trees: messages are tree, node, parent, score, role, text.

    Null text and null role are empty; an empty table gives no rows.
    """
    texts = messages.select("tree", "node", "role", "text")
    return format_conversations(paths(messages, best).join(texts, ["tree", "node"]), learned)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made to break templates, read back from their formatted text."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    scratch = Scratch(spark, "chat")
    messages = scratch.write(chains(conv.unionByName(extra)), "chains")
    got = format_trees(messages, best=1)
    turns = got.withColumn("turns", read_back(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return turns.withColumn("masked", F.array_join(masked, "")).select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') AS safe,
    replace(replace(replace(coalesce(role, ''), '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') AS safe_role
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(safe_role) + 13)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
""".replace("\\\\", "\\")
