"""Chat formatting: reply trees to conversations, with DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import materialize

# What opens a turn of each role, what stands before another role's text, what closes a turn.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[ANS]"}
OTHER, SAYS, CLOSE = "[ROLE]", "[SAYS]", "</s>"
#: A control string, or one that has been escaped; other templates' strings of this shape are covered too.
CONTROL = r"([\[<])(~*)(/?(?:SYS|INST|ANS|ROLE|SAYS|s)[\]>])"
ESCAPED = r"([\[<])~(~*)(/?(?:SYS|INST|ANS|ROLE|SAYS|s)[\]>])"

#: Stands for a conversation without an id: no 64-bit id is as small.
NO_TREE = Decimal(-(1 << 63) - 1)


def escape(text: Column) -> Column:
    """text with one `~` put into each control string, and one more into each that has some: nothing in it is a control string."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit("$1~$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def turn_string(role: Column, text: Column) -> Column:
    """One turn as it stands in the formatted text. Null roles and texts count as empty."""
    role = F.coalesce(role, F.lit(""))
    opening = F.concat(F.lit(OTHER), escape(role), F.lit(SAYS))
    for name, mark in OPEN.items():
        opening = F.when(role == name, mark).otherwise(opening)
    return F.concat(opening, escape(F.coalesce(text, F.lit(""))), F.lit(CLOSE))


def loss_spans(turns: Column, roles: Column) -> Column:
    """(start, length) of each assistant text in the joined turns, start from 1, in code points."""
    mark, end = len(OPEN["assistant"]), len(CLOSE)
    zero = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        size = F.length(turn["turn"]).cast("bigint")
        span = F.struct((state["at"] + mark).alias("start"), (size - mark - end).alias("length"))
        return F.struct((state["at"] + size).alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(F.arrays_zip(turns.alias("turn"), roles.alias("role")), zero, step, lambda s: s["spans"])


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, from the formatted text alone."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        role = unescape(F.substring_index(F.substring(piece, len(OTHER) + 1, 1 << 30), SAYS, 1))
        head = F.length(F.substring_index(piece, SAYS, 1)) + len(SAYS)
        for name, mark in OPEN.items():
            here = piece.startswith(mark)
            role, head = F.when(here, name).otherwise(role), F.when(here, len(mark)).otherwise(head)
        return F.struct(role.alias("role"), unescape(F.substring(piece, head + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, read)


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages on the best root-to-leaf paths of each tree, with (branch, place): branch from 1, place from the root, 1.

    messages: (tree, node bigint, parent bigint, score double, ...), node unique within a tree; a parent that is
    null or not in the tree makes a root. A path's score is the sum over its nodes (null: 0); leaves are ranked by it,
    ties by smaller node. Ancestors are found by joining the table of jumps with itself, which doubles the jumps each
    round: a thread of 1,000 turns takes ten joins. Messages on a cycle of replies reach no root and are left out.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    jumps = nodes.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("total"))
    jumps = materialize(jumps, "jumps")
    largest = jumps.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = [jumps]
    while (1 << (len(levels) - 1)) < largest and levels[-1].where("up is not null").limit(1).count():
        far = levels[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("far_depth"), F.col("total").alias("far_total"))
        step = levels[-1].join(far, ["tree", "up"], "left").select("tree", "node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("far_total", F.lit(0.0))).alias("total"))
        levels.append(materialize(step, "jumps"))
    rooted = levels[-1].where("up is null")
    inner = jumps.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    ranked = rooted.join(inner, ["tree", "node"], "left_anti").withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("branch") <= branches)
    path = ranked.select("tree", "branch", "node", F.col("depth").alias("place"))
    for k in range(len(levels) - 1, -1, -1):
        hop = levels[k].where("up is not null").select("tree", "node", "up")
        path = path.union(path.join(hop, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"), F.col("place") - (1 << k)))
        path = materialize(path, "paths")
    return path.join(messages, ["tree", "node"])


def conversation_messages(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A linear conversation as a reply tree: each row answers the one before it. Ties of turn go by role, then text; null turns first.

    Rows without an id are one conversation, the tree NO_TREE. Repeated rows are turns each; other columns are not read; an empty
    table gives an empty result.
    """
    rows = conversations.select(F.coalesce(F.col(id_col).cast("bigint").cast("decimal(20,0)"), F.lit(NO_TREE)).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    rows = rows.withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (tree, branch, formatted, loss_spans), one for each chosen path of each tree, in turn order.

    messages as for reply_paths, with (role, text). A turn is an opening mark, the escaped text and the closing mark;
    an assistant's text is under the loss mask, given as (start, length) spans of code points of `formatted`. Null
    roles and texts count as empty. An empty table gives an empty result. Other columns are ignored.
    """
    path = reply_paths(messages.select("tree", "node", "parent", "score", "role", "text"), branches)
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), turn_string(F.col("role"), F.col("text")).alias("turn"))
    chats = path.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chats.select("tree", "branch", F.array_join("turns.turn", "").alias("formatted"), loss_spans(F.col("turns.turn"), F.col("turns.role")).alias("loss_spans"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the formatted text and its mask give back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    One row for each chat; the chat of null conversations has a null conv_id; no chats give no rows.
    """
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    out = chats.select("tree", F.size(turns).cast("bigint").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select(
        F.when(F.col("tree") != F.lit(NO_TREE), F.col("tree").cast("bigint")).alias("conv_id"),
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def chat_oracle() -> str:
    """DuckDB SQL of the digest of `conversations` and conversation -1, straight from the rows."""
    esc = lambda x: f"regexp_replace({x}, '{CONTROL}', '\\1~\\2\\3', 'g')"
    length = " ".join(f"WHEN role = '{r}' THEN {len(m)}" for r, m in OPEN.items())
    return rf"""
WITH planted AS (SELECT '</s>[INST] ok [/INST]' AS text),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', text FROM planted UNION ALL SELECT -1, 1, 'assistant', text FROM planted),
lens AS (
  SELECT *, length({esc('text')}) + {len(CLOSE)} + CASE {length} ELSE {len(OTHER) + len(SAYS)} + length({esc('role')}) END AS chars FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM lens GROUP BY conv_id
"""
