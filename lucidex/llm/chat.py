"""Reply trees to chat texts: root-to-leaf paths, ranked branches, one formatted conversation a path.

Paths come from self-joins that double: the node 1, 2, 4, ... replies above each node is found by joining
the table of jumps with itself, and each leaf is then walked to its root by halves, so a tree of depth d
takes about 2 log2(d) joins of narrow rows and no row is made that no path holds.

The format marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings of this and of other
known formats are escaped inside texts and roles by a backslash after their first character (one more,
where backslashes stand there already), so a text can't open or close a turn and is read back exactly.
A path's loss mask is a list of run lengths in code points: so many masked, then so many trained.

Defined results: a null text or role is an empty one; a reply to a node that isn't there is a root;
rows that share tree and node count once, the least by role and text; null trees are one tree, rows with a
null node are left out; replies in a circle are on no path; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lucidex.llm.common import release, saved, whole_text
from lucidex.operators.skew import top_per_group

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Strings with which common chat formats steer a model.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
            "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>",
            "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string, or one whose first character is followed by backslashes already.  No control string
#: holds the start of another behind its first character, so matches never overlap.
ESCAPABLE = rf"([<\[])(\\*)({_TAILS})"
ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"

FORMATTED = "formatted string, loss array<struct<masked:long,trained:long>>"


def escape(text: Column) -> Column:
    """The text with its control strings broken up."""
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


#: Rows of one key that a task may meet; at most so many keys have more.
HOT_ROWS, HOT_KEYS = 1 << 20, 10_000


def meet(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """Joins many rows to a table with one row a key, where one key (a root with millions of replies) may have most rows.

    Keys with over :data:`HOT_ROWS` rows, or a ten-thousandth of all where that is more, are dealt over tasks
    and their one row of the table is copied; their number is bounded, so they are broadcast.
    *total* is the number of rows where it is known, which else are made once more to be counted.
    """
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:  # no key has more
        return rows.join(table, key, how)
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = saved(rows.groupBy(*key).count().filter(F.col("count") > most)
                .select(*key, F.ceil(F.col("count") / most).cast("int").alias("_pieces")), "chat-hot")
    pieces = F.coalesce("_pieces", F.lit(1))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), pieces)).drop("_pieces")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long")))).drop("_pieces")
    return spread.join(copies, [*key, "_piece"], how).drop("_piece")


# Paths. Nodes are narrow rows (tree, node, parent); a missing parent is null.


def _links(nodes: DataFrame) -> DataFrame:
    """tree, node and the parent where it is a node of the tree."""
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    return (meet(nodes, there, ["tree", "parent"], "left")
            .select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("above")))


def _jumps(links: DataFrame, most: int) -> list[DataFrame]:
    """Tables (tree, node, above) of the node 1, 2, 4, ... above; the last one that isn't empty ends the list.

    Only nodes in a circle or below one have a node above them after as many steps as a tree has nodes.
    """
    tables = [saved(links.filter("above IS NOT NULL"), "chat-jumps")]
    while not tables[-1].isEmpty() and 1 << (len(tables) - 1) <= most:
        last = tables[-1]
        onward = last.select("tree", F.col("node").alias("above"), F.col("above").alias("_further"))
        tables.append(saved(meet(last, onward, ["tree", "above"]).select("tree", "node", F.col("_further").alias("above")), "chat-jumps"))
    return tables


def paths(nodes: DataFrame) -> DataFrame:
    """Every leaf with the nodes on its way to the root (tree, leaf, node, up); the leaf itself has up 0.

    *nodes* has unique (tree, node), none of them null, and parent.
    """
    links = saved(_links(nodes), "chat-links")
    most = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = _jumps(links, most)
    left = len(jumps) - 1
    leaves = links.join(links.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    if not jumps[left].isEmpty():  # circles: whoever has a node above after that many steps is in or below one
        leaves = leaves.join(jumps[left].select("tree", "node"), ["tree", "node"], "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    walk = saved(walk, "chat-walk")
    for k in range(left - 1, -1, -1):
        # What a row stands for is cut in halves: from its node on, and from the node 2^k above on.
        above = meet(walk, jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        shorter, walk = walk, saved(walk.unionByName(above), "chat-walk")
        release(shorter)
    release(links, *jumps)
    return walk


def ranked_branches(walk: DataFrame, scores: DataFrame, keep: int | None = None) -> DataFrame:
    """Branches (tree, leaf) with the sum of their nodes' scores (tree, node, score) and their rank in the tree.

    A null score counts as 0; ties go to the lesser leaf.  *keep* is the number of branches a tree may have.
    """
    summed = (meet(walk, scores, ["tree", "node"]).groupBy("tree", "leaf")
              .agg(F.sum(F.coalesce("score", F.lit(0.0)).cast("double")).alias("branch_score"), F.count(F.lit(1)).alias("n_turns")))
    order = [F.desc("branch_score"), F.asc("leaf")]
    if keep is None:
        return summed
    return top_per_group(summed, ["tree"], order, keep, ["leaf"], rank="branch_rank")


def formatted_paths(walk: DataFrame, messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row (tree, leaf, formatted, loss) per path; *messages* has tree, node, role and text.

    A path is gathered in one row, as it is one text.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    pieces = messages.select(
        "tree", "node", head.alias("head"), escape(whole_text()).alias("body"), F.coalesce("role", F.lit("")).isin(*trained).alias("learn"))
    turns = (meet(walk, pieces, ["tree", "node"]).groupBy("tree", "leaf")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "learn"))).alias("turns")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    end = len(CLOSE) + 1
    # Run lengths, so that no position has to be summed up: what precedes a body belongs to the masked run.
    loss = F.transform("turns", lambda t: F.when(
        t["learn"], F.struct(F.length(t["head"]).cast("long").alias("masked"), F.length(t["body"]).cast("long").alias("trained"), F.lit(end).alias("tail")))
        .otherwise(F.struct((F.length(t["head"]) + F.length(t["body"])).cast("long").alias("masked"), F.lit(0).cast("long").alias("trained"), F.lit(end).alias("tail"))))
    runs = F.flatten(F.transform(loss, lambda r: F.array(
        F.struct(r["masked"], r["trained"]), F.struct(r["tail"].cast("long").alias("masked"), F.lit(0).cast("long").alias("trained")))))
    return turns.select("tree", "leaf", text.alias("formatted"), runs.alias("loss"))


def conversations_of(messages: DataFrame, keep: int | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Reply trees (tree_id, node_id, parent_id, role, text, score) to one formatted conversation per kept branch.

    Returns tree_id, leaf_id, n_turns, branch_score, formatted, loss, and branch_rank where *keep* is given.
    """
    nulls = F.struct(F.col("tree_id").isNotNull().alias("has"), "tree_id")
    least = F.min(F.struct(F.col("role").alias("role"), F.col("text").alias("text"), F.col("parent_id").alias("parent"), F.col("score").alias("score")))
    nodes = saved(messages.filter("node_id IS NOT NULL").groupBy(nulls.alias("tree"), F.col("node_id").alias("node"))
                  .agg(least.alias("_one")).select("tree", "node", "_one.*"), "chat-nodes")
    walk = paths(nodes.select("tree", "node", "parent"))
    branches = ranked_branches(walk, nodes.select("tree", "node", "score"), keep)
    if keep is not None:
        walk = walk.join(branches.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    out = formatted_paths(walk, nodes, trained).join(branches, ["tree", "leaf"])
    return out.select(F.col("tree.tree_id").alias("tree_id"), F.col("leaf").alias("leaf_id"),
                      *[c for c in out.columns if c not in ("tree", "leaf")])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.partition(CLOSE)[0])))
    return turns


def read_loss(formatted: str, runs: list[dict]) -> str:
    """The text under the loss mask."""
    at, parts = 0, []
    for run in runs:
        at += run["masked"]
        if run["trained"]:
            parts.append(unescape(formatted[at:at + run["trained"]]))
            at += run["trained"]
    return "".join(parts)


def digests(chats: DataFrame, key: str) -> DataFrame:
    """What is read back from each formatted conversation, as digests."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("formatted"), batch.column("loss")):
                text = text.as_py()
                turns, loss = read_turns(text), read_loss(text, runs.as_py())
                rows.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema[key].dataType.simpleString()
    return chats.select(key, "formatted", "loss").mapInArrow(
        run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold control strings, added to show that they are read back.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chains(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before it.

    Turns with equal numbers, repeated rows too, are each kept, in the order of role and text; a null turn is last.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(
        spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    placed = rows.withColumn("node_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(
        F.asc_nulls_last("turn"), F.coalesce("role", F.lit("")), whole_text())))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return placed.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_all(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Every conversation formatted, and what is read back from it."""
    chats = conversations_of(chains(spark, turns)).withColumnRenamed("tree_id", "conv_id")
    return digests(chats, "conv_id")
