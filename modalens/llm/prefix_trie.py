"""The prefix trie of conversations, by fixed-length block hashing.

A conversation is a row of turn digests, cut into blocks of BLOCK turns (the last may be shorter). Every block has the
chained digest of all turns up to its end, so conversations that share a beginning share the keys of its blocks.

1. Conversations are grouped by block key: members, the smallest of them and their words are sums over rows.
2. A block without a sibling is shared whole: each of its turns is a node with just the block's members, and none of
   them is hashed. Only where siblings diverge, under one parent key, are their turns hashed one by one and grouped.
3. Sums over subtrees need no walk down the tree. A node belongs to its smallest member, and what a conversation owns is
   the end of its path, from the depth at which it becomes the smallest member on. So the words of a node's subtree, told
   twice, are sums over its members: with repeats, all words of the members less those above the node; without, all
   words that its members own, less those that its own conversation owns above it. Leaves are the members that own one.

Every step is an aggregation that combines before it shuffles, or a join on a unique key, so a node with a third of all
conversations is no task's burden; the number of steps doesn't depend on the depth.

Defined cases: a null turn comes first and ties of turns are ordered by role and digest; a null role or text is empty;
rows without a conv_id are no conversation's; a repeated row is a turn of its own; an empty table gives no rows (not
even the root); other columns are ignored. A conversation's turn digests fit one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import matched, whole_text, word_count, written

#: Turns of a block; members of a node whose ids are joined at a time, by ranges of ids.
BLOCK, ID_RANGE = 4, 1024
ROOT = ""


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, digests, words): each conversation's turns in order, as digests of role and text and the texts' words."""
    role, text = whole_text("role"), whole_text("text")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    row = F.struct(F.col("turn").isNotNull().alias("given"), "turn", role.alias("role"), digest.alias("digest"), word_count().alias("words"))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), row.alias("row"))
    ordered = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return ordered.select("conv", F.col("rows.digest").alias("digests"), F.col("rows.words").alias("words"))


def rebuilt(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the first of each `every` ids; how many (below `heads`) is by crc32 of the id."""
    first = (F.col("conv") - F.col("conv") % every).alias("base")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h")
    base = own.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"base_{c}") for c in ("digests", "words")])
    both = own.select("*", first, h).join(base, "base", "left")

    def joined(c: str) -> Column:
        head = F.when(F.col(f"base_{c}").isNull(), F.slice(c, 1, 0)).otherwise(F.slice(f"base_{c}", F.lit(1), F.col("h")))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)

    return both.select("conv", joined("digests"), joined("words"))


def key_of(parent: str, digests: list[str]) -> str:
    """The key of the node at the end of some turns below a block's end. Digests have one length, so nothing runs together."""
    return hashlib.sha256((parent + "/" + "".join(digests)).encode()).hexdigest()


def with_blocks(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conversations with `keys`, the chained digests of their blocks, and `total`, their words."""

    @F.pandas_udf("array<string>")
    def chained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = []
            for digests in part:
                keys, at, digests = [], ROOT, list(digests)
                for i in range(0, len(digests), block):
                    at = key_of(at, digests[i : i + block])
                    keys.append(at)
                out.append(keys)
            yield pd.Series(out, dtype=object)

    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    return conversations.select("*", chained("digests").alias("keys"), total.alias("total"))


def blocks_of(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct blocks: key, parent, start (its depth), above (words before it), digests, words, n, conv, total."""
    at = lambda c: F.slice(c, F.col("k") * block + 1, F.lit(block))
    sums = paths.select("conv", "total", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.sum("total").alias("total"))
    first = paths.select("conv", "keys", "digests", "words", F.posexplode("keys").alias("k", "key"))
    parent = F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(F.get("keys", F.col("k") - 1))
    above = F.aggregate(F.slice("words", F.lit(1), F.col("k") * block), F.lit(0).cast("long"), lambda a, x: a + x)
    content = first.join(sums, ["key", "conv"])  # the smallest member's own turns stand for all
    return content.select("key", parent.alias("parent"), (F.col("k") * block).alias("start"), above.alias("above"), at("digests").alias("digests"), at("words").alias("words"), "n", "conv", "total")


def turns_of(blocks: DataFrame) -> DataFrame:
    """(node, up, block, depth, words, above, n, conv, total): a row for each block and turn in it; `node` is the turn's key, `up` its parent's."""
    alone = F.col("siblings") == 1

    @F.pandas_udf("array<string>")
    def refined(parent: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([[key_of(p, list(d)[: i + 1]) for i in range(len(d))] for p, d in zip(parent, digests, strict=True)], dtype=object)

    siblings = blocks.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings"))
    known = matched(blocks, siblings, ["parent"], n="siblings")
    inner = F.transform(F.sequence(F.lit(1), F.size("digests")), lambda i: F.when(i == F.size("digests"), F.col("key")).otherwise(F.concat("key", F.lit("-"), i.cast("string"))))
    single = known.filter(alone).withColumn("nodes", inner)
    several = known.filter(~alone).withColumn("nodes", refined("parent", "digests"))
    each = single.unionByName(several).select("*", F.posexplode("nodes").alias("i", "node"))
    up = F.when(F.col("i") == 0, F.col("parent")).otherwise(F.get("nodes", F.col("i") - 1))
    before = F.aggregate(F.slice("words", F.lit(1), F.col("i")), F.col("above"), lambda a, x: a + x)
    return each.select("node", up.alias("up"), F.col("key").alias("block"), (F.col("start") + F.col("i") + 1).alias("depth"), F.get("words", F.col("i")).alias("own_words"), before.alias("above"), "n", "conv", "total")


def id_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids (node, conv) of a node, ascending, joined by commas.

    Ids are joined by ranges first, so the task that hashes a node reads a row for each range, one after another.
    """
    pieces = members.groupBy("node", F.floor(F.col("conv") / ID_RANGE).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for part in batches:
            out = []
            for node, ids in zip(part.node, part.ids, strict=True):
                if node == now:
                    h.update(b",")
                else:
                    if h:
                        out.append((now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                h.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if h:
            yield pd.DataFrame({"node": [now], "ends_sha256": [h.hexdigest()]})

    return pieces.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInPandas(hashed, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie over conversations (conv, digests, words), as `turns` and `rebuilt` give them."""
    paths = written(with_blocks(conversations, block), "paths")
    blocks = written(blocks_of(paths, block), "blocks")
    rows = written(turns_of(blocks), "block-turns")
    summed = lambda more=(): [F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("total").alias("total"), *more]
    place = [F.first(c).alias(c) for c in ("depth", "own_words", "above")]
    top = paths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.sum("total").alias("total")).filter("n > 0")
    top = top.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("up"), "n", "conv", "total", *[F.lit(0).cast(t).alias(c) for c, t in (("depth", "int"), ("own_words", "long"), ("above", "long"))])
    bare = rows.groupBy("node", "up").agg(*summed(place)).unionByName(top)
    children = bare.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).filter("node IS NOT NULL")
    nodes = written(bare.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    owned = nodes.groupBy("conv").agg(F.min(F.struct("depth", "above")).alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = written(owned.select("conv", F.col("first.above").alias("owned_from"), "leaf"), "owners")
    shares = paths.join(owned, "conv").select("keys", (F.col("total") - F.col("owned_from")).alias("owned"), "leaf")
    within = shares.select(F.explode("keys").alias("block"), "owned", "leaf").groupBy("block").agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"))
    below = rows.select("node", "block").join(within, "block", "left").groupBy("node").agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))
    below = below.unionByName(shares.agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves")).select(F.lit(ROOT).alias("node"), "owned", "leaves"))

    ends = paths.select("conv", F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(ROOT)).alias("node"))
    full = nodes.join(below, "node").join(owned.select("conv", "owned_from"), "conv").join(id_digests(ends), "node", "left")
    repeated = F.col("total") - F.col("n") * F.col("above")
    distinct = F.col("owned") - (F.col("above") - F.col("owned_from"))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("up"), F.col("conv").alias("parent"), F.col("n_children").alias("siblings"))
    out = matched(full.filter("up IS NOT NULL"), parents, ["up"], n="siblings").unionByName(full.filter("up IS NULL").withColumn("parent", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), (repeated - distinct).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
