"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

1. Turns are numbered within their conversation and reduced to two hashes and a length, so texts
   move once, for the order.  A prefix is known by 128 bits: the exclusive or of the hashes of
   each turn with its place.  Running counts, sums and hashes (``running``) are cut by ranges of (conversation,
   place), so that a conversation that holds a third of all turns is spread like any other rows; what a
   range needs of those before is one row for each range.
2. Rows of one prefix are a node.  Its owner is, of the conversations through it, the one of the
   smallest hash, so the nodes of an owner are one chain down to its end: chains are the trie with
   long unbranched runs drawn together, and on any way down the owner changes about ln(conversations) times.
3. Chains hold counters of the chains below that haven't reported.  Each round the completed ones
   send their totals up and are peeled off, until only the root's chain is left and finishes.  Rounds grow
   with the logarithm of the conversations, not with the longest one.
4. Nodes take in what chains below sent them; a running sum from each chain's end up gives the totals of
   all its nodes.

The ids of the conversations that end at a node are joined in groups of 4096 neighbouring ids, whose texts
are hashed in order as they stream by: no list of a node's members is ever held.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are
turns of their own; null roles and texts are empty; rows without a conv_id take no part; an empty table
gives no nodes; a conversation whose turns are all replaced by nothing belongs to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, table, written

#: Ids of a group whose texts are joined at once, as a power of two.
GROUP_BITS = 12


def running(df: DataFrame, key: str, order: list[Column], keep: list[str], name: str, count: str | None = None, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` (without nulls) of df, with running values within ``key`` in ``order``, each row included.

    count: name of the column that numbers rows from 1; sums and xors: columns replaced by their running sum or
    exclusive or.  Rows are cut into ranges of key and order; a range starts anew, and what came before it
    in its first key is added afterwards: a row a range at most, which is broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(*keep)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, before = TaskContext.get().partitionId(), None, {}
        for frame in frames:
            if not len(frame):
                continue
            keys = frame[key].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            same = last is not None and keys[0] == last
            out = frame.copy()
            for c in ("__n", *sums, *xors):
                own = np.ones(len(keys), np.int64) if c == "__n" else frame[c].to_numpy(np.int64)
                total = np.bitwise_xor.accumulate(own) if c in xors else np.cumsum(own)
                base = np.repeat(np.append(0, total[starts[1:] - 1]), sizes)
                total = total ^ base if c in xors else total - base
                if same:
                    first = slice(0, sizes[0])
                    total[first] = total[first] ^ before[c] if c in xors else total[first] + before[c]
                before[c] = total[-1]
                out[c] = total
            last = keys[-1]
            out["__part"] = part
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", __n long, __part int"
    held = written(dealt.mapInPandas(scan, schema), name)
    runs = ["__n", *sums, *xors]
    ends = held.groupBy(key, "__part").agg(F.max_by(F.struct(*runs), "__n").alias("r")).select(key, "__part", *[F.col(f"r.{c}").alias(f"__b_{c}") for c in runs])
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "__part", *[(F.bit_xor if c in xors else F.sum)(f"__b_{c}").over(earlier).alias(f"__b_{c}") for c in runs]).where("__b___n is not null")
    out = held.join(F.broadcast(before), [key, "__part"], "left")  # at most a row for each range
    for c in runs:
        more = F.coalesce(f"__b_{c}", F.lit(0))
        out = out.withColumn(c, F.col(c).bitwiseXOR(more) if c in xors else F.col(c) + more)
    return out.select(*keep, *([F.col("__n").alias(count)] if count else []))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), z1 and z2 (hashes of role and text) and chars (code points of the text) of every turn."""
    known = columns(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    known = known.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    hashed = known.select("*", F.xxhash64(F.lit(1), "role", "text").alias("z1"), F.xxhash64(F.lit(2), "role", "text").alias("z2"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]  # row cuts very many equal turns
    return running(hashed, "conv_id", order, ["conv_id", "z1", "z2", "chars"], "trie-turns", count="pos")


def members_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("pos").alias("size"))


def rebuilt(turns: DataFrame, each: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, members) where the first h turns of conversation c are those of c - c % each; h = crc32(c) % heads."""
    first = turns.where((F.col("conv_id") % each == 0) & (F.col("pos") < heads))
    first = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "z1", "z2", "chars"))).alias("first"))  # fewer than ``heads`` turns
    plan = members_of(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % each)
    plan = plan.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    plan = plan.withColumn("head", F.expr("slice(coalesce(first, array()), 1, cast(h as int))"))
    plan = written(plan.select("conv_id", "h", "head", F.size("head").cast("long").alias("held"), (F.size("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).cast("long").alias("size")), "trie-plan")
    copied = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.z1", "t.z2", "t.chars")
    own = turns.join(plan.select("conv_id", "h", "held"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("held"))
    return copied.unionByName(own.select("conv_id", "pos", "z1", "z2", "chars")), plan.select("conv_id", "size")


def _nodes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and (k1, k2, conv_id) of each conversation's last one."""
    tagged = turns.select("conv_id", "pos", "chars", F.xxhash64("z1", "pos").alias("t1"), F.xxhash64("z2", "pos").alias("t2"))
    tagged = tagged.withColumns({"k1": F.col("t1"), "k2": F.col("t2")})
    paths = running(tagged, "conv_id", [F.col("pos")], ["conv_id", "pos", "chars", "t1", "t2", "k1", "k2"], "trie-paths", xors=("k1", "k2"))
    parent = (F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"))
    zero = F.lit(0).cast("long")
    top = members.select(zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), zero.alias("chars"), "conv_id")
    rows = paths.select("k1", "k2", *parent, F.col("pos").alias("depth"), "chars", "conv_id").unionByName(top)
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"].alias("owner"),
    )
    ended = paths.join(members, "conv_id").where("pos = size").select("k1", "k2", "conv_id")
    turnless = members.where("size = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")
    return written(nodes, "trie-nodes"), ended.unionByName(turnless)


def _digests(ended: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the ids that end there, ascending and joined by commas."""
    groups = ended.groupBy("k1", "k2", F.shiftright("conv_id", GROUP_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, hashlib.sha256()
        for frame in frames:
            rows = []
            for k1, k2, ids in zip(frame["k1"].tolist(), frame["k2"].tolist(), frame["ids"], strict=True):
                if last == (k1, k2):
                    state.update(b",")
                else:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(rows, columns=["k1", "k2", "sha"])
        if last is not None:
            yield pd.DataFrame([(*last, state.hexdigest())], columns=["k1", "k2", "sha"])

    return groups.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "part").mapInPandas(digest, "k1 long, k2 long, sha string")


def peeled(chains: DataFrame) -> DataFrame:
    """chains (owner, up: the owner above or null, saved, leaves, ...) with the totals of all that hang below.

    Each round chains without open counters tell those above and are done.
    """
    waits = chains.where("up is not null").groupBy("up").agg(F.count("*").alias("pending")).withColumnRenamed("up", "owner")
    state = written(chains.join(waits, "owner", "left").withColumn("pending", F.coalesce("pending", F.lit(0))), "trie-chains")
    done = None
    while True:
        ready = state.where("pending = 0").drop("pending")
        done = ready if done is None else done.unionByName(ready)
        rest = state.where("pending > 0")
        if rest.isEmpty():
            return done
        told = ready.where("up is not null").groupBy("up").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("c"))
        heard = rest.join(told.withColumnRenamed("up", "owner"), "owner", "left")
        for mine, more, sign in (("saved", "s", 1), ("leaves", "l", 1), ("pending", "c", -1)):
            heard = heard.withColumn(mine, F.col(mine) + sign * F.coalesce(more, F.lit(0)))
        state = written(heard.drop("s", "l", "c"), "trie-chains")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos, z1, z2, chars as ``numbered_turns`` gives them; members: conv_id, size.
    """
    nodes, ended = _nodes(turns, members)
    above = nodes.selectExpr("k1 as p1", "k2 as p2", "conv_id as parent_conv_id", "owner as above")
    below = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    known = nodes.join(above, ["p1", "p2"]).join(below, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("above", F.when(F.col("depth") > 0, F.col("above")))
    known = known.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    known = written(known.drop("chars"), "trie-known")

    chains = known.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.min(F.struct("depth", "p1", "p2", "above")).alias("top"))
    chains = chains.select("owner", "saved", "leaves", F.col("top.p1").alias("p1"), F.col("top.p2").alias("p2"), F.col("top.above").alias("up"))
    sent = peeled(chains).where("up is not null").groupBy("p1", "p2").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).withColumnsRenamed({"p1": "k1", "p2": "k2"})

    heard = known.join(sent, ["k1", "k2"], "left").withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0)))
    keep = ["owner", "k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"]
    summed = running(heard, "owner", [-F.col("depth")], keep, "trie-sums", sums=("leaves", "saved"))
    out = summed.join(_digests(ended), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    turns = numbered_turns(conversations)
    return trie(turns, members_of(turns))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))
