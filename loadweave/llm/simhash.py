"""SimHash near-duplicates by pigeonring filtering.

A text becomes one 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its
four-word shingles.  Two fingerprints link at ``LIMIT`` = 4 or fewer differing bits.  Only distinct
fingerprints meet, so exact copies cost nothing beyond their fingerprint.

The 64 bits are a ring of 16 segments of 4 bits.  If two fingerprints differ in at most 4 bits,
there is a segment to start from such that every chain of the next n segments holds at most
n / 4 differing bits, for each n up to 16 (the pigeonring principle: were there none, chains that
break their budget could be laid around the ring and would sum to more than 4).  From that start:

1. three segments agree wholly, and of the four after them all but one do.  A posting's key is the
   start with those six segments; a fingerprint has 16 starts times 4 segments left out.
2. Fingerprints of one key are compared where they lie, side by side after a sort: chains of 7, 11
   and 15 segments within 1, 2 and 3 bits, then all 64 bits within 4.
3. A key gives at most one link a fingerprint, a forest of what it joins, never its pairs.

Keys with more than ``BLOCK`` fingerprints are cut into blocks as they stream by: each block is
joined in itself, and each pair of blocks of a key is a group of its own afterwards, so that no
task holds more than two blocks.  All pairs of a key are compared either way.  Links form
components (``graphs``).

Defined results: null and empty texts and texts of blanks have the fingerprint zero, which links as
any other; fewer than four words are one shingle; repeated rows and rows that share a doc_id each
give a row; rows without a doc_id take part, and their component_id is the smallest doc_id they
reach, or null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, batches, columns, table, written
from .graphs import components

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Most fingerprints of a key that are compared in one group.
BLOCK = 4096
#: Bytes of a text whose words are cut at a time.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Segments of a chain, counted in bits, and the differing bits they may hold.
CHAINS = ((28, 1), (44, 2), (60, 3), (64, 4))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, in pieces."""
    data = text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""
    held: list[bytes] = []
    at, none = 0, True
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        cut = cut.start() if cut else len(data)
        held += data[at:cut].split()
        at = cut
        if len(held) < size and (at < len(data) or not none or not held):
            continue  # the rest may add words; a text's last few words stand in the shingles before
        joined, ends = b" ".join(held), np.cumsum([len(w) + 1 for w in held])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[min(size, len(held)) - 1 :] - 1).tolist()
        none = False
        yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))  # noqa: B905
        held = held[len(held) - size + 1 :] if len(held) >= size else []


def fingerprint(text: str | None) -> int:
    """Each bit that more than half of the shingles' hashes set; zero without words."""
    votes, many = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        for lo in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)])
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        many += len(hashes)
    return int.from_bytes(np.packbits(votes * 2 > many, bitorder="little").tobytes(), "little") if many else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (as a signed long) of every row."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 4 << 20):
            found = np.fromiter((fingerprint(t) for t in frame["text"]), np.uint64, len(frame))
            yield pd.DataFrame({"id": frame["id"], "none": frame["none"], "fp": found.view(np.int64)})

    # A null among them would make pandas read ids as doubles, which hold 53 bits.
    known = columns(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    return known.mapInPandas(of, "id long, none boolean, fp long").select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "fp")


def postings(prints: DataFrame) -> DataFrame:
    """(key, ring) of distinct fingerprints: ring is the fingerprint turned so that the start comes first."""
    slot = F.explode(F.sequence(F.lit(0), F.lit(63)))
    turned = prints.select("fp", slot.alias("slot")).withColumn("turn", F.expr("4 * (slot div 4)").cast("int"))
    turned = turned.withColumn("ring", F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, (64 - turn) % 64) * if(turn = 0, 0, 1)"))
    # The first 7 segments without the one of segments 3 to 6 that the slot leaves out.
    kept = F.expr("shiftrightunsigned(ring, 36) & ~shiftleft(15L, 4 * (3 - slot % 4))")
    return turned.select((F.shiftleft(F.col("slot").cast("long"), 28) + kept).alias("key"), "ring")


def viable(x: np.ndarray) -> np.ndarray:
    """Places of differences, turned to their start, whose chains all keep within their budgets."""
    left = np.arange(len(x))
    for bits, most in CHAINS:
        left = left[np.bitwise_count(x[left] >> np.uint64(64 - bits)) <= most]
    return left


class Forest:
    """Joins places by links and keeps those that joined two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        a, b = self.root[one], self.root[two]
        fresh = a != b
        if not fresh.any():
            return
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while i in parent:
                i = parent[i]
            return i

        for i, j, x, y in zip(a[fresh].tolist(), b[fresh].tolist(), one[fresh].tolist(), two[fresh].tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                self.links.append((x, y))
        for i in sorted(parent):
            parent[i] = parent.get(parent[i], parent[i])
        olds = np.array(sorted(parent))
        at = np.searchsorted(olds, self.root)
        at[at == len(olds)] = 0
        changed = olds[at] == self.root
        self.root[changed] = np.array([parent[i] for i in olds.tolist()])[at[changed]]


def run_links(keys: np.ndarray, rings: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of equal keys (which stand together): a forest of each key."""
    forest = Forest(len(keys))
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return forest.links
        met = at[viable(rings[at] ^ rings[at + step])]
        forest.add(met, met + step)
        step += 1


def _turned_back(keys: np.ndarray, rings: np.ndarray) -> np.ndarray:
    turn = ((keys >> 30) * 4).astype(np.uint64)
    return (rings >> turn) | np.where(turn > 0, rings << ((np.uint64(64) - turn) % np.uint64(64)), np.uint64(0))


_MET = "kind string, key long, block int, a long, b long"


def _met(kind: str, key: np.ndarray, block, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "key": key, "block": block, "a": np.asarray(a).view(np.int64), "b": np.asarray(b).view(np.int64)})


def _blocks(most: int):
    """Reads postings in the order of their keys; gives links, the members of blocks of long keys and the number of blocks of each."""

    def links(keys: np.ndarray, rings: np.ndarray) -> pd.DataFrame:
        found = run_links(keys, rings)
        one, two = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
        return _met("link", keys[one], 0, _turned_back(keys[one], rings[one]), _turned_back(keys[two], rings[two]))

    def closed(key: int, rings: np.ndarray, block: int) -> Iterator[pd.DataFrame]:
        """A block of a long key."""
        keys = np.full(len(rings), key)
        yield links(keys, rings)
        yield _met("member", keys, block, rings, rings)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rings, block = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
        for frame in frames:
            if not len(frame):
                continue
            held = len(keys)
            keys = np.concatenate([keys, frame["key"].to_numpy(np.int64)])
            rings = np.concatenate([rings, frame["ring"].to_numpy(np.int64).view(np.uint64)])
            if block and keys[held] != keys[0]:  # the long key has ended with what was held
                yield from closed(int(keys[0]), rings[:held], block)
                yield _met("blocks", keys[:1], block + 1, rings[:1], rings[:1])
                keys, rings, block = keys[held:], rings[held:], 0
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                end = last
                if block:  # only a key's own rows belong to its last block
                    end = int(np.searchsorted(keys, keys[0], "right"))
                    yield from closed(int(keys[0]), rings[:end], block)
                    yield _met("blocks", keys[:1], block + 1, rings[:1], rings[:1])
                    keys, rings, last, block = keys[end:], rings[end:], last - end, 0
                yield from sized(keys[:last], rings[:last])
                keys, rings = keys[last:], rings[last:]
            while len(keys) > most:
                yield from closed(int(keys[0]), rings[:most], block)
                keys, rings, block = keys[most:], rings[most:], block + 1
        if len(keys):
            if block:
                yield from closed(int(keys[0]), rings, block)
                yield _met("blocks", keys[:1], block + 1, rings[:1], rings[:1])
            else:
                yield links(keys, rings)

    def sized(keys: np.ndarray, rings: np.ndarray) -> Iterator[pd.DataFrame]:
        """Whole keys, of which some may be long."""
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        sizes = np.diff(starts, append=len(keys))
        long = sizes > most
        for lo, size in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
            for block, at in enumerate(range(lo, lo + size, most)):
                yield from closed(int(keys[lo]), rings[at : min(at + most, lo + size)], block)
            yield _met("blocks", keys[lo : lo + 1], -(-size // most), rings[lo : lo + 1], rings[lo : lo + 1])
        short = ~np.repeat(long, sizes)
        if short.any():
            yield links(keys[short], rings[short])

    return read


def _across(met: DataFrame) -> DataFrame:
    """Links between the blocks of a key: each pair of blocks is a group."""
    many = met.where("kind = 'blocks'").selectExpr("key", "block as many")
    each = met.where("kind = 'member'").selectExpr("key", "block", "a as ring").join(many, "key")
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).where("other <> block")
    each = each.selectExpr("key", "least(block, other) as low", "greatest(block, other) as high", "block", "ring")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        first = (frame["block"] == frame["low"]).to_numpy()
        rings, keys = frame["ring"].to_numpy(np.int64).view(np.uint64), frame["key"].to_numpy(np.int64)
        one, two = np.flatnonzero(first), np.flatnonzero(~first)
        forest = Forest(len(rings))
        for i in one.tolist():
            near = two[viable(rings[two] ^ rings[i])]
            forest.add(np.full(len(near), i), near)
        a, b = (np.array([x[k] for x in forest.links], np.int64) for k in (0, 1))
        return pd.DataFrame({"a": _turned_back(keys[a], rings[a]).view(np.int64), "b": _turned_back(keys[b], rings[b]).view(np.int64)})

    return each.groupBy("key", "low", "high").applyInPandas(join, "a long, b long")


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, enough of them to connect all that link."""
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(prints).repartition(parts, "key").sortWithinPartitions("key", "ring")
    met = written(dealt.mapInPandas(_blocks(block), _MET), "simhash-met")
    found = met.where("kind = 'link'").select("a", "b")
    if not met.where("kind = 'blocks'").isEmpty():
        found = found.unionByName(_across(met))
    return found


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits) and component_id."""
    held = written(fingerprints(docs), "fingerprints")
    classes = written(held.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    found = components(links(classes.select("fp"), block)).withColumnRenamed("node", "fp")
    placed = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
