"""Near-duplicate detection with SetSketch registers, verified on full sets.

1. Each text becomes its set of distinct five-word shingles.  Equal sets are one class (a node)
   from here on, told apart by a 128-bit digest of the sorted set.
2. A SetSketch has M registers: floor(1 - log_b x), the truncated exponential minimum of the
   set's values under the register's hash.  Registers merge by maximum and agree between two
   sets about as often as the sets overlap.  Runs of ``ROWS`` registers are band keys.
3. Candidates are pairs of classes that share a band key.  They pass a maximum-likelihood
   estimate of their similarity from the counts of larger, smaller and equal registers, jointly
   with the known set sizes (``SLACK`` standard errors below the threshold), before their full
   sets are compared.  Pairs that are in one component already are left out.
4. To meet in few places, classes that share a band key belong to one family: components of
   the star from each key's smallest class to its others, linear in the members.  All candidate
   pairs lie within families, and each class is in one, so its full set travels once.
   Families of up to ``FAMILY_SHINGLES`` shingles in all take step 3 in one task (``linked``).
   The pairs of larger ones are made by joins: star pairs of the band keys first, then, where
   a key's members still fall into several components, those outside its largest one meet the
   others.  Either way the same pairs are estimated and verified in the same manner.
5. Verified links form components (``graphs``).

A pair at op8's threshold misses all bands with a probability of (1 - 0.85**4)**32 < 1e-10,
one at 0.80 with (1 - 0.8**4)**32 < 1e-7.

Defined results: texts without words have an empty set and link with nothing; repeated rows
share one class; rows that share a doc_id with different texts are classes of their own; rows
without a doc_id take part, and their component_id is the smallest doc_id they reach, or null;
those are kept only where that is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, batches, columns, discard, key_columns, keyed, mixed, run_hashes, table, written
from .graphs import components

SHINGLE = 5
THRESHOLD = (85, 100)  # op8's contract; other callers pass their own
REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
SLACK = 6.0
FAMILY_SHINGLES = 8_000_000


def shingle_set(hashes: WordHashes, text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle has are one, no words are none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(hashes.array(words), min(size, len(words))))


def _seeds(registers: int) -> np.ndarray:
    return mixed(np.arange(1, registers + 1, dtype=np.uint64)) | np.uint64(1)


def registers_of(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Truncated, exponentially spaced minima of a non-empty set."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[lo : lo + 1024, None] * seeds).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype("<u2")


def _fit(jaccard: np.ndarray, one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Log likelihood of similarities (a row for each pair) from the counts of larger, smaller and equal registers, given the set sizes."""
    more, less = (one > two).sum(axis=1), (one < two).sum(axis=1)
    same = one.shape[-1] - more - less
    total = (n_one + n_two).astype(np.float64)
    u, v = n_one / total, n_two / total

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p_more = np.clip(chance(u[:, None] - v[:, None] * jaccard), 1e-12, 1)
    p_less = np.clip(chance(v[:, None] - u[:, None] * jaccard), 1e-12, 1)
    p_same = np.clip(1 - p_more - p_less, 1e-12, 1)
    return more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + same[:, None] * np.log(p_same)


def similarity_estimates(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, grid: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of rows of registers, given the set sizes."""
    most = np.minimum(n_one / n_two, n_two / n_one)
    jaccard = (np.arange(grid + 1) / grid)[None, :] * most[:, None]
    return jaccard[np.arange(len(jaccard)), _fit(jaccard, one, two, n_one, n_two).argmax(axis=1)]


def estimated_above(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, floor: float, step: float = 1e-3) -> np.ndarray:
    """Whether the estimate lies above a floor: the likelihood has one peak, so it still rises there.  Sizes that can't reach it are below."""
    points = np.broadcast_to(np.array([[floor - step, floor]]), (len(one), 2))
    fit = _fit(points, one, two, n_one, n_two)
    return (fit[:, 1] >= fit[:, 0]) & (np.minimum(n_one / n_two, n_two / n_one) >= floor)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, digest of the set (null for none) and registers of every row of ``keyed`` docs."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seeds = WordHashes(), _seeds(REGISTERS)
        for frame in batches(frames, "text", 4 << 20):
            rows = []
            for text in frame["text"]:
                shingles = shingle_set(hashes, text)
                if len(shingles):
                    rows.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), registers_of(shingles, seeds).tobytes()))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "registers"])
            for at, name in enumerate(("doc_id", "id", "tag")):
                out.insert(at, name, frame[name].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "id", "tag", "text").mapInPandas(sketch, "doc_id long, id long, tag long, n_shingles long, digest binary, registers binary")


def _keys(registers: np.ndarray) -> np.ndarray:
    """Band keys of rows of registers."""
    bands = REGISTERS // ROWS
    held = registers.reshape(len(registers), bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(held), bands)).copy()
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + held[:, :, r])
    return key.view(np.int64)


def _band_keys(classes: DataFrame) -> DataFrame:
    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                held = np.frombuffer(b"".join(frame["registers"]), "<u2").reshape(len(frame), REGISTERS)
                yield pd.DataFrame({"key": _keys(held).ravel(), "node": np.repeat(frame["node"].to_numpy(np.int64), REGISTERS // ROWS)})

    return classes.select("node", "registers").mapInPandas(keys, "key long, node long")


def _least(threshold: tuple[int, int]) -> float:
    """Estimates below this rule the threshold out."""
    least = threshold[0] / threshold[1]
    return least - SLACK * (least * (1 - least) / REGISTERS) ** 0.5


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Candidate pairs (a, b) whose likelihood estimate doesn't rule the threshold out."""
    floor = _least(threshold)
    one = classes.selectExpr("node as a", "n as n_a", "registers as r_a")
    two = classes.selectExpr("node as b", "n as n_b", "registers as r_b")

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                held = [np.frombuffer(b"".join(part[c]), "<u2").reshape(len(part), REGISTERS) for c in ("r_a", "r_b")]
                n_a, n_b = part["n_a"].to_numpy(np.float64), part["n_b"].to_numpy(np.float64)
                yield part.loc[estimated_above(*held, n_a, n_b, floor), ["a", "b"]]

    return pairs.join(two, "b").join(one, "a").mapInPandas(estimate, "a long, b long")


def _sets(docs: DataFrame, families: DataFrame) -> DataFrame:
    """family, node, n, registers and the sorted shingles of every class that is in a family."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in batches(frames, "text", 4 << 20):
            held = [shingle_set(hashes, t) for t in frame["text"]]
            yield pd.DataFrame({"family": frame["family"], "node": frame["node"], "n": [len(s) for s in held], "registers": frame["registers"], "shingles": [s.tobytes() for s in held]})

    # A shuffled join at every size: the ids are no small side of a large corpus.
    joined = docs.select("id", "tag", "text").join(families.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"])
    return written(joined.mapInPandas(sets, "family long, node long, n long, registers binary, shingles binary"), "sets")


def _alike(one: np.ndarray, two: np.ndarray, threshold: tuple[int, int]) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return threshold[1] * common >= threshold[0] * (len(one) + len(two) - common)


def linked(nodes: list[int], sets: list[np.ndarray], registers: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """Smallest member of each set's component within one family.

    Sets are posted under their band keys, smallest first, by component: a set meets the posted
    ones of other components until it links with one of each; likely ones by their estimate.
    """
    num, den = threshold
    floor = _least(threshold)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets], np.int64)
    keys = _keys(registers).tolist()
    posted: dict[int, dict[int, list[int]]] = {}

    def link(i: int, others: set[int]) -> None:
        """Links i with the others that are verified to be alike, one of each component."""
        asked = np.array(sorted(others), np.int64)
        asked = asked[den * size[asked] >= num * size[i]]
        for lo in range(0, len(asked), 1024):
            part = asked[lo : lo + 1024]
            for j in part[estimated_above(registers[part], registers[i][None, :], size[part], np.broadcast_to(size[i], len(part)), floor)].tolist():
                a, b = root(i), root(j)
                if a != b and _alike(sets[i], sets[j], threshold):
                    parent[max(a, b, key=nodes.__getitem__)] = min(a, b, key=nodes.__getitem__)

    for i in np.argsort(size, kind="stable").tolist():
        met: dict[int, list[list[int]]] = {}
        for key in keys[i]:
            held = posted.setdefault(key, {})
            for r in [r for r in held if parent[r] != r]:  # components that have merged since
                now, gone = root(r), held.pop(r)
                if len(held.setdefault(now, [])) < len(gone):
                    held[now], gone = gone, held[now]
                held[now].extend(gone)
            for r, members in held.items():
                met.setdefault(r, []).append(members)
        # A set like some of a component is mostly like the last of them; only else the others are asked.
        first = {members[-1] for lists in met.values() for members in lists}
        link(i, first)
        apart = [members for r, lists in met.items() if root(r) != root(i) for members in lists if len(members) > 1]
        link(i, set().union(*apart) - first)
        own = root(i)
        for key in keys[i]:
            posted[key].setdefault(own, []).append(i)
    return [nodes[root(i)] for i in range(len(sets))]


def _narrow(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """node, component of the members of families that one task joins."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        registers = np.frombuffer(b"".join(frame["registers"]), "<u2").reshape(len(frame), REGISTERS)
        return pd.DataFrame({"node": frame["node"], "component": linked(frame["node"].tolist(), held, registers, threshold)})

    return sets.groupBy("family").applyInPandas(join, "node long, component long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets meet the threshold exactly."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(frame["s_a"], frame["s_b"], strict=True)], ["a", "b"]]

    joined = pairs.join(sets.selectExpr("node as b", "shingles as s_b"), "b").join(sets.selectExpr("node as a", "shingles as s_a"), "a")
    return written(joined.mapInPandas(verify, "a long, b long"), "verified")


def _wide(met: DataFrame, sets: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """node, component of the members of families too wide for one task."""
    stars = met.where("node <> leader").selectExpr("leader as a", "node as b").distinct()
    first = _verified(_estimated(stars, classes, threshold), sets, threshold)
    found = components(first)
    # Keys whose members are still in several components: the members outside the largest one meet all others.
    placed = met.join(found.select("node", "component"), "node", "left").selectExpr("key", "node", "coalesce(component, node) as component")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = written(placed.join(largest, "key"), "open")
    outside = open_.where("component <> main").selectExpr("key", "node as x", "component as cx")
    rest = open_.selectExpr("key", "node as y", "component as cy", "main")
    pairs = outside.join(rest, "key").where("cx <> cy and (cy = main or x < y)").selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct()
    second = _verified(_estimated(pairs.join(stars, ["a", "b"], "left_anti"), classes, threshold), sets, threshold)
    return components(first.unionByName(second))


def near_duplicates(docs: DataFrame, family_shingles: int = FAMILY_SHINGLES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document: doc_id, its key (id, tag), n_shingles, component_id, kept and chosen.

    kept: the smallest doc_id of its component; chosen: the one key of its component that a
    deduplicated corpus keeps (the same row's, or any one row's where none has a doc_id).
    """
    docs = keyed(columns(docs, doc_id="long", text="string"))
    held = written(sketches(docs), "sketches")
    classes = held.where("digest is not null").groupBy("digest")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "id", "tag")).alias("row"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    # Numbers are given once, as the table is written.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = written(_band_keys(classes), "bands")
    leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    met = written(banded.join(leaders, "key").select("key", "node", "leader"), "met")
    families = components(met.where("node <> leader").selectExpr("leader as a", "node as b")).selectExpr("node", "component as family")
    families = written(families.join(classes, "node").selectExpr("row.id", "row.tag", "node", "family", "registers"), "families")
    full = _sets(docs, families)
    sizes = full.groupBy("family").agg(F.sum("n").alias("n"))
    narrow = sizes.where(F.col("n") <= family_shingles).select("family")
    found = _narrow(full.join(narrow, "family"), threshold)
    wide = sizes.where(F.col("n") > family_shingles).select("family")
    if not wide.isEmpty():
        of_wide = families.join(wide, "family").select("node")
        found = found.unionByName(_wide(met.join(of_wide, "node"), full.join(of_wide, "node"), classes, threshold))
    found = written(found, "components")
    discard(banded, met, families, full)
    member = classes.select("digest", "node", "rep", "row").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = member.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("row").alias("head"))
    member = member.join(heads, "component").select("digest", "component_id", "head")
    out = held.select("doc_id", "id", "tag", "n_shingles", "digest").join(member, "digest", "left")
    empty = F.col("digest").isNull()
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "id", "tag", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        (empty | ((F.col("head.id") == F.col("id")) & (F.col("head.tag") == F.col("tag")))).alias("chosen"),
    )


def deduplicated(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """docs with one row of each component, and all rows without words; all columns stay."""
    found = near_duplicates(docs, threshold=threshold).where("chosen").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), (F.col("n_shingles") > 0).alias("__words")).distinct()
    known = docs.withColumns(dict(zip(("__id", "__tag"), key_columns(), strict=True)))
    joined = known.join(found, ["__id", "__tag"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = joined.where("__words").dropDuplicates(["__id", "__tag"]).select(*names)
    return one.unionByName(joined.where("not __words").select(*names))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=THRESHOLD).select("doc_id", "n_shingles", "component_id", "kept")
