"""Ranked lexical search as a blocked sparse matrix product.

The score of a document for an item is an entry of the product of two sparse matrices: items by
terms (how often a term counts for an item) and terms by documents (int64 impacts, the term's
weight times a saturated share of its occurrences).

1. Items' terms are counted in Spark and dealt to blocks of about ``TERMS`` terms (an item is
   never cut); a block, once its size is known to keep to that, is what tasks hold of the items.
2. One pass over whole texts gives each document's length and its occurrences of the block's terms: the
   columns of the term-document matrix, written as packed arrays.  Document frequencies are
   summed from them, the number and length of all documents from the lengths.
3. Blocks of ``DOCUMENTS`` columns are turned into rows (postings) and multiplied row by row
   (Gustavson): each of an item's terms adds its row of impacts to the item's accumulator.  A task keeps
   the k best of each item over its blocks, with ties in order, and returns those alone.
4. The tasks' best meet by item, first within salts, then all.

Every document is scored for every item; nothing is pruned.  All but the weight's logarithm is
64-bit integer arithmetic.

Defined results: null and empty texts have no terms: they neither count nor match; items without
terms, or with terms that no document holds, give no rows; rows of one item_id are one item with the terms of all;
rows without an item_id are no items; rows that share a doc_id are documents of their own; rows without a
doc_id are ranked too, behind those of their score that have one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM_FOLD, batches, columns, table, written

BEST = 50
#: Terms of a block of items; a block of several items has at most twice as many.
TERMS = 200_000
#: Documents whose columns are multiplied at a time.
DOCUMENTS = 8192
#: Bytes of a text whose terms are counted at a time.
PIECE = 1 << 20
SALTS = 256


def term_counts(text: str | None, wanted: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each (or each wanted one, by its number) occurs."""
    data = text.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD) if text else b""
    many, found, at = 0, Counter(), 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        cut = len(data) if cut < 0 else cut
        terms = data[at:cut].split()
        many += len(terms)
        if wanted is None:
            found.update(terms)
        else:
            found.update(filter(wanted.__contains__, terms))
        at = cut
    return many, found if wanted is None else Counter({wanted[t]: n for t, n in found.items()})


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and its occurrences in the item's texts."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 4 << 20):
            rows = [(i, t.decode("utf-8", "surrogatepass"), n) for i, text in zip(frame["item_id"], frame["text"], strict=True) for t, n in term_counts(text)[1].items()]
            yield pd.DataFrame(rows, columns=["item_id", "term", "n"])

    known = columns(items, item_id="long", text="string").where("item_id is not null and text is not null")
    return known.mapInPandas(cut, "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _blocks(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Terms with the block of their item, and the number of blocks: none holds over 2 * most terms, but a single item's."""
    blocks = max(1, -(-terms.count() // most))
    while True:
        dealt = terms.withColumn("block", F.expr(f"cast(pmod(xxhash64(item_id), {blocks}) as int)"))
        sizes = dealt.groupBy("block", "item_id").agg(F.count("*").alias("n")).groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if sizes.where(f"n > {2 * most} and items > 1").isEmpty():
            return dealt, blocks
        blocks *= 2


class Items:
    """The item-term matrix of a block of items, by rows."""

    def __init__(self, rows, repeats: bool):
        self.terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        self.ids = sorted({r["item_id"] for r in rows})
        of: dict[int, list[tuple[int, int]]] = {i: [] for i in self.ids}
        for r in rows:
            of[r["item_id"]].append((self.terms[r["term"]], r["n"] if repeats else 1))
        self.rows = [sorted(of[i]) for i in self.ids]

    def numbers(self) -> dict[bytes, int]:
        return {t.encode("utf-8", "surrogatepass"): i for t, i in self.terms.items()}


def term_documents(docs: DataFrame, items: Items) -> DataFrame:
    """The term-document matrix by columns: id (the last where none), none, n, terms and tfs (packed) of documents with terms."""
    numbers = items.numbers()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 4 << 20):
            rows = []
            for i, none, text in zip(frame["id"], frame["none"], frame["text"], strict=True):
                many, found = term_counts(text, numbers)
                if many:
                    rows.append((i, none, many, np.fromiter(found.keys(), "<i4", len(found)).tobytes(), np.fromiter(found.values(), "<i8", len(found)).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "none", "n", "terms", "tfs"])

    known = columns(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    return known.mapInPandas(count, "id long, none boolean, n long, terms binary, tfs binary")


def document_frequencies(matrix: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(terms, np.int64)
        for frame in frames:
            held += np.bincount(np.frombuffer(b"".join(frame["terms"]), "<i4"), minlength=terms)
        yield pd.DataFrame({"term": np.flatnonzero(held), "n": held[held > 0]})

    out = np.zeros(terms, np.int64)
    for r in matrix.select("terms").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of a block at most
        out[r["term"]] = r["n"]
    return out


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)


def _best(score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id, those without one last."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], none[near], -score[near]))[:k]]


def product(matrix: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item_id, score, none, id of the k best of each item in each task."""
    rows = [[(t, n) for t, n in row if weight[t] > 0] for row in items.rows]

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [empty] * len(rows)
        for frame in _joined(frames, DOCUMENTS):
            ids, none = frame["id"].to_numpy(np.int64), frame["none"].to_numpy(bool)
            terms, tf = np.frombuffer(b"".join(frame["terms"]), "<i4"), np.frombuffer(b"".join(frame["tfs"]), "<i8")
            sizes = np.fromiter(map(len, frame["terms"]), np.int64, len(frame)) // 4
            m = 50 + (50 * frame["n"].to_numpy(np.int64) * documents) // length
            document = np.repeat(np.arange(len(frame)), sizes)
            impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[document]))
            order = np.argsort(terms, kind="stable")
            starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))
            document, impact = document[order], impact[order]
            score = np.zeros(len(frame), np.int64)
            for at, row in enumerate(rows):
                for t, n in row:
                    lo, hi = starts[t], starts[t + 1]
                    score[document[lo:hi]] += impact[lo:hi] * n  # a document stands once in a row
                held = best[at]
                near = np.flatnonzero(score > 0 if len(held[0]) < k else score >= held[0][-1])
                if len(near):
                    near = near[_best(score[near], none[near], ids[near], k)]
                    merged = tuple(np.concatenate(x) for x in zip(held, (score[near], none[near], ids[near]), strict=True))
                    kept = _best(*merged, k)
                    best[at] = tuple(x[kept] for x in merged)
                score[:] = 0
        sizes = [len(b[0]) for b in best]
        yield pd.DataFrame({"item_id": np.repeat(np.array(items.ids, np.int64), sizes), **{name: np.concatenate([b[j] for b in best]) for j, name in enumerate(("score", "none", "id"))}})

    return matrix.mapInPandas(multiply, "item_id long, score long, none boolean, id long")


def _joined(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Consecutive frames as one of ``rows`` rows or a few more."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if any(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, repeats: bool = False, terms_each: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest-scoring documents of each item.

    repeats: whether a term that stands several times in an item counts as often.
    """
    dealt, blocks = _blocks(written(item_terms(items), "item-terms"), terms_each)
    found = None
    for block in range(blocks):
        held = Items(dealt.where(F.col("block") == block).collect(), repeats)
        if not held.ids:
            continue
        matrix = written(term_documents(docs, held), "term-documents")
        documents, length = matrix.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        weight = weights(document_frequencies(matrix, len(held.terms)), documents)
        part = product(matrix, held, weight, documents, length, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.col("score").desc(), "none", "id")
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", F.col("rank").cast("int"), F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
