"""Stupid-backoff language-model scores of every document, from counts over all documents.

A document goes to a batch by a hash.  A batch lists its distinct n-grams once (hashes,
sorted) with their counts, so the frequent ones are summed before they travel.  The
lists are dealt by n-gram hash: each bucket of the count tables sums its part and answers
every batch with the corpus counts in the batch's own order.  The batch joins the answers
to its exploded n-grams and sums a score for each document.  Only lists, answers and the
documents of a batch meet in a task; the buckets grow in number with the input.

Score of a word: alpha**k * c(n-gram) / c(context) at the longest order n whose n-gram occurs
at least ``cutoff`` times, k orders below the longest one there (a document's first words
have shorter contexts); at order 1, c(word) / all words.  The corpus contains the scored
text itself, so a cutoff of 2 asks for one more occurrence.

Defined results: texts without words score 0 with no words (their mean is null); repeated
rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_FOLD, WordHashes, columns, give_back, input_bytes, run_hashes, spread, table, written

ORDER, ALPHA, CUTOFF = 3, 0.4, 2
BATCH_BYTES = 5 << 20
#: Bits of an n-gram's hash.  A shared hash adds two counts; with 1e13 distinct n-grams one in 10 000 would.
HASH_BITS = 56


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    hashes = WordHashes(100_000)
    units = [hashes.array(t.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD).split() if t else []) for t in texts]
    return np.concatenate(units) if units else np.zeros(0, np.uint64), np.array([len(u) for u in units], np.int64)


def _grams(tokens: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within documents and the positions of their last words."""
    hashes = run_hashes(tokens, n) >> np.uint64(64 - HASH_BITS)
    inside = doc[: len(hashes)] == doc[n - 1 : n - 1 + len(hashes)]
    first = np.flatnonzero(inside)
    return hashes[first], first + n - 1


def _packed(values: np.ndarray) -> bytes:
    """Ascending values as differences, byte plane by byte plane, without the planes that are all zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() + bytes([width])


def _unpacked(blob: bytes) -> np.ndarray:
    width = blob[-1]
    planes = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    planes[:, :width] = np.frombuffer(blob, np.uint8, len(blob) - 1).reshape(width, -1).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cutoff: int = CUTOFF) -> DataFrame:
    """doc_id, n_words, n_top (words scored at the longest order), log10_score, mean_log10."""
    docs = columns(docs, doc_id="long", text="string")
    count = max(1, -(-input_bytes(docs) // BATCH_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("batch", F.expr(f"cast(pmod(xxhash64(doc_id, text), {count}) as int)"))
    groups = spread(docs, 4 << 20, 32)
    shift = np.uint64(HASH_BITS - groups.bit_length() + 1)

    def list_grams(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        tokens, lengths = _tokens(frame["text"])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        rows = []
        for n in range(1, order + 1):
            grams, counts = np.unique(_grams(tokens, doc, n)[0], return_counts=True)
            bucket = (grams >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for g, c, b in zip(np.split(grams, cuts), np.split(counts, cuts), np.split(bucket, cuts), strict=True):
                if len(g):
                    rows.append((n, int(b[0]), int(frame["batch"].iloc[0]), _packed(g), zlib.compress(c.astype("<u4").tobytes(), 1)))
        return pd.DataFrame(rows, columns=["n", "bucket", "batch", "grams", "counts"])

    def sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame.sort_values("batch")
        lists = [_unpacked(g) for g in frame["grams"]]
        counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in frame["counts"]])
        grams = np.concatenate(lists)
        sequence = np.argsort(grams, kind="stable")
        ordered = grams[sequence]
        head = np.ones(len(ordered), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(head) - 1
        totals = np.empty(len(grams), np.int64)
        totals[sequence] = np.bincount(group, counts[sequence]).astype(np.int64)[group]
        parts = np.split(totals, np.cumsum([len(x) for x in lists])[:-1])
        words = [int(np.frombuffer(zlib.decompress(c), "<u4").sum()) if n == 1 else 0 for n, c in zip(frame["n"], frame["counts"], strict=True)]
        return pd.DataFrame({"n": frame["n"], "bucket": frame["bucket"], "batch": frame["batch"], "words": words, "totals": [zlib.compress(p.astype("<u8").tobytes(), 1) for p in parts]})

    lists = docs.groupBy("batch").applyInPandas(list_grams, "n int, bucket int, batch int, grams binary, counts binary")
    answers = lists.groupBy("n", "bucket").applyInPandas(sum_counts, "n int, bucket int, batch int, words long, totals binary")
    answers = written(answers, "counts")

    total = answers.agg(F.sum("words")).first()[0] or 0
    log_alpha = float(np.log10(alpha))

    def score(frame: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        give_back()
        tokens, lengths = _tokens(frame["text"])
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        begin = np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        longest = np.minimum(np.arange(len(tokens), dtype=np.int32) - begin + 1, order).astype(np.int8)
        del begin

        def corpus_counts(n: int) -> np.ndarray:
            """Corpus count of the n-gram that ends at each word; 0 where it would begin before the document."""
            seen = np.zeros(len(tokens), np.int64)
            grams, last = _grams(tokens, doc, n)
            if len(grams):
                totals = np.concatenate([np.frombuffer(zlib.decompress(b), "<u8") for b in answer[answer["n"] == n].sort_values("bucket")["totals"]])
                seen[last] = totals.view(np.int64)[np.unique(grams, return_inverse=True)[1]]
            return seen

        value, done = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
        top, seen = np.zeros(len(tokens), bool), corpus_counts(order)
        for n in range(order, 0, -1):
            if n > 1:
                context = corpus_counts(n - 1)
                at = np.flatnonzero(~done & (seen >= cutoff))
                value[at] = np.log10(seen[at] / context[at - 1])
            else:
                at = np.flatnonzero(~done)
                value[at] = np.log10(seen[at] / max(total, 1))
            value[at] += (longest[at] - np.int8(n)) * log_alpha
            done[at] = True
            if n == order:
                top[at] = True
            if n > 1:
                seen = context
        summed = np.bincount(doc, value, len(lengths))
        out = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(), "n_words": lengths, "n_top": np.bincount(doc, top, len(lengths)).astype(np.int64), "log10_score": summed})
        out["mean_log10"] = [s / k if k else None for s, k in zip(summed, lengths, strict=True)]
        return out.astype({"doc_id": "Int64", "mean_log10": "float64"})

    scored = docs.groupBy("batch").cogroup(answers.drop("words").groupBy("batch")).applyInPandas(score, "doc_id long, n_words long, n_top long, log10_score double, mean_log10 double")
    return scored.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("mean_log10")))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("log10_score", "mean_log10")})
