"""Byte-exact repeats by a hash-compared suffix sort.

``repeats`` samples suffixes at anchors and deals them to groups.  Within a group the suffixes
of the remaining contexts are sorted by a mergesort whose comparisons are logarithmic: prefix
polynomial hashes of the contexts give the hash of any stretch in O(1), a binary search over
stretches finds the common extension of two suffixes, and the next byte decides.  All
merges of a level run as array operations: the place of a suffix is its place in its own
run plus its rank in the sibling run.  Neighbours in sorted order whose common extension
reaches ``BYTES`` are compared byte by byte before they count (collision verification).

Defined results: a null or empty text has no bytes and the digest of no bytes; repeated rows
are places of their own, so both lose what they share, and so are rows without a doc_id and
rows of one doc_id with different texts; matches never cross documents.  ``repeats`` says how
surely contexts that repeat as a whole are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import mixed, table
from .repeats import _BASE, _INVERSE, Rule, _powers, covered, repeated_windows, reported, texts

BYTES = 200
ANCHOR_BYTES = 64


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _units(_, text: str | None) -> np.ndarray:
    return np.frombuffer(raw(text), np.uint8)


def byte_rule(length: int = BYTES) -> Rule:
    return Rule(length, min(ANCHOR_BYTES, length), False, _units, lambda: None, "u1")


class Contexts:
    """Contexts end to end, with prefix polynomial hashes."""

    def __init__(self, contexts: list[np.ndarray], length: int):
        self.length = length
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.bytes = np.concatenate(contexts)
        relative = np.arange(len(self.bytes)) - np.repeat(self.begin, sizes)
        longest = int(sizes.max()) + 1
        self.up, down = _powers(_BASE, longest), _powers(_INVERSE, longest)
        values = mixed(self.bytes.astype(np.uint64) + np.uint64(1)) * down[relative]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def hashes(self, place: np.ndarray, relative: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[place + size] - self.sums[place]) * self.up[relative]

    def common(self, p: np.ndarray, pr: np.ndarray, q: np.ndarray, qr: np.ndarray) -> np.ndarray:
        """Common extension, up to the window's length, of suffixes at places p and q."""
        low = np.zeros(len(p), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            size = low + step
            fits = size <= self.length
            tried = np.where(fits, size, low)
            same = fits & (self.hashes(p, pr, tried) == self.hashes(q, qr, tried))
            low = np.where(same, size, low)
            step >>= 1
        return low

    def less(self, p, pr, q, qr, or_equal: np.ndarray) -> np.ndarray:
        common = self.common(p, pr, q, qr)
        whole = common >= self.length
        next_byte = np.minimum(common, self.length - 1)
        return np.where(whole, or_equal, self.bytes[p + next_byte] < self.bytes[q + next_byte])


def merge_sorted(held: Contexts, at: np.ndarray, relative: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within each group (group: ascending numbers), by a bottom-up mergesort."""
    n = len(at)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(head, n))
    begin, end = np.repeat(head, size), np.repeat(head + size, size)
    order = np.arange(n)
    slot = np.arange(n)
    width = 1
    largest = int(size.max())
    while width < largest:
        own_run = (slot - begin) // width
        sibling = begin + (own_run ^ 1) * width
        rank_low, rank_high = np.zeros(n, np.int64), np.clip(end - sibling, 0, width)
        right = (own_run & 1).astype(bool)
        open_ = np.flatnonzero(rank_low < rank_high)
        while len(open_):
            middle = (rank_low[open_] + rank_high[open_]) // 2
            mine, other = order[slot[open_]], order[sibling[open_] + middle]
            # A right-hand suffix comes after equal left-hand ones: the sort is stable.
            before = held.less(at[other], relative[other], at[mine], relative[mine], right[open_])
            rank_low[open_] = np.where(before, middle + 1, rank_low[open_])
            rank_high[open_] = np.where(before, rank_high[open_], middle)
            open_ = open_[rank_low[open_] < rank_high[open_]]
        target = begin + (own_run // 2) * 2 * width + (slot - begin) % width + rank_low
        merged = np.empty(n, np.int64)
        merged[target] = order[slot]
        order = merged
        width *= 2
    return order


def sort_search(length: int):
    """Windows of one group of prefixes that a sorted neighbour equals."""

    def search(anchor, doc, start, count, place, witness, contexts) -> np.ndarray:
        held = Contexts(contexts, length)
        run = np.repeat(np.arange(len(count)), count)
        relative = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        at = held.begin[run] + relative
        offset, prefix = place[run] - relative, anchor[run]
        # Equal windows of a prefix have equal hashes, so windows whose hash is alone need no sorting.
        whole = mixed(held.hashes(at, relative, np.full(len(at), length)) ^ mixed(prefix + offset.astype(np.uint64)))
        _, alike, count_of = np.unique(whole, return_inverse=True, return_counts=True)
        key = np.flatnonzero(count_of[alike] > 1)
        key = key[np.lexsort((offset[key], prefix[key]))]
        offset, prefix = offset[key], prefix[key]
        group = np.cumsum(np.append(False, (offset[1:] != offset[:-1]) | (prefix[1:] != prefix[:-1])))[: len(key)]
        hit = np.zeros(len(run), bool)
        if len(key):
            order = key[merge_sorted(held, at[key], relative[key], group)]
            pair = np.flatnonzero(group[1:] == group[:-1])
            p, q = order[pair], order[pair + 1]
            alike = held.common(at[p], relative[p], at[q], relative[q]) >= length
            p, q = p[alike], q[alike]
            windows = np.lib.stride_tricks.sliding_window_view(held.bytes, length)
            for lo in range(0, len(p), 8192):
                one, two = p[lo : lo + 8192], q[lo : lo + 8192]
                equal = (windows[at[one]] == windows[at[two]]).all(axis=1)
                hit[one[equal]] = True
                hit[two[equal]] = True
        return hit & ~witness[run]

    return search


def dedup(docs: DataFrame, length: int = BYTES) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    docs = texts(docs)

    def finish(doc_id, text, places):
        data = raw(text)
        gone = covered(places, len(data), length)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
        return doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept

    windows = repeated_windows(docs, byte_rule(length), sort_search(length))
    return reported(docs, windows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
