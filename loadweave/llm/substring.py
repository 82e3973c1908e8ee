"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes begin at words.  ``repeats`` deals them to groups by the words at their anchor and
makes prefixes longer where a group would be too large.  Here a group's truncated suffix
tree is built level by level: a node is the set of suffixes that share their first d words,
its children split it by the next word, and a node that one document alone reaches is
dropped at once.  What is left at depth ``WORDS`` are the deep internal nodes; every leaf
below one, except those of its smallest doc_id, starts a window to remove.  Adjacent starts
join to the maximal repeats.

Defined results: a null or empty text has no words and the digest of the empty string;
whole texts count; rows with one doc_id, equal or not, never remove one another; rows without
a doc_id have no smaller one, so they keep all words and remove none.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import WordHashes, table
from .repeats import Rule, covered, repeated_windows, reported, texts

WORDS = 13
#: ASCII white space splits words; bytes.split() splits at exactly these six characters.
ANCHOR_WORDS = 5


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _units(hashes: WordHashes, text: str | None) -> np.ndarray:
    return hashes.array(split_words(text))


def word_rule(length: int = WORDS) -> Rule:
    return Rule(length, min(ANCHOR_WORDS, length), True, _units, WordHashes, "<u8")


def tree_search(length: int):
    """Deep internal nodes of the truncated suffix trees of one group of prefixes."""

    def search(anchor, doc, start, count, place, witness, contexts) -> np.ndarray:
        run = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        words = np.concatenate(contexts)
        begin = np.cumsum([len(c) for c in contexts]) - [len(c) for c in contexts]
        at, owner = begin[run] + offset, doc[run]
        # Roots: one for each prefix and distance from its anchor.
        alive = np.arange(len(run))
        node = _numbered(anchor[run], (place[run] - offset).astype(np.uint64))
        for depth in range(length):
            node = _numbered(node, words[at[alive] + depth])
            least, most = _ends(node, owner[alive])
            wide = least < most
            alive, node = alive[wide], node[wide]
            if not len(alive):
                break
        hit = np.zeros(len(run), bool)
        if len(alive):
            least, _ = _ends(node, owner[alive])
            hit[alive[owner[alive] > least]] = True
        return hit

    return search


def _numbered(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the distinct (node, word) pairs."""
    order = np.lexsort((word, node))
    node, word = node[order], word[order]
    new = np.zeros(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
    out = np.empty(len(node), np.int64)
    out[order] = np.cumsum(new)
    return out


def _ends(node: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest document below each suffix's node."""
    size = int(node.max()) + 1
    least, most = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
    np.minimum.at(least, node, doc)
    np.maximum.at(most, node, doc)
    return least[node], most[node]


def dedup(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and the kept words as text."""
    docs = texts(docs)

    def finish(doc_id, text, places):
        words = split_words(text)
        gone = covered(places, len(words), length)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

    windows = repeated_windows(docs, word_rule(length), tree_search(length))
    return reported(docs, windows, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
