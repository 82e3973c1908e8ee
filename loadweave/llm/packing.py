"""Best-fit packing of token sequences, planned on a length histogram.

Documents are encoded once; only digests, lengths and places go on.  Pieces of the full
sequence length need no plan.  Of the others only the histogram (at most 4095 lengths)
reaches the driver, where best-fit decreasing runs over counts: a bin is a range of equal
sequences, so one step places thousands of documents.  The plan is a table of
(length, first rank, last rank, first sequence, offset); documents take their slots by an
equi-join on (length, rank block), after ranking within length from per-partition counts.
No window spans a length, so a length that holds a third of all rows is dealt like any other.

Defined results: a null or empty text is the single token 1; repeated rows are packed each
on its own; an empty table gives no rows; longer documents are cut into full pieces.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, table, written

END_ID = 1
RANK_BLOCK = 1024
_LONG_CHUNK = 64


class ChunkEncoder:
    """Ids of whole texts, from ids of the pieces between plain spaces and newlines.

    The pre-tokenizer's pattern matches no white space and the normalizer doesn't join
    characters over it, so pieces encode independently.  A new piece of printable ASCII
    without an apostrophe is lower-cased and cut where the pattern cuts it (runs of letters,
    single digits, runs of signs).  Unknown words go to the tokenizer together and are told
    apart by the tokens that end a word; other pieces go one by one.  Texts that
    contain the start of an added token go there whole.  Up to ``most`` pieces are remembered.
    """

    _PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words (each one match of the pattern): encoded together, cut after word ends."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):  # a word that the tokenizer cuts otherwise
            return self._raw(words)
        data, starts = ids.tobytes(), [0, *cuts[:-1].tolist()]
        return [data[a:b] for a, b in zip(starts, cuts.tolist(), strict=True)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new pieces: short ones are remembered, long ones only returned."""
        known, words, new = self.known, set(), []
        same: list[tuple[str, str]] = []
        cut: list[tuple[str, list[str]]] = []
        for chunk in chunks:
            if chunk.isalpha():
                if chunk.isascii():
                    low = chunk.lower()
                    if low not in known:
                        words.add(low)
                    if low != chunk:
                        same.append((chunk, low))
                elif "Σ" not in chunk and chunk.lower().isalpha() and is_normalized("NFC", chunk):
                    words.add(chunk)
                else:
                    new.append(chunk)
            elif chunk.isascii() and chunk.isprintable() and "'" not in chunk:
                parts = self._PARTS.findall(chunk.lower())
                cut.append((chunk, parts))
                for part in parts:
                    if part not in known:
                        words.add(part)
            else:
                new.append(chunk)
        ordered = list(words)
        found = dict(zip(ordered, self._words(ordered), strict=True))
        found.update(zip(new, self._raw(new) if new else (), strict=True))
        extra: dict[str, bytes] = {}
        if found and max(map(len, found)) > _LONG_CHUNK:
            extra = {piece: ids for piece, ids in found.items() if len(piece) > _LONG_CHUNK}
            for piece in extra:
                del found[piece]
        known.update(found)
        for chunk, low in same:
            (known if len(chunk) <= _LONG_CHUNK else extra)[chunk] = known[low] if low in known else extra[low]
        for chunk, parts in cut:
            ids = b"".join([known[p] if p in known else extra[p] for p in parts])
            (known if len(chunk) <= _LONG_CHUNK else extra)[chunk] = ids
        return extra

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        What is made here holds no cycles, and looking for some among a million pieces takes a fifth of the time.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
            self.known[""] = b""
        split = [None if "<|" in t else t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        extra = self._learn(set().union(*[chunks for chunks in split if chunks]).difference(known))
        out: list[bytes] = []
        for text, chunks in zip(texts, split, strict=True):
            if chunks is None:
                out += self._raw([text])
            elif extra:
                out.append(b"".join([known[c] if c in known else extra[c] for c in chunks]))
            else:
                out.append(b"".join(map(known.__getitem__, chunks)))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker process, so that what one has learned serves the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, offset).

    Bins are ranges of sequences with equal room, so the work depends on the number of
    lengths, not of documents.  Every length goes, longest first, to the open bins with
    the least sufficient room; what is left opens new ones, as many to a bin as fit.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    next_sequence = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in by_room:
                by_room[room] = []
                _insert(rooms, room)
            by_room[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = _at_least(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
                each = min(room // length, -(-left // count)) if count < left else 1
                use = min(count, left // each)
                put(room, first + use, count - use)
            else:
                room, each = capacity, min(capacity // length, left)
                use = left // each
                first = next_sequence
                next_sequence += use
            for k in range(each):
                rows.append((length, rank, use, first, capacity - room + k * length))
                rank += use
            left -= use * each
            put(room - each * length, first, use)
    return rows


def _at_least(rooms: list[int], length: int) -> int:
    from bisect import bisect_left

    return bisect_left(rooms, length)


def _insert(rooms: list[int], room: int) -> None:
    from bisect import insort

    insort(rooms, room)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, its place within its task and length, and its
    ids (little-endian unsigned 32-bit) where they are asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = encoder_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in batches(frames, "text", 1 << 20):
            out: list[tuple] = []
            if len(part):
                texts = part["text"].where(part["text"].notna(), "").tolist()
                for doc_id, ids in zip(part["doc_id"].tolist(), encoder.encode(texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        own = ids if total <= capacity else ids[4 * start : 4 * (start + length)]
                        out.append((doc_id, piece, start, length, zlib.crc32(own), task, int(seen[length]), *((own,) if with_ids else ())))
                        seen[length] += 1
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local", *(("ids",) if with_ids else ())])
            yield made.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long" + ", ids binary" * with_ids
    return columns(docs, doc_id="long", text="string").mapInPandas(encode, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset, and their ids where asked for; see the module's text for the method.

    Ids stay out of the ranking; they meet the places of their pieces in one join at the end.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    shorter = made.where(F.col("length") < capacity)
    counts = written(shorter.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(histogram, capacity)
    ranges = spark.createDataFrame(
        pd.DataFrame(plan, columns=["length", "lo", "ranks", "sequence", "offset"]), "length long, lo long, ranks long, sequence long, offset long"
    ) if plan else spark.createDataFrame([], "length long, lo long, ranks long, sequence long, offset long")
    ranges = ranges.withColumn("block", F.explode(F.expr(f"sequence(lo div {RANK_BLOCK}, (lo + ranks - 1) div {RANK_BLOCK})")))

    # Ranks of a task's rows of a length start where those of earlier tasks end: a window over (tasks x lengths) rows.
    # These grow with the tasks, so they meet the pieces by a shuffle, never by a broadcast.
    bases = counts.selectExpr("length", "task", "sum(n) over (partition by length order by task) - n as base")
    ranked = shorter.join(bases.hint("merge"), ["length", "task"]).selectExpr("*", "base + local as rank", f"(base + local) div {RANK_BLOCK} as block")
    # A range more for each RANK_BLOCK documents: neither side may be broadcast, whatever a local plan's size says.
    placed = ranked.join(ranges.hint("merge"), ["length", "block"]).where("rank >= lo and rank < lo + ranks")
    result = ["doc_id", "piece", "start", "length", "ids_crc32", *(("task", "local") if with_ids else ())]
    placed = placed.selectExpr(*result, "2 * (sequence + rank - lo) as sequence_id", "offset")
    # Full pieces fill a sequence each; odd numbers, unique by (task, place in the task).
    full = made.where(F.col("length") == capacity).selectExpr(*result, "2 * (cast(task as bigint) * 4294967296 + local) + 1 as sequence_id", "0L as offset")
    places = placed.unionByName(full)
    if not with_ids:
        return places
    tokens = made.select("length", "task", "local", "ids")
    return places.join(tokens.hint("merge"), ["length", "task", "local"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def sequences(places: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of the packed sequences of ``packed`` rows with ids: at most the capacity each."""
    one = places.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return one.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda held, part: F.concat(held, part["ids"])).alias("ids"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
