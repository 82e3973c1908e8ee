"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other ASCII byte that is no letter or digit to a space; bytes of other characters stay.
ALNUM_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Java pattern of the same fold's separators.
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between Spark and Python: bounded by size, not by rows, as texts differ by orders of magnitude.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches are held to ``BATCH_BYTES``, unless a smaller bound is set already."""
    conf = df.sparkSession.conf
    held = str(conf.get(_BATCH_CONF))
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, cast; whatever else the table holds can't clash later."""
    return small_batches(df).select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()])


def row_key() -> Column:
    """Tells rows apart by their doc_id and 128 hash bits of their text: rows without an id, or of one id, too.

    Rows equal in both share a key, and so what is found in their text.
    """
    return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))


def key_columns() -> tuple[Column, Column]:
    """(id, tag) of a row: its doc_id and 30 hash bits of its text, or 94 of its text alone."""
    text = F.col("text").cast("string")
    tag = F.xxhash64(F.lit(1), text).bitwiseAND(F.lit((1 << 30) - 1)) * 2 + F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("id"), tag.alias("tag")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of each row; rows equal in both columns share one."""
    return docs.select("doc_id", "text", *key_columns())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset a local master gets a temporary folder; a cluster is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = tempfile.mkdtemp(prefix="loadweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of the tables that ``written`` made and nothing has discarded yet: the process's, or a run's own.
_HELD: ContextVar[set[str]] = ContextVar("held", default=set())


@contextmanager
def own_tables() -> Iterator[set[str]]:
    """Within it ``written``, ``standing`` and ``sweep`` know the tables of this run alone, whatever else the process does."""
    token = _HELD.set(set())
    try:
        yield _HELD.get()
    finally:
        _HELD.reset(token)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: later reads survive the loss of any executor.

    Results read such tables when they are computed, so those that a result needs stay until ``sweep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    _HELD.get().add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _HELD.get().discard(path)


def standing() -> set[str]:
    """Paths of the run's tables that stand."""
    return set(_HELD.get())


def sweep(spark: SparkSession, but: set[str] | frozenset[str] = frozenset()) -> int:
    """Deletes the tables that this run wrote for its operators, once their results are stored, but some; how many."""
    gone = sorted(_HELD.get() - but)
    for path in gone:
        _delete(spark, path)
    return len(gone)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing still to be computed reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def input_bytes(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them (file sizes, for a scan); measured where it has no statistics."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 50 else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def spread(df: DataFrame, bytes_each: int, least: int = 64) -> int:
    """A power of two of groups, in proportion to the input, so that each stays near bytes_each."""
    groups = least
    while groups * bytes_each < input_bytes(df) and groups < 1 << 20:
        groups *= 2
    return groups


class WordHashes(dict):
    """64-bit hashes of words, kept up to ``most`` words at a time (then begun anew)."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _M1
    out ^= out >> np.uint64(27)
    out *= _M2
    out ^= out >> np.uint64(31)
    return out


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive tokens (uint64), by doubling: O(n log length)."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = tokens.astype(np.uint64), 1, None, 0
    power = mixed(power + _GOLD)
    while True:
        if length & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mixed(out * _GOLD + part)
            done += size
        if size * 2 > length:
            return out
        power = mixed(power[: len(power) - size] * _GOLD + power[size:])
        size *= 2


def window_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (its upper 32 bits; leftmost on ties) among each ``width`` consecutive ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def give_back() -> None:
    """Returns memory that this worker has freed to the system: its room is that of one batch, not of all it has seen."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gathered(frames, text: str, most: int):
    """Consecutive frames as one, up to ``most`` characters of text or a single frame."""
    import pandas as pd

    held, size = [], 0
    for frame in frames:
        own = int(frame[text].str.len().sum())
        if held and size + own > most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
        held.append(frame)
        size += own
    if held:
        yield pd.concat(held, ignore_index=True)


def batches(frames, text: str, most: int):
    """Slices of pandas frames, each of up to ``most`` characters of text or a single row.

    Freed memory goes back to the system between frames, so that a worker's room is that of a batch.
    """
    for frame in frames:
        give_back()
        sizes = frame[text].str.len().fillna(0).to_numpy()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield frame.iloc[first:i]
                first, held = i, 0
            held += size
        if first < len(frame):
            yield frame.iloc[first:]
