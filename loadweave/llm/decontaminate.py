"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations alone.

Items are cut into windows of ``WINDOW`` consecutive words (shorter items are one window).  To
stand in a document a window must find all its words there, so one necessary word decides: its
prefix is its rarest word, by document frequency over the whole corpus.  Documents' words
meet the prefix words only; a meeting proposes the place where the window would start
(positional filter), if it fits between the text's ends (length filter).  Proposed places
are verified exactly, word by word, against the document's words.

The benchmark's windows, not the corpus, set the size of the joined tables.  They are
broadcast while they number at most ``BROADCAST_ROWS``; beyond, the joins shuffle.

Defined results: null and empty texts and items have no words and hit nothing; repeated
items count each by its item_id (repeated ids once); repeated rows each give a row;
a null item_id counts as no item, though its windows hit; rows with a null doc_id are examined
as others are, told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, columns, row_key, table, written

WINDOW = 10
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text"):
    """Words of a text column after folding A-Z; null texts have none."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(folded, ALNUM_SEPARATORS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key (the window's words joined by spaces) and size of every window."""
    cut = columns(items, item_id="string", text="string").withColumn("w", words()).where("size(w) > 0")
    cut = cut.withColumn("at", F.explode(F.expr(f"sequence(1, greatest(size(w) - {window - 1}, 1))")))
    cut = cut.withColumn("part", F.expr(f"slice(w, at, {window})"))
    return cut.select("item_id", F.array_join("part", " ").alias("key"), F.size("part").alias("size")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, row_key, n_words, hit (sorted places of hit words) and items (sorted ids)."""
    # Rows are told apart by row_key alone, so repeated rows share their findings.
    docs = columns(docs, doc_id="long", text="string").withColumn("row_key", row_key())
    windows = written(item_windows(items, window), "windows")
    distinct = windows.select("key", "size").distinct()
    n_windows = distinct.count()
    vocabulary = written(distinct.select(F.explode(F.split("key", " ")).alias("word")).distinct(), "vocabulary")

    met = docs.select(F.explode(F.array_distinct(words())).alias("word")).join(_small(vocabulary, vocabulary.count()), "word")
    frequency = written(met.groupBy("word").agg(F.count("*").alias("n")), "frequencies")
    # A word that no document holds stays the rarest: its windows then meet nothing at all.
    spelt = distinct.select("key", "size", F.posexplode(F.split("key", " ")).alias("offset", "word")).join(frequency, "word", "left")
    rarest = spelt.groupBy("key", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("r"))
    prefixes = written(rarest.select("key", "size", F.col("r.word").alias("word"), F.col("r.offset").alias("offset")), "prefixes")

    placed = docs.where("row_key is not null").withColumn("w", words()).select("row_key", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "word"))
    proposed = placed.join(_small(prefixes, n_windows), "word").where("at >= offset and at - offset + size <= n_words")
    proposed = proposed.select("row_key", (F.col("at") - F.col("offset")).alias("start"), "size", "key").distinct()
    proposed = proposed.groupBy("row_key").agg(F.collect_list(F.struct("start", "size", "key")).alias("proposed"))

    found = docs.join(proposed, "row_key", "left").withColumn("w", words())
    found = found.withColumn("found", F.expr("filter(coalesce(proposed, array()), p -> array_join(slice(w, p.start + 1, p.size), ' ') = p.key)"))
    found = found.select(
        "doc_id",
        "row_key",
        F.size("w").alias("n_words"),
        F.expr("array_sort(array_distinct(flatten(transform(found, p -> sequence(p.start, p.start + p.size - 1)))))").alias("hit"),
        F.expr("array_distinct(transform(found, p -> p.key))").alias("keys"),
    )
    return _with_items(written(found, "hits"), windows, n_windows)


def _with_items(found: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    pairs = found.where("size(keys) > 0").select("row_key", F.explode("keys").alias("key")).distinct()
    named = pairs.join(_small(windows.select("key", "item_id"), n_windows), "key").where("item_id is not null")
    named = named.groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = found.drop("keys").join(named, "row_key", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    return hits(docs, items, window).select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS key
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, i AS start, size, array_to_string(w[i:i + size - 1], ' ') AS key
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT dw.doc_id, dw.start, dw.size, iw.item_id FROM dw JOIN iw ON dw.key = iw.key AND dw.size = iw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
