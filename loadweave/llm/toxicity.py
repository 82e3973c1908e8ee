"""Toxicity scores: boosted trees over dense features, calibrated isotonically.

Learning uses a bounded sample of labelled rows (``SAMPLE`` at most, the smallest hashes of
their doc_id, a documented parameter), never rows whose crc32(doc_id) mod 4 is 2.

* Lexicon: log-odds weights of words and of word beginnings by their occurrences in documents of
  either label (up to ``MOST_TIMES`` in one).
  Copies would repeat their rare words, so texts with one minimal five-word-shingle hash
  count once.  Only entries above a support go on; at most ``ENTRIES`` reach the driver.
* Features: lexicon densities at several strengths, the strongest and the summed weight,
  nearness of second-person words to lexicon words, capitals, shouting, exclamation and other
  punctuation rates, and rates of obfuscated words (digits or signs within letters, before and
  after reading them as letters).  labels, lang, source and doc_id are no inputs.
* Two folds: each half's features use the other half's lexicon, so that the trees see the
  lexicon as it will meet unknown texts; calibration fits out-of-fold scores.

Scoring is one pass without a shuffle; only texts and scores pass between Spark and Python.
Defined results: null and empty texts score as a text without words; no usable labels (none, or
of one kind) give every text their mean, or 0; of rows that share a labelled doc_id the smallest
text learns; a null doc_id is never held out.  ``ENTRIES`` bounds the model (its weakest entries
go), not what it reads.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import LOWER, WordHashes, batches, columns, run_hashes, small_batches, table, written

SAMPLE = 16_000
ENTRIES = 6_000
THRESHOLD = 0.3
#: Occurrences of an entry in one document that count.
MOST_TIMES = 5
#: Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch eure usted ustedes vosotros ti tus".split()
)
#: Signs read as letters.
READ_AS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "8": "b", "9": "g"})
_STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_LEVELS = (1.0, 2.0, 3.0, 4.0)
#: Word info is one float: weight, plus these marks.
_OBFUSCATED, _SECOND, _SHOUT, _SINGLE = 1 << 6, 1 << 7, 1 << 8, 1 << 9


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a lower-case word gives: itself, and its beginnings (marked ^)."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def plain(token: str) -> tuple[str, bool]:
    """Lower-case word of a token without outer punctuation; whether signs within were read as letters."""
    word = token.strip(_STRIP).lower()
    if word.isalpha() or not word:
        return word, False
    read = token.lower().strip(".,;:?\"'()[]{}").rstrip("!").translate(READ_AS)
    read = "".join(c for c in read if c.isalpha())
    return (read, True) if len(read) > 2 and any(c.isalpha() for c in word) else (word, False)


class WordInfo(dict):
    """Weight and marks of tokens, remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        word, read = plain(token)
        # Beyond five the weights say no more; they stay below the first mark.
        weight = min(max((self.lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0), 15.0)
        marks = _OBFUSCATED * read + _SECOND * (word in SECOND_PERSON) + _SHOUT * (len(token) > 2 and token.isupper()) + _SINGLE * (len(token) == 1)
        found = self[token] = marks + weight
        return found


def features(info: WordInfo, text: str | None) -> np.ndarray:
    text = text or ""
    tokens = text.split()
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size = max(int(data.sum()), 1)
    letters = max(int(data[65:91].sum() + data[97:123].sum() + data[128:].sum()), 1)
    found = np.fromiter(map(info.__getitem__, tokens), np.float64, len(tokens))
    n = max(len(tokens), 1)
    marks = found.astype(np.int64) >> 6
    weight = found - (marks << 6)
    out = [np.log1p(len(tokens))]
    for level in _LEVELS:
        hits = int((weight >= level).sum())
        out += [hits / n, np.log1p(hits)]
    strong = np.flatnonzero(weight >= 3.0)
    out += [weight.max(initial=0.0), weight.sum() / n, np.sort(weight)[-3:].sum() / 3 if len(weight) else 0.0, len({tokens[i].lower() for i in strong})]
    second = np.flatnonzero(marks & 2)
    near = 0.0
    if len(strong) and len(second):
        at = np.searchsorted(second, strong)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - strong), np.abs(second[np.maximum(at - 1, 0)] - strong))
        near = float((1.0 / (1.0 + gap)).max())
    out += [near, len(second) / n]
    out += [data[65:91].sum() / letters, int(((marks & 4) > 0).sum()) / n, data[33] / size, (data[33:48].sum() + data[58:65].sum()) / size]
    out += [int((marks & 1).sum()) / n, int(((marks & 1 > 0) & (weight >= 2)).sum()) / n, int(((marks & 8) > 0).sum()) / n, data[48:58].sum() / size]
    return np.array(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, calibration: Isotonic | None, mean: float):
        self.lexicon, self.trees, self.calibration, self.mean = lexicon, trees, calibration, mean

    def scores(self, info: WordInfo, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.mean)
        x = np.stack([features(info, t) for t in texts]) if len(texts) else np.zeros((0, len(features(info, None))))
        return self.calibration.apply(self.trees.score(x))


def _lexicon(sample: DataFrame, folds: tuple[int, ...], counts: dict[tuple[int, int], int]) -> dict[str, float]:
    toxic, clean = (sum(counts.get((f, y), 0) for f in folds) for y in (1, 0))
    if not toxic or not clean:
        return {}
    support = max(3, round(0.002 * (toxic + clean)))
    rows = sample.where(F.col("fold").isin(*folds)).groupBy("entry").agg(F.sum("docs").alias("d"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    rows = rows.where(F.col("d") >= support).select("entry", odds.alias("w")).where("w >= 0.7").orderBy(F.desc("w"), "entry").limit(ENTRIES)
    return {r["entry"]: r["w"] for r in rows.collect()}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows outside the held-out remainder."""
    docs = columns(docs, doc_id="long", text="string")
    known = columns(labels, doc_id="long", toxic="int").where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # The sample is at most SAMPLE small rows, whatever the input.
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in batches(frames, "text", 2 << 20):  # the entries take many times the text's room
            keys, entries = [], []
            for text in frame["text"]:
                units = hashes.array((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
                keys.append(int(run_hashes(units, min(5, len(units))).min().view(np.int64)) if len(units) else 0)
                seen = Counter(e for t, k in Counter((text or "").split()).items() for e in entries_of(plain(t)[0]) * min(k, MOST_TIMES))
                entries.append(sorted(f"{e} {min(k, MOST_TIMES)}" for e, k in seen.items() if e))
            # Likely copies share their key, so they share their fold too.
            yield frame.assign(key=keys, fold=np.array(keys, np.int64) >> 8 & 1, entries=entries)

    held = written(sample.mapInPandas(spell, "doc_id long, text string, toxic int, key long, fold int, entries array<string>"), "labelled")
    single = held.groupBy("key", F.col("toxic").alias("label")).agg(F.max("fold").alias("fold"), F.max("entries").alias("entries"))
    counts = {(r["fold"], r["label"]): r["n"] for r in single.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    pairs = single.select("fold", "label", F.explode("entries").alias("e")).withColumn("e", F.split("e", " "))
    entries = pairs.select("fold", F.col("e")[0].alias("entry"), (F.col("label") == 1).alias("is_toxic"), F.col("e")[1].cast("int").alias("times"))
    times = lambda kind: F.sum(F.when(kind, F.col("times")).otherwise(0))
    sums = entries.groupBy("entry", "fold").agg(F.count_if("is_toxic").alias("docs"), times(F.col("is_toxic")).alias("toxic"), times(~F.col("is_toxic")).alias("clean")).where("docs > 0")
    sums = written(sums, "entries")
    lexicons = [_lexicon(sums, (1,), counts), _lexicon(sums, (0,), counts), _lexicon(sums, (0, 1), counts)]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infos = [WordInfo(lexicons[0]), WordInfo(lexicons[1])]
        for frame in batches(frames, "text", 2 << 20):
            if len(frame):
                x = [features(infos[f], t).tolist() for t, f in zip(frame["text"], frame["fold"], strict=True)]
                yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "fold": frame["fold"], "x": x})

    rows = held.select("doc_id", "text", "toxic", "fold").mapInPandas(measure, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in rows], np.float64)
    mean = float(y.mean()) if len(y) else 0.0
    if len(y) < 20 or mean in (0.0, 1.0):
        return Model({}, None, None, mean)
    x, fold = np.array([r["x"] for r in rows]), np.array([r["fold"] for r in rows])
    outside = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any() and (fold != f).any():
            outside[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).score(x[fold == f])
    return Model(lexicons[2], Boosted().fit(x, y), Isotonic().fit(outside, y), mean)


def score_of(text: Column, model: Model) -> Column:
    """The model's score of a text column."""

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        info = WordInfo(model.lexicon)
        for part in series:
            yield pd.Series(model.scores(info, part.tolist()), dtype=np.float64)

    return score(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = columns(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts to be toxic; all columns stay."""
    kept = small_batches(docs).withColumn("__score", score_of(F.col("text").cast("string"), model))
    return kept.where(F.col("__score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
