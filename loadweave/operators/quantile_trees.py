"""Boosted trees with pinball loss, grown from histogram aggregates over a DataFrame.

MLlib's trees know no quantile loss.  Here the rows stay where they are: features become bin numbers (cut at
approximate quantiles, missing values a bin of their own), and each level of a tree takes one pass that sums
gradients by (model, node, feature, bin) within its tasks and then over all of them.  The driver sees sums
only, as many as models, nodes, features and bins.  A leaf's value is the quantile of its rows' residuals, from
``percentile_approx``, whose sketches merge.

Several models (quantiles, options, folds cut by day) grow together in the same passes, so a search over a
grid reads the rows no more often than one model does.

Defined results: rows with a null target, day or fold are left out; a feature without any value is never
split on; a model whose fold has fewer rows than two leaves need is a single leaf; without rows it predicts 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Rows that every quantile of a leaf may be wrong by, as a share of its rows: 1 / ACCURACY.
ACCURACY = 1000


@dataclass(frozen=True)
class Options:
    tau: float = 0.5
    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    least: int = 20
    #: Rows of days before this one are learned from (None: all).
    before: int | None = None


@dataclass
class Tree:
    """Splits by node (node n has children 2n + 1 and 2n + 2) and values of all nodes that may be leaves."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)  # feature, last bin to the left, missing to the left
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.splits):
            feature, cut, missing = self.splits[node]
            here = np.flatnonzero(at == node)
            b = bins[here, feature]
            left = np.where(b == 0, missing, b <= cut)
            at[here] = 2 * node + np.where(left, 1, 2)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        size = max(self.values, default=0) + 1
        table = np.zeros(size)
        for node, value in self.values.items():
            table[node] = value
        return table[np.minimum(self.nodes(bins), size - 1)]


@dataclass
class QuantileTrees:
    """A fitted model: where features are cut, and trees whose values add up."""

    features: list[str]
    cuts: list[np.ndarray]
    options: Options
    trees: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for k, tree in enumerate(self.trees):
            out += tree.predict(bins) * (1.0 if k == 0 else self.options.rate)
        return out

    def prediction(self) -> Column:
        """The prediction as a column over the features."""
        model = self

        @F.pandas_udf("double")
        def predict(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(model.raw(binned(rows.to_numpy(np.float64, na_value=np.nan), model.cuts)))

        return predict(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(self.features)]))


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of rows of features: 0 for missing ones, else 1 + the cuts below the value."""
    out = np.zeros(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        known = ~np.isnan(values[:, j])
        out[known, j] = 1 + np.searchsorted(c, values[known, j], side="left")
    return out


def feature_cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature (nulls and NaN left out), in one pass."""
    shares = F.array(*[F.lit(k / (bins - 1)) for k in range(1, bins - 1)])
    known = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features]
    found = rows.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"f{i}") for i, x in enumerate(known)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def _split(sums: np.ndarray, counts: np.ndarray, least: int) -> tuple[int, int, bool] | None:
    """The split (of features by bins) that lowers the squared gradient error most."""
    total, many = sums[0].sum(), counts[0].sum()
    best, chosen = 1e-12, None
    left_s, left_n = np.cumsum(sums[:, 1:], axis=1), np.cumsum(counts[:, 1:], axis=1)
    for missing in (False, True):
        s, n = (left_s + sums[:, :1], left_n + counts[:, :1]) if missing else (left_s, left_n)
        rest = many - n
        fine = (n >= least) & (rest >= least)
        gain = np.where(fine, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(rest, 1) - total**2 / max(many, 1), -np.inf)
        at = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[at] > best * (1 + 1e-9):
            best, chosen = float(gain[at]), (int(at[0]), int(at[1]) + 1, missing)
    return chosen


def fit_many(rows: DataFrame, target: str, features: list[str], options: list[Options], day: str | None = None, store=None) -> list[QuantileTrees]:
    """A model for each of the options, all grown in the same passes.

    day: a date column that ``Options.before`` (days since 1970) refers to.  store: called with the table of bins, to
    keep it between passes (its result is read instead); by default it is cached, and spilt to disk where memory is short.
    """
    cuts = feature_cuts(rows.where(F.col(target).isNotNull()), features)
    width = max((len(c) for c in cuts), default=0) + 2
    models = [QuantileTrees(features, cuts, o) for o in options]
    when = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) if day else F.lit(0)
    known = rows.select(F.col(target).cast("double").alias("y"), when.alias("day"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]).where("y is not null and not isnan(y) and day is not null")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = binned(frame.iloc[:, 2:].to_numpy(np.float64, na_value=np.nan), cuts)
            yield pd.DataFrame({"y": frame["y"], "day": frame["day"], "bins": [b.tobytes() for b in bins]})

    table = known.mapInPandas(cut, "y double, day int, bins binary")
    held = table.cache() if store is None else store(table)

    def each(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Targets and bins of the rows that model k learns from."""
        before = options[k].before
        part = frame if before is None else frame[frame["day"] < before]
        bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), len(features))
        return part["y"].to_numpy(np.float64), bins

    def leaves(growing: dict[int, Tree]) -> None:
        """Values of the growing trees' leaves: quantiles of the residuals."""

        def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k, tree in growing.items():
                    y, bins = each(frame, k)
                    yield pd.DataFrame({"model": np.full(len(y), k), "node": tree.nodes(bins), "r": y - models[k].raw(bins)})

        found = held.mapInPandas(residuals, "model long, node long, r double").groupBy("model", "node")
        taus = sorted({options[k].tau for k in growing})
        for r in found.agg(F.percentile_approx("r", F.array(*map(F.lit, taus)), ACCURACY).alias("q")).collect():  # a row a leaf
            growing[r["model"]].values[r["node"]] = float(r["q"][taus.index(options[r["model"]].tau)])

    def histograms(growing: dict[int, Tree], level: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        first, nodes = 2**level - 1, 2**level

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = nodes * len(features) * width
            sums, counts = ({k: np.zeros(size) for k in growing} for _ in range(2))
            for frame in frames:
                for k, tree in growing.items():
                    y, bins = each(frame, k)
                    at = tree.nodes(bins) - first
                    inside = at >= 0
                    y, bins, at = y[inside], bins[inside], at[inside]
                    tau = options[k].tau
                    gradient = np.where(y > models[k].raw(bins), tau, tau - 1)
                    place = ((at[:, None] * len(features) + np.arange(len(features))) * width + bins).ravel()
                    sums[k] += np.bincount(place, np.repeat(gradient, len(features)), size)
                    counts[k] += np.bincount(place, minlength=size)
            for k in growing:
                some = np.flatnonzero(counts[k])
                yield pd.DataFrame({"model": k, "place": some, "s": sums[k][some], "n": counts[k][some].astype(np.int64)})

        found = held.mapInPandas(count, "model long, place long, s double, n long").groupBy("model", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for r in found.collect():  # at most models x nodes x features x bins
            node, rest = divmod(r["place"], len(features) * width)
            s, n = out.setdefault((r["model"], first + node), (np.zeros((len(features), width)), np.zeros((len(features), width), np.int64)))
            s[divmod(rest, width)], n[divmod(rest, width)] = round(r["s"], 9), r["n"]
        return out

    try:
        for turn in range(max((o.rounds for o in options), default=0) + 1):
            growing = {k: Tree() for k, o in enumerate(options) if turn <= o.rounds}
            for level in range(max(options[k].depth for k in growing) if turn and features else 0):
                open_ = {k: t for k, t in growing.items() if level < options[k].depth and (level == 0 or any(n >= 2 ** (level - 1) - 1 for n in t.splits))}
                for (k, node), (s, n) in histograms(open_, level).items() if open_ else ():
                    found = _split(s, n, options[k].least)
                    if found:
                        growing[k].splits[node] = found
            leaves(growing)
            for k, tree in growing.items():
                models[k].trees.append(tree)
    finally:
        if store is None:
            held.unpersist()
    return models


def fit(rows: DataFrame, target: str, features: list[str], tau: float, **options) -> QuantileTrees:
    return fit_many(rows, target, features, [Options(tau=tau, **options)])[0]


def pinball(target: Column, predicted: Column, tau: float) -> Column:
    gap = target - predicted
    return F.greatest(tau * gap, (tau - 1) * gap)


GRID = tuple({"rate": r, "depth": d, "least": n} for r in (0.1, 0.3) for d in (2, 4) for n in (20, 100))


def choose(rows: DataFrame, target: str, features: list[str], day: str, taus: tuple[float, ...] = (0.5, 0.9), grid=GRID, folds: int = 3, rounds: int = 20) -> dict[float, Options]:
    """For each quantile the options of the least mean pinball loss on later blocks of days (an expanding window inside the rows).

    Blocks hold about equally many days' rows.  All candidates of all folds grow in the same passes; the first of
    equal ones wins.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    days = rows.where(F.col(target).isNotNull()).agg(F.percentile(number, F.array(*[F.lit(k / (folds + 1)) for k in range(1, folds + 1)])).alias("q"), F.max(number).alias("last")).first()
    if days["q"] is None:
        return {tau: Options(tau=tau, rounds=rounds, **grid[0]) for tau in taus}
    cuts = [int(np.ceil(q)) for q in days["q"]]
    blocks = [(lo, hi) for lo, hi in zip(cuts, [*cuts[1:], days["last"] + 1], strict=True) if lo < hi]
    candidates = [(tau, i, lo, hi) for tau in taus for i in range(len(grid)) for lo, hi in blocks]
    models = fit_many(rows, target, features, [Options(tau=tau, rounds=rounds, before=lo, **grid[i]) for tau, i, lo, _ in candidates], day)
    known = rows.where(F.col(target).isNotNull()).withColumn("__n", number)
    losses = known.agg(*[F.avg(F.when((F.col("__n") >= lo) & (F.col("__n") < hi), pinball(F.col(target), F.greatest(m.prediction(), F.lit(0.0)), tau))).alias(f"l{k}") for k, (m, (tau, _, lo, hi)) in enumerate(zip(models, candidates, strict=True))]).first()
    out = {}
    for tau in taus:
        mean = []
        for i in range(len(grid)):
            own = [losses[k] for k, c in enumerate(candidates) if c[:2] == (tau, i) and losses[k] is not None]
            mean.append((sum(own) / len(own) if own else float("inf"), i))
        out[tau] = Options(tau=tau, rounds=rounds, **grid[min(mean)[1]])
    return out
