"""Exact repeats of at least L units (words or bytes) over a whole corpus.

The two substring operators share this exchange; they differ in how a group is searched.

1. *Sampled suffixes.*  Among the L - k + 1 k-grams of every L-unit window the one with the
   smallest hash (leftmost on ties) is its anchor.  Equal windows have equal anchors at
   equal distances, so only suffixes that begin at anchors need to meet.  Consecutive
   windows with one anchor form a run: about one in (L - k + 2) / 2 positions.
2. *Prefix partitioning.*  A run goes to the group of its anchor's k-gram (the prefix) with
   two independent hashes, 96 bits in all, of its whole context (all its windows).  Runs whose
   contexts repeat are settled at once; equal contexts of one batch are merged before the
   shuffle, so a passage that a third of all documents share arrives once for each batch.
   Unequal contexts with equal hashes (1e12 contexts hold such a pair with a chance of about
   1 in 100 000) would be taken for copies.  So would words with one 64-bit hash, which is what a word's
   unit is, and rows of one doc_id that share their 30 bits.  Bytes are compared as they are.
3. *Searched groups.*  Where contexts with one prefix differ, one run for each context (the
   rest is settled) fetches its units from its document, and ``search`` finds the windows
   that repeat.
4. *Longer prefixes.*  A prefix must not outgrow a task, so its length varies.  One that turns out to have
   more than ``WIDE`` contexts is extended to whole windows, each a group of its own, searched like any other.  One
   of which more than ``HOT`` runs would travel is extended before they do: each window of its runs travels
   as a run of one window, with the window as its prefix.  What travels is counted over all documents, in one
   of ``SAMPLE`` runs by a hash of their place, so a prefix crowded into few documents is counted like one spread
   over many; the count decides on a prefix's length alone, never on a result.
5. Spans of repeated window starts return to their documents by a join on their keys.

A row's key is its doc_id and a tag with 30 bits of a hash of its text, so rows that share a
doc_id keep apart; a row without a doc_id has 64 more bits of its text instead.

The rule ``anywhere`` calls a window repeated if its units also start anywhere else; the rule
``earlier`` if they also start in a document with a smaller doc_id.
Null doc_ids are neither smaller nor larger than others: under ``earlier`` their rows come back
without spans and serve as no witness; under ``anywhere`` they are texts like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns, gathered, give_back, input_bytes, keyed, mixed, run_hashes, spread, window_argmin, written

#: Characters of text in a batch within which equal contexts merge.
BATCH_CHARS = 6 << 20
#: Units whose windows are hashed at once (so much that the arrays stay in a cache); longer texts are cut with an overlap, which only cuts runs.
SLICE = 1 << 16
#: Windows of extended prefixes within which equal ones merge, and units hashed at once for them.
PIECE, STRETCH = 1 << 19, 1 << 18
#: Contexts of one prefix beyond which it is made longer.
WIDE = 20_000
#: Runs of one prefix beyond which it is made longer before they travel, by one in ``SAMPLE``; at most ``MOST_HOT`` prefixes are.
HOT, SAMPLE, MOST_HOT = 200_000, 64, 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


@dataclass(frozen=True)
class Rule:
    length: int  # units of a window
    gram: int  # units of an anchor
    earlier: bool  # a smaller doc_id is needed; else any other place
    units: Callable[[object, str | None], np.ndarray]  # (worker state, text) to unsigned units
    state: Callable[[], object]  # made once for each task
    unit_dtype: str  # of contexts as they travel


def runs_of(units: np.ndarray, lengths: np.ndarray, rule: Rule):
    """(anchor hash, context hash, more of it, document, start, windows, anchor place in the run) of every run.

    units: the units of several documents end to end; lengths: units of each.
    """
    width = rule.length - rule.gram + 1
    grams = run_hashes(units, rule.gram)
    windows = run_hashes(units, rule.length)
    n = len(windows)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.uint32), *[np.zeros(0, np.int64)] * 4
    ends = np.cumsum(lengths)
    begins = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = window_argmin(grams, width)[:n]
    valid = doc[:n] == doc[rule.length - 1 : rule.length - 1 + n]
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    # A run ends where the next one begins or where windows stop fitting their document.
    starts_or_gaps = np.flatnonzero(change | ~valid)
    after = np.append(starts_or_gaps, n)[np.searchsorted(starts_or_gaps, first) + 1]
    count = after - first
    context = mixed((windows[first] * _GOLD + windows[first + count - 1]) ^ count.astype(np.uint64))
    # The context's polynomial hash, from sums over prefixes.
    scaled = mixed(units + _GOLD) * _powers(_INVERSE, len(units))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled, dtype=np.uint64)])
    whole = (sums[after + rule.length - 1] - sums[first]) * _powers(_BASE, len(units))[first]
    where = doc[first]
    return grams[at[first]], context, (mixed(whole) >> np.uint64(32)).astype(np.uint32), where, first - begins[where], count, at[first] - first


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1); up to a slice's they are kept."""
    found = _KEPT.get(int(base))
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE + 4096), base, np.uint64)
        found[:1] = 1
        found = np.multiply.accumulate(found)
        if n <= SLICE + 4096:
            _KEPT[int(base)] = found
    return found[:n]


def _slices(units: list[np.ndarray], length: int) -> Iterator[tuple[list[np.ndarray], list[int], list[int]]]:
    """(parts, document of each, its first unit there), up to ``SLICE`` units or one part at a time; every window is in one part."""
    parts, docs, firsts, held = [], [], [], 0
    for doc, u in enumerate(units):
        step = max(SLICE, length)
        for first in range(0, max(len(u) - length + 1, 0), step):
            part = u[first : first + step + length - 1]
            if held and held + len(part) > SLICE:
                yield parts, docs, firsts
                parts, docs, firsts, held = [], [], [], 0
            parts.append(part)
            docs.append(doc)
            firsts.append(first)
            held += len(part)
    if parts:
        yield parts, docs, firsts


def _all_runs(units: list[np.ndarray], rule: Rule):
    """``runs_of`` whole documents, slice by slice."""
    out = []
    for parts, docs, firsts in _slices(units, rule.length):
        found = runs_of(np.concatenate(parts).astype(np.uint64), np.array([len(p) for p in parts], np.int64), rule)
        where = found[3]
        out.append((*found[:3], np.array(docs)[where], found[4] + np.array(firsts)[where], *found[5:]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else runs_of(np.zeros(0, np.uint64), np.zeros(0, np.int64), rule)


_FIELDS = (("a", "<u8"), ("c", "<u8"), ("e", "<u4"), ("d", "<i8"), ("t", "<u4"), ("s", "<i4"), ("n", "u1"), ("r", "u1"), ("f", "u1"))


def _pack(arrays: list[np.ndarray]) -> bytes:
    n = len(arrays[0])
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(x, t).tobytes() for x, (_, t) in zip(arrays, _FIELDS, strict=True))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _FIELDS]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
        for held, (_, kind) in zip(parts, _FIELDS, strict=True):
            held.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, (_, t) in zip(parts, _FIELDS, strict=True)]


def _runs(frame: pd.DataFrame, rule: Rule, state, hot: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Runs of a batch (the ``_FIELDS`` without the last), then those of extended prefixes, some ``PIECE`` windows at a time."""
    units = [rule.units(state, t) for t in frame["text"]]
    anchor, context, more, doc, start, count, place = _all_runs(units, rule)
    ids, tags = frame["id"].to_numpy(np.int64), frame["tag"].to_numpy(np.int64).astype(np.uint32)
    at = np.searchsorted(hot, anchor)
    long = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == anchor) if len(hot) else np.zeros(len(anchor), bool)
    yield [x[~long] for x in (anchor, context, more, ids[doc], tags[doc], start, count, place)]
    held, size = [], 0
    for piece in _windows(units, doc[long], start[long], count[long], rule):
        held.append(piece)
        size += len(piece[0])
        if size >= PIECE:
            yield _one_by_one(held, ids, tags)
            held, size = [], 0
    if held:
        yield _one_by_one(held, ids, tags)


#: Another hash of a window's units.
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _windows(units: list[np.ndarray], doc: np.ndarray, start: np.ndarray, count: np.ndarray, rule: Rule) -> Iterator[tuple]:
    """(prefix, other hash, document, place) of every window of runs, from about ``STRETCH`` units at a time."""
    span = count + rule.length - 1
    part = np.cumsum(span) // STRETCH
    for first in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(part)) + 1):
        if not len(first):
            continue
        joined = np.concatenate([units[d][s : s + n] for d, s, n in zip(doc[first].tolist(), start[first].tolist(), span[first].tolist(), strict=True)]).astype(np.uint64)
        begin, n = np.cumsum(span[first]) - span[first], count[first]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + inner
        prefix = _long_prefix(run_hashes(joined, rule.length)[at])
        yield prefix, run_hashes(mixed(joined ^ _SALT), rule.length)[at], np.repeat(doc[first], n), np.repeat(start[first], n) + inner


def _long_prefix(windows: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that are whole windows, from the windows'."""
    return mixed(windows + _GOLD)


def _one_by_one(pieces: list[tuple], ids: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    prefix, other, doc, start = (np.concatenate(x) for x in zip(*pieces, strict=True))
    more = (mixed(prefix ^ (other * _GOLD)) >> np.uint64(32)).astype(np.uint32)
    return [prefix, other, more, ids[doc], tags[doc], start, np.ones(len(start), np.int64), np.zeros(len(start), np.int64)]


def _merged(runs: list[np.ndarray], rule: Rule):
    """Runs in the order of ``_FIELDS``, with masks of those that go on and those that are settled; equal contexts merge."""
    anchor, context, more, ids, tags, start, count, place = runs
    order = np.lexsort((start, tags, ids, more, context))
    anchor, context, more, ids, tags, start, count, place = (x[order] for x in runs)
    head = np.ones(len(context), bool)
    head[1:] = (context[1:] != context[:-1]) | (more[1:] != more[:-1])
    group = np.cumsum(head) - 1
    size = np.bincount(group)[group] if len(group) else group
    if rule.earlier:  # all that the smallest document of a context has goes on, the rest is settled here
        settled = ids > ids[head][group]
        flag, keep = settled, ~settled
    else:  # one run goes on for all, and says whether it is settled itself
        settled = flag = size > 1
        keep = head
    return (anchor, context, more, ids, tags, start, count, place, flag), keep, settled


def _hot_prefixes(rows: DataFrame, rule: Rule) -> np.ndarray:
    """Hashes of the prefixes that would be too large a group, counted over all documents; ascending.

    Of the runs that a batch would send (equal contexts as one) those whose place has a hash of
    one in ``SAMPLE`` count.
    """
    none = np.zeros(0, np.uint64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = rule.state()
        for frame in batches(gathered(frames, "text", BATCH_CHARS), "text", BATCH_CHARS):
            for runs in _runs(frame, rule, state, none):
                (anchor, _, _, ids, tags, start, *_), keep, _ = _merged(runs, rule)
                drawn = keep & (mixed(mixed(ids.view(np.uint64) + tags.astype(np.uint64) * _GOLD) + start.astype(np.uint64)) % np.uint64(SAMPLE) == 0)
                anchors, n = np.unique(anchor[drawn], return_counts=True)
                if len(anchors):
                    yield pd.DataFrame({"anchor": anchors.view(np.int64), "n": n})

    # No more than MOST_HOT prefixes can have more than that share of all runs; there is hardly a run for 16 bytes.
    least = max(HOT, input_bytes(rows) // 16 // MOST_HOT)
    counted = rows.mapInPandas(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") * SAMPLE > least).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def _sampled(docs: DataFrame, rule: Rule, groups: int, hot: np.ndarray) -> DataFrame:
    shift = np.uint64(64 - groups.bit_length() + 1)

    def dealt(runs: list[np.ndarray]) -> pd.DataFrame:
        arrays, keep, settled = _merged(runs, rule)
        anchor, _, _, ids, tags, start, count, _, _ = arrays
        bucket = (mixed(anchor) >> shift).astype(np.int64)
        order = np.flatnonzero(keep | settled)
        order = order[np.lexsort((start[order], ids[order], bucket[order]))]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = []
        for part in np.split(order, cuts):
            kept, done = part[keep[part]], part[settled[part]]
            rows.append((int(bucket[part[0]]), _pack([x[kept] for x in arrays]), _spans(ids[done], tags[done], start[done], count[done])))
        return pd.DataFrame(rows, columns=["bucket", "runs", "settled"])

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = rule.state()
        for frame in batches(gathered(frames, "text", BATCH_CHARS), "text", BATCH_CHARS):
            for runs in _runs(frame, rule, state, hot):
                if len(runs[0]):
                    yield dealt(runs)

    return docs.mapInPandas(sample, "bucket int, runs binary, settled binary")


def _spans(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    return np.int64(len(ids)).tobytes() + ids.astype("<i8").tobytes() + tags.astype("<u4").tobytes() + start.astype("<i4").tobytes() + count.astype("u1").tobytes()


def _spans_of(blobs: list[bytes]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[], [], [], []]
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        for held, kind, at in zip(out, ("<i8", "<u4", "<i4", "u1"), (0, 8, 12, 16), strict=True):
            held.append(np.frombuffer(blob, kind, n, 8 + at * n))
    return [np.concatenate(x) for x in out]


#: kind 0: settled windows, place s << 8 | n; kind 1 and 2: runs to search, by their prefix or window by window.
_FOUND = "kind int, id long, tag long, place long, anchor long, extra int"


def _settled(sampled: DataFrame, rule: Rule) -> DataFrame:
    def rows(kind, ids, tags, start, count, anchor=0, extra=0) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "id": ids, "tag": tags.astype(np.int64), "place": start.astype(np.int64) << 8 | count, "anchor": anchor, "extra": extra})

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        known = rows(0, *_spans_of(frame["settled"].tolist()))
        a, c, e, d, t, s, n, r, f = _unpack(frame["runs"].tolist())
        if not len(a):
            return known
        order = np.lexsort((s, t, d, e, c, a))
        a, c, e, d, t, s, n, r, f = (x[order] for x in (a, c, e, d, t, s, n, r, f))
        new_anchor = np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new_context = new_anchor.copy()
        new_context[1:] |= (c[1:] != c[:-1]) | (e[1:] != e[:-1])
        context, anchor = np.cumsum(new_context) - 1, np.cumsum(new_anchor) - 1
        contexts = np.bincount(anchor, weights=new_context)[anchor]
        if rule.earlier:
            settled = d > d[new_context][context]
            rest = ~settled  # of each context, what its smallest document holds
            least = np.minimum.reduceat(d, np.flatnonzero(new_anchor))[anchor]
            most = np.maximum.reduceat(d, np.flatnonzero(new_anchor))[anchor]
            search = rest & (contexts > 1) & (least < most)
            extra = np.zeros(len(a), np.int64)
        else:
            repeated = np.bincount(context)[context] > 1
            settled = repeated & (f == 0)
            search = new_context & (contexts > 1)
            extra = (repeated | (f > 0)).astype(np.int64)  # such a run only serves as a witness
        out = [known, rows(0, d[settled], t[settled], s[settled], n[settled])]
        if search.any():
            kind = np.where(contexts[search] > WIDE, 2, 1)
            out.append(rows(kind, d[search], t[search], s[search], n[search], a[search].view(np.int64), extra[search] << 8 | r[search]))
        return pd.concat(out, ignore_index=True)

    return sampled.groupBy("bucket").applyInPandas(settle, _FOUND)


def _contexts(docs: DataFrame, found: DataFrame, rule: Rule, groups: int) -> DataFrame:
    """The units of the runs to search, by the bucket of their prefix."""
    wanted = found.where("kind > 0").groupBy("id", "tag").agg(F.collect_list(F.struct("kind", "place", "anchor", "extra")).alias("runs"))
    wanted = wanted.selectExpr("id", "tag", "runs.kind as kinds", "runs.place as places", "runs.anchor as anchors", "runs.extra as extras")
    shift = np.uint64(64 - groups.bit_length() + 1)

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, names = rule.state(), ["bucket", "anchor", "id", "tag", "place", "extra", "units"]
        for frame in batches(frames, "text", BATCH_CHARS):
            rows: list[tuple] = []
            held = 0
            for key, tag, text, kinds, places, anchors, extras in zip(*(frame[c] for c in ("id", "tag", "text", "kinds", "places", "anchors", "extras")), strict=True):
                units = rule.units(state, text)
                plain = np.ascontiguousarray(units, rule.unit_dtype)
                buckets = (mixed(np.asarray(anchors, np.int64).view(np.uint64)) >> shift).tolist()
                for bucket, kind, place, anchor, extra in zip(buckets, kinds, places, anchors, extras, strict=True):
                    start, count = int(place) >> 8, int(place) & 255
                    if kind == 1:
                        rows.append((bucket, anchor, key, tag, place, extra, plain[start : start + count - 1 + rule.length].tobytes()))
                    else:  # each window by all its units
                        hashes = _long_prefix(run_hashes(plain[start : start + count - 1 + rule.length].astype(np.uint64), rule.length))
                        for i, (h, b) in enumerate(zip(hashes.view(np.int64).tolist(), (mixed(hashes) >> shift).tolist(), strict=True)):
                            rows.append((b, h, key, tag, (start + i) << 8 | 1, extra & ~255, plain[start + i : start + i + rule.length].tobytes()))
                    held += (1 if kind == 1 else count) * rule.length + count
                    if held * np.dtype(rule.unit_dtype).itemsize > 4 << 20 or len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.join(wanted, ["id", "tag"]).mapInPandas(fetch, "bucket int, anchor long, id long, tag long, place long, extra int, units binary")


def repeated_windows(docs: DataFrame, rule: Rule, search: Callable) -> DataFrame:
    """id, tag (``keyed`` rows) and places: array of start << 8 | count, the starts of repeated windows.

    search(anchor, doc, start, count, place, witness, contexts) gets the runs of one group of
    prefixes as arrays and returns, for each window of the runs end to end, whether it repeats.
    """
    groups = spread(docs, 4 << 20)
    rows = (docs.where("doc_id is not null") if rule.earlier else docs).select("id", "tag", "text")
    hot = _hot_prefixes(rows, rule)
    found = written(_settled(_sampled(rows, rule, groups, hot), rule), "repeats", "kind")

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame.drop_duplicates(["anchor", "id", "tag", "place"])
        place, extra = frame["place"].to_numpy(np.int64), frame["extra"].to_numpy(np.int64)
        start, count, doc, tag = place >> 8, place & 255, frame["id"].to_numpy(np.int64), frame["tag"].to_numpy(np.int64)
        contexts = [np.frombuffer(u, rule.unit_dtype) for u in frame["units"]]
        hit = search(frame["anchor"].to_numpy(np.int64).view(np.uint64), doc, start, count, extra & 255, extra >> 8 > 0, contexts)
        run = np.repeat(np.arange(len(count)), count)[hit]
        at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count))[hit]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        long = np.diff(np.append(begin, len(at)))
        return pd.DataFrame({"id": doc[run[begin]], "tag": tag[run[begin]], "place": at[begin] << 8 | long})

    more = _contexts(rows, found, rule, groups).groupBy("bucket").applyInPandas(look, "id long, tag long, place long")
    spans = found.where("kind = 0").select("id", "tag", "place").unionByName(more)
    return spans.groupBy("id", "tag").agg(F.collect_list("place").alias("places"))


def covered(places, units: int, length: int) -> np.ndarray:
    """Which units of a document lie in a repeated window."""
    edge = np.zeros(units + 1, np.int64)
    if places is not None and len(places):
        places = np.asarray(places, np.int64)
        np.add.at(edge, places >> 8, 1)
        np.add.at(edge, (places >> 8) + (places & 255) - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def reported(docs: DataFrame, windows: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(doc_id, text, places) for every document, those without repeats too."""

    def report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for frame in batches(frames, "text", BATCH_CHARS):
            rows = [finish(d, t, p) for d, t, p in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["places"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    joined = docs.join(windows, ["id", "tag"], "left").select("doc_id", "text", "places")
    return joined.mapInPandas(report, schema)


def texts(docs: DataFrame) -> DataFrame:
    return keyed(columns(docs, doc_id="long", text="string"))
