"""Ranked lexical search against brute force."""

import collections
import math
import random
import re

import duckdb
import pytest

from loadweave.llm import search, sql

DOCS = "doc_id long, text string, term string, n int, id string, item_id string"
ITEMS = "item_id long, text string, score string, doc_id int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k, repeats=False):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    many, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            wanted[i].update(terms(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * many) // length
            score = sum((n if repeats else 1) * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, n in query.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    docs += [(1000 + i, "The Same, text w1 W2 w3!") for i in range(30)] + [(1000, "The Same, text w1 W2 w3!")]
    docs += [(None, "w1 w2 the same"), (None, None), (5000, None), (5001, ""), (5002, " ,.- "), (2**60 + 1, "w7 w8"), (2**60, "w7 w8"), (5003, "É É à 中文 w1_w2"), (5004, "w5 " * 30_000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "É 中文 à"), (54, "same same text w9 w9"), (54, "w7"), (None, "w1"), (55, "w7 w8")]
    return docs, items


@pytest.mark.parametrize("k, repeats, each", [(50, False, 200_000), (3, True, 60), (1000, False, 40)])
def test_search(spark, rows, monkeypatch, k, repeats, each):
    monkeypatch.setattr(search, "PIECE", 64)
    docs = spark.createDataFrame([(i, t, "t", 1, "i", "x") for i, t in rows[0]], DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, "s", 1) for i, t in rows[1]], ITEMS)
    found = search.search(docs, items, k, repeats, each)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(*rows, k, repeats)


def test_nothing_to_find(spark):
    docs, items = spark.createDataFrame([(1, "a b", "t", 1, "i", "x")], DOCS), spark.createDataFrame([(1, "a", "s", 1)], ITEMS)
    assert search.search(docs.limit(0), items).collect() == [] and search.search(docs, items.limit(0)).collect() == []
    common = spark.range(600).selectExpr("id as doc_id", "'a b' as text")
    assert search.search(common, items).collect() == []  # the weight of a term that all of them hold is zero


def test_against_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert sorted(map(tuple, search.op12_search(spark, data).collect())) == sorted(con.sql(sql.OP12_SQL).fetchall())
