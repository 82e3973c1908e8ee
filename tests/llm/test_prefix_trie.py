"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loadweave.llm import prefix_trie, sql

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner int, pos string, k1 string"


def sequences(rows):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in held.items()}


def replaced(held):
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(held):
    members = {}
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, of in members.items():
        below = [m for m in members if m[: len(k)] == k]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(of) if len(held[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        out.append((min(of), len(k), up, len(of), len(children.get(k, [])), sum(m not in children for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p", "k") for r in rows], SCHEMA).repartition(3)


def rows():
    rng = random.Random(2)
    out = []
    for c in [*range(0, 12), *range(100, 112), *range(205, 212), 2**40, 2**40 + 3]:
        for turn in range(rng.randrange(1, 9)):
            out.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "中文字", "", None, "long " * 9])))
    out += [(300, None, "user", "z"), (300, None, "user", "y"), (300, 1, "b", "t"), (300, 1, "a", "t"), (300, 1, "a", "t"), (301, 5, "user", "z")]
    out += [(400, t, "user", f"t{t % 3}") for t in range(150)] + [(c, t, "user", f"t{t % 3}") for c in range(401, 409) for t in range(c % 7)]
    out += [(None, 1, "user", "lost")]
    return out


@pytest.mark.parametrize("partitions", ["4", "13"])
def test_rebuilt_trie(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(table(spark, rows()))))
        assert [k for _, k in got.dtypes] == ["bigint"] * 7 + ["string"]
        assert sorted(str(tuple(r)) for r in got.collect()) == plain(replaced(sequences(rows())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_plain_trie_with_growing_and_turnless_conversations(spark):
    growing = [(c, t, "user", f"turn {t}") for c in range(20) for t in range(c + 1)]
    got = prefix_trie.conversation_trie(table(spark, growing))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(sequences(growing))
    turns = prefix_trie.numbered_turns(table(spark, growing[:1]))
    members = spark.createDataFrame([(0, 1), (7, 0), (5, 0)], "conv_id long, size long")
    found = {r["depth"]: r for r in prefix_trie.trie(turns, members).collect()}
    assert found[0]["ends_sha256"] == hashlib.sha256(b"5,7").hexdigest() and found[0]["n_convs"] == 3 and len(found) == 2


def test_no_rows(spark):
    empty = table(spark, rows()).limit(0)
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(empty))).collect() == []


def test_running_values_over_cut_keys(spark):
    df = spark.range(3000).select((F.col("id") % 3 * F.when(F.col("id") < 2700, 0).otherwise(1)).alias("key"), F.col("id").alias("at"), (F.col("id") * 7919 % 1009).alias("a"), F.xxhash64("id").alias("x"))
    got = prefix_trie.running(df, "key", [F.col("at")], ["key", "at", "a", "x"], "running", count="n", sums=("a",), xors=("x",))
    of = {r["at"]: r for r in got.collect()}
    state = {}
    for r in df.orderBy("at").collect():
        n, a, x = state.get(r["key"], (0, 0, 0))
        state[r["key"]] = n, a, x = n + 1, a + r["a"], x ^ r["x"]
        assert (of[r["at"]]["n"], of[r["at"]]["a"], of[r["at"]]["x"]) == (n, a, x)


def test_against_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted(map(str, map(tuple, prefix_trie.op13_trie(spark, data).collect()))) == sorted(map(str, con.sql(sql.OP13_SQL).fetchall()))
