"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from loadweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key int, ring string, component string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest place reachable of each."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    out = [None, "", " \n\t ", "One", "one", "a b c", "a b c d", "A B\x0bC  D", "É À la CARTE 中文", "x" * 50_000, "\x1cw \x85 v"]
    for n in range(120):
        copy = list(base)
        for _ in range(n % 7):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(50)}"
        out.append(" ".join(copy))
    out += [" ".join(f"u{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    out.append(" ".join(f"long{i % 700}" for i in range(40_000)))
    return out


def test_fingerprints_of_whole_texts_in_pieces(monkeypatch):
    for piece in (1 << 20, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for text in texts()[:-1]:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.fingerprint(texts()[-1]) == plain_fingerprint(texts()[-1])


def test_components(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "one"), (None, "one"), (None, "alone among all these words"), (900, None), (2**60 + 1, "a word of a row with a long id")]
    df = spark.createDataFrame([(i, t, "f", 1, "r", "c") for i, t in rows], SCHEMA).repartition(3)
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    ids = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    want = sorted((str(i), f"{p:016x}", str(ids.get(r))) for (i, _), p, r in zip(rows, prints, root, strict=True))
    for block in (4096, 5):
        got = simhash.near_duplicates(df, block)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert len(set(root)) < 150  # many texts did link
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_no_link_is_lost_within_four_bits(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for d in (1, 2, 3, 4, 4, 5):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), d)))
    near = rng.getrandbits(64)
    prints |= {near ^ sum(1 << b for b in rng.sample(range(8), rng.randrange(6))) for _ in range(200)}
    prints |= {0, 2**64 - 1, 1, 2**63, 2**64 - 16}
    held = sorted(prints)
    root = plain_components(held)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in held], "fp long")
    for block in (4096, 8):
        found = simhash.components(simhash.links(df, block)).collect()
        got = {r["node"] % 2**64: r["component"] % 2**64 for r in found}
        groups = {}
        for p, r in zip(held, root, strict=True):
            groups.setdefault(r, set()).add(got.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
