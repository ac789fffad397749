"""Fingerprints and links against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import connected_components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, max_bits):
    own = list(range(len(values)))

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= max_bits:
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_odd_rows(odd):
    rows = odd.collect()
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = [slow_fingerprint(r["text"]) for r in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{w:016x}" for w in want)
    group = components(want, 4)
    least = {}
    for r, g in zip(rows, group):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], least.get(g)) for r, g in zip(rows, group)), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == expected


def test_one_of_each_group_stays(odd):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert 104 in ids and 105 not in ids


def test_one_stays_of_each_group_with_repeated_or_missing_ids(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (1, b), (1, b), (None, b), (None, c), (None, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, a), (1, b), (None, c)], key=repr)


def test_no_rows(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


@pytest.mark.parametrize("max_bits,max_bucket", [(4, 1 << 15), (4, 5), (3, 1 << 15), (0, 1 << 15), (2, 3)])
def test_links_connect_as_brute_force_does(spark, max_bits, max_bucket):
    rng = random.Random(max_bits)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.append(v)
            for _ in range(rng.randint(0, max_bits + 2)):
                v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.component_of_fingerprints(df, max_bits, max_bucket).collect()}
    assert [got[s] for s in signed] == components(values, max_bits)


def test_trie_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << k) ^ np.uint64(1 << j) for k in range(0, 40, 5) for j in range(1, 60, 9)]))
    a, b = simhash.trie_links(fps, np.zeros(len(fps), np.int64), list(range(63, -1, -1)))
    got = {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want and len(a) == len(got)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(path + star + [(5, 5), (None, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert connected_components(df.limit(0)).collect() == []


def test_long_text(spark):
    text = "Word " * 200_000 + "end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash.near_duplicates(df).first()["fingerprint"] == f"{xxhash.xxh64_intdigest('word word word word', 42):016x}"
