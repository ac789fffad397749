"""Repeated strings against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import suffix_dedup as sd


def brute(texts, n):
    count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        runs = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        kept = bytes(b for b, x in zip(t, hit) if not x)
        out.append((len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, rows, n, **params):
    found = sd.removal_digests(sd.with_spans(df, min_len=n, **params)).collect()
    texts = [(r[1] or "").encode() for r in rows]
    assert collections.Counter(map(tuple, found)) == collections.Counter((r[0], *b) for r, b in zip(rows, brute(texts, n)))


def passages():
    rng = random.Random(3)
    letters = "abcé🎉 "
    base = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(20)]
    rows = []
    for i in range(120):
        s = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            s += b[a : a + rng.randint(0, 120)] + "".join(rng.choices(letters, k=rng.choice([0, 0, 5])))
        rows.append((i, s))
    return rows + [(900, ""), (901, "a" * 500), (902, "ab" * 300), (903, None), rows[3], (None, rows[4][1])]


@pytest.mark.parametrize("params", [{}, {"max_group": 2}, {"chunk": 64}, {"gram": 8}])
def test_removal_agrees_with_brute_force(spark, params):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(df, rows, 40, **{"gram": 16} | params)


def test_odd_rows(odd):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()], 200)


def test_no_rows(none):
    assert sd.removal_digests(sd.with_spans(none)).collect() == []
    assert sd.remove_repeats(none).columns == none.columns


def test_only_whole_characters_are_cut(spark):
    shared = "".join(random.Random(2).choices("éàüôïçñ", k=120))
    df = spark.createDataFrame([(1, "aé" + shared + "é!", 9), (2, "bè" + shared + "è?", 9)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in sd.remove_repeats(df, min_len=100, gram=16).collect()}
    assert got[1]["text"] == "aé" + "é!" and got[2]["text"] == "bè" + "è?"
    assert got[1]["n_chars"] == 4


def brute_repeats(texts, n):
    """(string, its places) of every maximal repeat of n bytes or more, by extending each repeated string."""
    at = collections.defaultdict(set)
    for o, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            at[t[i : i + n]].add((o, i))
    out = set()
    for s, places in at.items():
        todo = [(len(s), frozenset(places))]
        while todo:
            length, group = todo.pop()
            if len(group) < 2:
                continue
            after = collections.defaultdict(set)
            for o, i in group:
                after[texts[o][i + length] if i + length < len(texts[o]) else ("end", o)].add((o, i))
            if len(after) > 1:
                before = {texts[o][i - 1] if i else ("start", o) for o, i in group}
                if len(before) > 1:
                    out.add((length, group))
                todo += [(length + 1, frozenset(g)) for k, g in after.items() if not isinstance(k, tuple)]
            elif not isinstance(next(iter(after)), tuple):
                todo.append((length + 1, group))
    return out


def found_repeats(df, **params):
    groups = collections.defaultdict(set)
    for r in sd.maximal_repeats(df, **params).collect():
        groups[r["repeat_id"], r["length"]].add((r["doc_id"], r["start"]))
    return {(length, frozenset(g)) for (_, length), g in groups.items()}


@pytest.mark.parametrize("params", [{}, {"max_group": 2}])
def test_maximal_repeats_are_those_of_brute_force(spark, params):
    rng = random.Random(8)
    long, short = ("".join(rng.choices("abcde", k=k)) for k in (1000, 90))
    texts = [long, "x" + long + "y", "y" + long[:700] + "z" + long[100:], long[300:] + short, short + long[:950], "q" + short + "w" + short[10:], short + "e" + short, "ab" * 60, "b" + short[:60] + "r", "c" + short[:60] + "s", "d" + short[:60] + "t", "é" + long[40:120]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_repeats([t.encode() for t in texts], 40)
    assert max(n for n, _ in want) >= 900
    assert found_repeats(df, min_len=40, gram=16, **params) == want


def test_removed_bytes_are_those_under_maximal_repeats(spark):
    rows = [(i, t) for i, t in passages()[:60] if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repeats = found_repeats(df, min_len=40, gram=16)
    for r in sd.with_spans(df, min_len=40, gram=16).collect():
        under = {k for n, g in repeats for d, s in g if d == r["row"]["doc_id"] for k in range(s, s + n)}
        spans = sd.merged_spans(r["spans"])
        assert under == {k for a, b in zip(spans[0::2], spans[1::2]) for k in range(a, b)}


def test_long_texts_are_hashed_in_chunks(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=1_200_000))
    rows = [(1, long), (2, "head " + long[700_000:700_500] + " tail"), (3, long[:400_000])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 200)


def test_ids_of_any_type_and_names_with_dots(spark):
    shared = "".join(random.Random(4).choices("abcdef", k=300))
    df = spark.createDataFrame([("a", "1" + shared), ("b", shared + "2")], "`my.id` string, `the.text` string")
    found = sd.removal_digests(sd.with_spans(df, "my.id", "the.text"), "my.id", "the.text").collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [("a", 300), ("b", 300)]
    assert sorted(map(tuple, sd.remove_repeats(df, "my.id", "the.text").collect())) == [("a", "1"), ("b", "2")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_intervals_are_the_maximal_repeats(pieces):
    n = 3
    owner, place, groups = sd.repeats_in(pieces, n)
    found = {(frozenset((int(owner[t]), int(place[t])) for t in range(a, b + 1)), int(length)) for a, b, length in zip(*groups)}
    at = collections.defaultdict(set)
    for o, p in enumerate(pieces):
        for i in range(len(p)):
            for j in range(i + n, len(p) + 1):
                at[p[i:j]].add((o, i))
    want = set()
    for s, places in at.items():
        if len(places) < 2:
            continue
        after = {pieces[o][i + len(s)] if i + len(s) < len(pieces[o]) else ("end", o) for o, i in places}
        before = {pieces[o][i - 1] if i else ("start", o) for o, i in places}
        if len(after) > 1 and len(before) > 1:
            want.add((frozenset(places), len(s)))
    assert found == want
