"""Near duplicates by the similarity of shingles against brute force."""

from __future__ import annotations

import random

import pytest

from quern.llm import simhash

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    sets = [shingles(t) for t in texts]
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def kept_of(rows):
    least = {}
    for (i, _), g in zip(rows, groups([t for _, t in rows])):
        least[g] = min(least.get(g, i), i)
    return sorted(least.values())


def chain(rng, n, steps):
    """Texts of which each differs from the one before in a few words; the ends aren't similar."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(steps):
        yield " ".join(words)
        words = list(words)
        words[rng.randrange(n)] = f"w{rng.randrange(10**6)}"


def test_keeps_what_brute_force_keeps(spark):
    rng = random.Random(1)
    rows = [t for _ in range(25) for t in chain(rng, rng.choice([3, 20, 60, 120]), rng.randint(2, 7))]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == kept_of(rows)


def test_pipeline_stage_links_at_a_similarity_of_0_8(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()) == kept_of(rows)


@pytest.mark.parametrize("max_bucket", [1 << 15, 4])
def test_a_group_that_is_only_linked_in_steps(spark, max_bucket):
    rng = random.Random(2)
    rows = list(enumerate(t for _ in range(4) for t in chain(rng, 80, 12)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, max_bucket=max_bucket).collect()) == kept_of(rows)


def test_pairs_at_the_threshold_are_found():
    # Sets of 45 shingles of which 40 are shared: exactly 0.8.
    rng = random.Random(6)
    for rows in (1_000, 10_000_000, 10_000_000_000):
        sketch, missed, n = simhash.Sketch(rows), 0, 400
        for _ in range(n):
            hashes = [rng.getrandbits(64) for _ in range(50)]
            a, b = (simhash.np.array(sorted(x), simhash.np.uint64) for x in (hashes[:45], hashes[5:]))
            fa, fb = ([v % (1 << 64) for v in sketch.fingerprints(x)] for x in (a, b))
            keys = ([f[t // sketch.per_word] >> (t % sketch.per_word * sketch.bits) & ((1 << sketch.bits) - 1) for t in range(sketch.tables)] for f in (fa, fb))
            near = sum((x ^ y).bit_count() for x, y in zip(fa, fb)) <= sketch.budget
            shared = [t for t, (x, y) in enumerate(zip(*keys)) if x == y]
            words = {(t // sketch.per_word + 1) % sketch.words for t in shared}
            missed += not (near and any((fa[w] ^ fb[w]).bit_count() <= sketch.word_budget for w in words))
        assert missed <= 0.01 * n


def test_carried_fingerprints_find_pairs_at_the_threshold():
    rng = random.Random(7)
    for rows in (1_000, 10_000_000, 10_000_000_000):
        sketch, missed, n = simhash.Sketch(rows), 0, 400
        assert sketch.carried == min(sketch.words, simhash.CARRIED)
        for _ in range(n):
            hashes = [rng.getrandbits(64) for _ in range(50)]
            a, b = (simhash.np.array(sorted(x), simhash.np.uint64) for x in (hashes[:45], hashes[5:]))
            fa, fb = ([v % (1 << 64) for v in sketch.fingerprints(x)] for x in (a, b))
            found = False
            for t in range(sketch.tables):
                word, shift = t // sketch.per_word, t % sketch.per_word * sketch.bits
                same = (fa[word] ^ fb[word]) >> shift & ((1 << sketch.bits) - 1) == 0
                bits = [(fa[w] ^ fb[w]).bit_count() for w in ((word + 1 + k) % sketch.words for k in range(sketch.carried))]
                found |= same and bits[0] <= sketch.word_budget and sum(bits) <= sketch.carried_budget
            missed += not found
        assert missed <= 0.01 * n


def test_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(1, a), (2, a), (1, b), (1, b), (None, b), (None, c), (None, c), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=repr) == sorted([(1, a), (1, b), (None, c), (8, "")], key=repr)


def test_odd_and_no_rows(odd, none):
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.keep_one(none).collect() == []
