"""SimHash near-dedup: fingerprints, and a self-join of binary tries.

The fingerprint of a text is made of the XXH64 (seed 42) of its word
shingles: a bit is set if over half of the shingles have it set. Distinct
fingerprints that differ in at most ``max_bits`` bits are linked.

The 64 bits are cut into ``BLOCKS`` blocks. Two linked fingerprints agree in
at least ``BLOCKS - max_bits`` of them, so the fingerprints are dealt once for
each choice of that many blocks, by the blocks' bits; no link is lost. Within
a bucket the other bits form a binary trie, and pairs of its nodes are walked
together from the root: each pair carries the number of bits in which its
prefixes differ, and is dropped once that exceeds the budget. Small nodes are
compared leaf by leaf. A bucket only passes on a spanning forest of its links.

A bucket of over ``max_bucket`` fingerprints is cut into blocks by a hash, and
each pair of blocks is a trie of its own with at most twice that many leaves;
no link is lost, and any budget will do.

``keep_one`` links by a similarity of texts, 0.8 or more of their distinct
five-word shingles (Jaccard). Two such texts differ in about 15% of the bits of
a fingerprint, far beyond a budget that single fingerprints can be joined by.
So each text has several fingerprints with seeds of their own, which are cut
into keys of a few bits. Texts with a key in common are walked in the trie of
another of these fingerprints, under a wide error budget, then compared by all
bits, and what remains is a candidate. Each link is checked exactly on the sets
of shingles. Keys get longer, and more, with the number of texts, so that a
pair at the threshold is missed with a probability of ``MISS`` at any size.

Only a forest of a bucket's closest candidates is checked first. Then all
candidates between texts that are still in different components are checked,
but for those that can't be similar: a set of which over a fifth is found in no
other one has no link, and two sets share at most what each shares with any.
A large group of near copies costs no check per pair, and loses no link.

Defined results: null and empty texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle hash the whole sequence; a row
without id gets the component of its fingerprint; components without any id
are null. Repeated rows share everything. Texts may be of any length: shingles
are hashed ``HASHES`` at a time. Empty tables give empty results, and other
columns, whatever their names, are carried in a struct of their own.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if_small, discard, materialize, one_per_label, quoted, release, table, whole_row
from quern.llm.components import connected_components
from quern.llm.url_filter import possible_hits

SHINGLE = 4
MAX_BITS = 4
#: Blocks of 64 bits by the number of distinct fingerprints: more blocks make longer keys.
BLOCKS = ((1 << 20, 6), (1 << 27, 7), (1 << 62, 8))
MAX_BUCKET = 1 << 15
LEAF_PAIRS = 1 << 6
FRONTIER = 1 << 20
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Hashes whose bits are counted at a time: bounds the memory of long texts.
HASHES = 1 << 16
#: Words of a shingle and the Jaccard similarity (as a fraction) of ``keep_one``.
SET_SHINGLE = 5
SIMILAR = (4, 5)
#: The share of pairs at the threshold that have no key in common.
MISS = 0.002
#: Texts that share a key by chance, about.
BUCKET_ROWS = 256
#: Rows of small buckets that share a task's group, about.
GROUP_ROWS = 500_000
#: Classes by which shingles are counted: a power of two.
CLASSES = 32
#: Standard deviations above the mean that an error budget allows.
SLACK = 4.5
#: Fingerprints that go along with a key, whatever the number of keys.
CARRIED = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    width = min(shingle, len(words))
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, HASHES):
        hashes = np.array([one(joined[a:b], 42) for a, b in zip(first[k : k + HASHES], last[k : k + HASHES])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", carry=("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The columns ``carry`` as a struct ``carried``, and ``fp`` bigint (the 64 bits, signed)."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in carry]).alias("carried"), fp(F.col(quoted(text))).alias("fp"))


def block_masks(n_distinct: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of the bits in which fingerprints of a bucket agree."""
    if max_bits == 0:
        return [(1 << 64) - 1]
    blocks = max(next(b for most, b in BLOCKS if n_distinct <= most), max_bits + 1)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed with the first one on top."""
    out = np.zeros(len(values), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((values >> np.uint64(b)) & np.uint64(1))
    return out


def trie_links(fps: np.ndarray, bucket: np.ndarray, free: list[int], max_bits: int = MAX_BITS, reduce=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows: same bucket, at most max_bits differing bits.

    ``free`` are the bits that the bucket leaves open, walked from the top.
    ``reduce`` takes the pairs of a slab and gives those to keep. A node is a run of the sorted rows, and a pair of nodes carries its depth
    implicitly: all pairs of a frontier stand on the same level.
    """
    order = np.lexsort((_gather(fps, free), bucket))
    keys, deal, values = _gather(fps, free)[order], bucket[order], fps[order]
    cuts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
    ends = np.r_[cuts[1:], len(deal)]
    found_a, found_b = [], []

    def leaves(a0, a1, b0, b1):
        """Compare all leaves under each pair of nodes."""
        na, nb = a1 - a0, b1 - b0
        size = na * nb
        at = 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), FRONTIER, "right")) + at)
            reps = size[at:stop]
            pair = np.repeat(np.arange(at, stop), reps)
            k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            i, j = a0[pair] + k // nb[pair], b0[pair] + k % nb[pair]
            good = i < j
            i, j = i[good], j[good]
            good = np.bitwise_count(values[i] ^ values[j]) <= max_bits
            i, j = order[i[good]], order[j[good]]
            if reduce is not None and len(i):
                i, j = reduce(i, j)
            found_a.append(i)
            found_b.append(j)
            at = stop

    def walk(level, a0, a1, b0, b1, errors):
        while len(a0):
            small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (level == len(free))
            if small.any():
                leaves(a0[small], a1[small], b0[small], b1[small])
                a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
            if not len(a0):
                return
            if len(a0) > FRONTIER:  # depth first from here: bounds the frontier
                half = len(a0) // 2
                walk(level, a0[:half], a1[:half], b0[:half], b1[:half], errors[:half])
                a0, a1, b0, b1, errors = (x[half:] for x in (a0, a1, b0, b1, errors))
                continue
            bit = (keys >> np.uint64(len(free) - 1 - level)) & np.uint64(1)
            ones = np.r_[0, np.cumsum(bit)].astype(np.int64)
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same = (a0 == b0) & (a1 == b1)
            kids = [
                (a0, am, b0, bm, errors, None),
                (am, a1, bm, b1, errors, None),
                (a0, am, bm, b1, errors + 1, None),
                (am, a1, b0, bm, errors + 1, ~same),
            ]
            parts = []
            for x0, x1, y0, y1, e, also in kids:
                keep = (x1 > x0) & (y1 > y0) & (e <= max_bits)
                if also is not None:
                    keep &= also
                parts.append([v[keep] for v in (x0, x1, y0, y1, e)])
            a0, a1, b0, b1, errors = (np.concatenate(c) for c in zip(*parts))
            level += 1

    walk(0, cuts, ends, cuts, ends, np.zeros(len(cuts), np.int64))
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n nodes that isn't the smallest of its component: (node, smallest)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def minimum_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of the pairs that make a spanning forest of least weight, earlier ones first among equals."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    label, left, kept = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while True:
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return order[np.concatenate(kept)]
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        pick = np.unique(best[best < len(a)])
        kept.append(pick)
        moved, to = spanning_forest(n, label[a[pick]], label[b[pick]])
        joined = np.arange(n)
        joined[moved] = to
        label = joined[label]


def _bucket_links(max_bits: int, masks: list[int]):
    free = {k: [b for b in range(63, -1, -1) if not m >> b & 1] for k, m in enumerate(masks)}

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mask, rows in pdf.groupby("mask", sort=True):
            fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
            bucket = rows.groupby(["key", "lo", "hi"]).ngroup().to_numpy()
            a, b = trie_links(fps, bucket, free[int(mask)], max_bits)
            x, y = spanning_forest(len(fps), a, b)
            out.append(pd.DataFrame({"a": fps[x].view(np.int64), "b": fps[y].view(np.int64)}))
        return pd.concat(out)

    return links


def dealt_to_tasks(rows: DataFrame, key: list[str], item: str, max_bucket: int):
    """``rows`` grouped into tasks by bucket ``key``, with the numbers lo and hi of its blocks.

    Many small buckets share a group, so that numpy works on long arrays. Each
    pair of blocks of a large one is a group of its own. Buckets of one row go.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select(*[F.col(k).alias(f"__{k}") for k in key], "n", F.ceil(F.col("n") / max_bucket).cast("int").alias("blocks")), "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // GROUP_ROWS)
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    shared = rows.join(sizes, same).drop(*[f"__{k}" for k in key], "n")
    shared = shared.withColumn("blk", F.pmod(F.xxhash64(item, F.lit(7)), F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")})
    part = F.when(F.col("blocks") > 1, F.xxhash64(*key, "lo", "hi")).otherwise(F.pmod(F.xxhash64(*key), F.lit(parts)))
    return shared.withColumn("part", part).drop("blk", "other", "blocks").groupBy("part")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect what fingerprints within max_bits connect.

    ``fps``: distinct fingerprints ``fp``, materialized.
    """
    masks = block_masks(fps.count(), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("mask", "bits"))
    dealt = dealt.select("fp", F.col("mask").cast("int").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    return dealt_to_tasks(dealt, ["mask", "key"], "fp", max_bucket).applyInPandas(_bucket_links(max_bits, masks), "a long, b long")


def component_of_fingerprints(pairs: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """fp, label (smallest fp of the component) and component_id (smallest doc_id) of rows (doc_id, fp)."""
    known = materialize(pairs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    links = materialize(fingerprint_links(known.select("fp"), max_bits, max_bucket).distinct(), "links")
    labels = connected_components(links)
    joined = known.join(labels, known["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    joined = materialize(joined, "labelled")
    least = materialize(joined.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    classes = materialize(joined.join(broadcast_if_small(least), "label").select("fp", "label", "component_id"), "classes")
    discard(known, links, labels, joined, least)
    return classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    pairs = with_fingerprints(docs, text, [doc_id], shingle).select(F.col("carried").getField(doc_id).alias("doc_id"), "fp")
    pairs = materialize(pairs, "simhash")
    classes = component_of_fingerprints(pairs, max_bits, max_bucket).withColumnRenamed("fp", "__fp")
    out = pairs.join(classes, F.col("fp") == F.col("__fp"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle: int = SET_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    one = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((one(joined[a:b], 42) for a, b in spans), np.uint64, n))


class Sketch:
    """How sets are fingerprinted: fingerprints, keys of them and error budgets.

    ``words`` fingerprints of 64 bits are cut into ``tables`` keys of ``bits``
    bits. ``carried`` fingerprints go along with each key, its own not among
    them where there are others. ``word_budget``, ``carried_budget`` and
    ``budget`` are the bits in which one, the carried and all fingerprints of
    two similar sets may differ.
    """

    def __init__(self, rows: int, similar=SIMILAR, miss: float = MISS):
        share = similar[0] / similar[1]
        # The cosine of two equally large sets of that similarity, and the share of differing bits.
        differ = acos(2 * share / (1 + share)) / pi
        self.bits = max(10, ceil(log2(max(rows, 1) / BUCKET_ROWS))) if rows else 10
        self.tables = ceil(log(miss) / log(1 - (1 - differ) ** self.bits))
        self.per_word = 64 // self.bits
        self.words = max(ceil(self.tables / self.per_word), 2)
        self.carried = min(self.words, CARRIED)
        bits = (64, 64 * self.carried, 64 * self.words)
        self.word_budget, self.carried_budget, self.budget = (ceil(n * differ + SLACK * sqrt(n * differ * (1 - differ))) for n in bits)
        rng = np.random.default_rng(42)
        self.flips, self.factors = (rng.integers(0, 1 << 63, self.words, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def fingerprints(self, hashes: np.ndarray) -> list[int]:
        """One signed fingerprint per seed; bits that half of the hashes have set follow the first hash."""
        n = len(hashes)
        if not n:
            return [0] * self.words
        counts = np.zeros(64 * self.words, np.int64)
        for k in range(0, n, 1 << 12):
            v = (hashes[k : k + (1 << 12), None] ^ self.flips) * self.factors
            v ^= v >> np.uint64(32)
            v *= self.factors
            v ^= v >> np.uint64(29)
            bits = np.unpackbits(v.view(np.uint8).reshape(len(v), -1), axis=1)
            counts += bits.sum(axis=0, dtype=np.uint16)
            if k == 0:
                tie = bits[0]
        return np.packbits((2 * counts > n) | ((2 * counts == n) & (tie == 1))).view(np.int64).tolist()

    def key(self, t: int) -> Column:
        word, slot = divmod(t, self.per_word)
        return F.shiftrightunsigned(f"w{word}", slot * self.bits).bitwiseAND(F.lit((1 << self.bits) - 1))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 42)], np.uint64).view(np.int64)[0])


def _sketches(sketch: Sketch, shingle: int):
    @F.pandas_udf("sid long, size int, fps array<long>")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, shingle) for t in texts]
        return pd.DataFrame({"sid": np.array([set_id(h) for h in sets], np.int64), "size": np.array([len(h) for h in sets], np.int32), "fps": [sketch.fingerprints(h) for h in sets]})

    return sketches


def _hash_sets(shingle: int):
    @F.pandas_udf("array<long>")
    def hash_sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).view(np.int64) for t in texts])

    return hash_sets


def _candidates(sketch: Sketch, forest: bool, similar):
    """Candidate pairs of sets in one bucket: a forest of the closest ones, or all between different components."""
    one, two = similar

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby("word", sort=True):
            fps = rows[[f"c{k}" for k in range(sketch.carried)]].to_numpy(np.int64).view(np.uint64)
            sid, size = (rows[c].to_numpy() for c in ("sid", "size"))
            label = sid if forest else rows["label"].to_numpy()
            shared = size[:, None] if forest else np.stack(rows["shared"].to_numpy())
            bucket = rows.groupby(["t", "key", "lo", "hi"]).ngroup().to_numpy()
            closest = [np.empty(0, np.int64)] * 3

            def near(i, j):
                i, j = (x[label[i] != label[j]] for x in (i, j))
                differ = sum(np.bitwise_count(fps[i, k] ^ fps[j, k]).astype(np.int64) for k in range(sketch.carried))
                i, j, differ = (x[differ <= sketch.carried_budget] for x in (i, j, differ))
                most = np.zeros(len(i), np.int64)
                for c in shared.T:
                    most += np.minimum(c[i], c[j])
                good = two * most >= one * (size[i] + size[j] - most)
                if not forest:
                    return i[good], j[good]
                both = [np.concatenate(c) for c in zip(closest, (i[good], j[good], differ[good]))]
                keep = minimum_forest(len(sid), *both)
                closest[:] = [c[keep] for c in both]
                return closest[0][:0], closest[0][:0]

            i, j = trie_links(fps[:, 0].copy(), bucket, list(range(63, -1, -1)), sketch.word_budget, near)
            if forest:
                i, j = closest[:2]
            out.append(pd.DataFrame({"a": np.maximum(sid[i], sid[j]), "b": np.minimum(sid[i], sid[j])}).drop_duplicates())
        return pd.concat(out)

    return links


def candidate_pairs(sketched: DataFrame, sketch: Sketch, forest: bool, max_bucket: int, similar=SIMILAR) -> DataFrame:
    """Pairs (a, b) of sets with a key in common that the carried fingerprints call similar; materialized.

    ``sketched``: sid, w0, w1, ... and size (of the set); for other pairs than
    a forest's also label (a component; pairs are between different ones) and
    shared (an array, by classes of shingles: how many of the set's another one
    may have. The sum of the lesser counts bounds what two sets have in common).
    """
    also = ["sid", "size", *[c for c in ("label", "shared") if not forest]]
    keyed = sketched.select(*also, F.array(*[f"w{k}" for k in range(sketch.words)]).alias("fps"), F.posexplode(F.array(*[sketch.key(t) for t in range(sketch.tables)])).alias("t", "key"))
    # The trie is that of a fingerprint which the key isn't part of.
    keyed = keyed.withColumn("word", F.pmod(F.floor(F.col("t") / sketch.per_word) + 1, F.lit(sketch.words)).cast("int"))
    carried = [F.get("fps", F.pmod(F.col("word") + k, F.lit(sketch.words))).alias(f"c{k}") for k in range(sketch.carried)]
    keyed = keyed.select(*also, *carried, "t", "key", "word")
    groups = dealt_to_tasks(keyed, ["t", "key"], "sid", max_bucket)
    return materialize(groups.applyInPandas(_candidates(sketch, forest, similar), "a long, b long").distinct(), "candidates")


def _checked(pairs: DataFrame, sets: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    one, two = similar
    left = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    # Sizes that can't be similar are never intersected.
    both = both.where(two * F.least(F.size("ha"), F.size("hb")) >= one * F.greatest(F.size("ha"), F.size("hb")))
    both = both.withColumn("n", F.size(F.array_intersect("ha", "hb")))
    return both.where(two * F.col("n") >= one * (F.size("ha") + F.size("hb") - F.col("n"))).select("a", "b")


def shared_counts(sets: DataFrame) -> DataFrame:
    """sid and shared: how many hashes of each set (sid, hashes) some other one has, by class."""

    @F.pandas_udf("array<int>")
    def counts(hashes: pd.Series, alone: pd.Series) -> pd.Series:
        def of(x):
            return np.bincount(np.asarray(x, np.int64) & (CLASSES - 1), minlength=CLASSES)

        return pd.Series([(of(h) - (0 if a is None else of(a))).astype(np.int32) for h, a in zip(hashes, alone)])

    own = sets.select("sid", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid"))
    # No more than the set holds.
    alone = own.where("n = 1").groupBy("sid").agg(F.collect_list("h").alias("alone"))
    return sets.join(alone, "sid", "left").select("sid", counts("hashes", "alone").alias("shared"))


def set_links(rows: DataFrame, sketch: Sketch, shingle: int = SET_SHINGLE, similar=SIMILAR, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect the similar sets of rows (rid, sid, size, fps, text); materialized.

    ``rows``: materialized.
    """
    one, two = similar
    words = [F.get("fps", F.lit(k)).alias(f"w{k}") for k in range(sketch.words)]
    named = materialize(rows.where("size > 0").groupBy("sid").agg(F.min("rid").alias("rid"), F.first("size").alias("size"), F.first("fps").alias("fps")), "sets")
    sketched = named.select("sid", "size", *words)
    pairs = candidate_pairs(sketched, sketch, True, max_bucket, similar)
    release(rows.sparkSession)
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "asked")
    # Copies of one set share its name; any of their texts has the same shingles.
    firsts = materialize(named.select("sid", "rid").join(asked, "sid", "left_semi"), "firsts")
    texts, _ = possible_hits(rows.select("rid", "text"), "rid", firsts.select("rid"))
    texts = texts.join(firsts, "rid").select("sid", "text")
    sets = materialize(texts.select("sid", _hash_sets(shingle)("text").alias("hashes")), "hashes")
    del texts
    links = materialize(_checked(pairs, sets, similar), "links")
    release(rows.sparkSession)
    labels = connected_components(links)
    # Only sets with a candidate can have more of them, and only if enough of their shingles are found in another one.
    again = sketched.join(shared_counts(sets), "sid")
    again = again.where(two * F.aggregate("shared", F.lit(0), lambda x, y: x + y) >= one * F.col("size"))
    again = again.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    again = materialize(again.select("*", F.coalesce("component", "sid").alias("label")).drop("component"), "again")
    release(rows.sparkSession)
    more = candidate_pairs(again, sketch, False, max_bucket, similar)
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "more")
    out = materialize(links.unionByName(_checked(more, sets, similar)), "links")
    discard(named, pairs, asked, firsts, sets, links, labels, again, more)
    release(rows.sparkSession)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SET_SHINGLE, similar=SIMILAR, miss: float = MISS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of each group of similar texts, that with the smallest id, with all columns.

    Rows without id come last; among equal ids a hash of the row decides. Null
    and empty texts have the empty set and are one group.
    """
    sketch = Sketch(docs.count(), similar, miss)
    found = docs.select(whole_row(docs).alias("carried"), _sketches(sketch, shingle)(F.col(quoted(text))).alias("s"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(found.select("rid", "carried", "s.sid", "s.size", "s.fps"), "shingles")
    links = set_links(rows.select("rid", "sid", "size", "fps", F.col("carried").getField(text).alias("text")), sketch, shingle, similar, max_bucket)
    labels = connected_components(links)
    named = rows.select("rid", "sid", F.col("carried").getField(doc_id).alias("id"), F.xxhash64("carried").alias("hash"))
    # Copies are combined before the join, so that no large group of them meets in one task.
    sets = materialize(one_per_label(named, "sid"), "sets")
    joined = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    kept = one_per_label(joined.select(F.coalesce("component", "sid").alias("label"), "id", "hash", "rid"), "label")
    kept = materialize(kept.select("rid"), "kept")
    # Most rows stay: a Bloom filter of the others spares them the shuffle.
    dropped = materialize(rows.select("rid").join(kept, "rid", "left_anti"), "dropped")
    unsure, stay = possible_hits(rows.select("rid", "carried"), "rid", dropped)
    return unsure.join(dropped, "rid", "left_anti").unionByName(stay).select("carried.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, linked at four differing bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"))
