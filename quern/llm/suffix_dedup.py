"""Suffix-array dedup: repeated byte strings by common-prefix intervals.

Texts are UTF-8 bytes; null is empty. A byte is removed when a string of
``min_len`` bytes covers it that starts at another place too, in the same
document or another one; matches never cross documents.

1. Every window of ``min_len`` bytes has an anchor: its ``gram``-byte string of
   the least hash, the first of equal ones. The anchor depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets. Windows in
   a row with one anchor are one *context*, about 69 windows on average.
2. Contexts whose anchor's hash occurs once hold nothing repeated: they end
   after one aggregation. Equal contexts become one, with a count.
3. The bytes of each remaining context are fetched once, and groups of anchors
   are put through an enhanced suffix array: the suffixes that start a window
   are sorted, with the common prefixes of neighbours, and a scan with a stack
   walks the tree of common-prefix intervals. A context with a count stands in
   the array twice, so that equal suffixes are an interval like any other. An
   interval of ``min_len`` or more whose members aren't all preceded by the
   same byte is a repeat, and all its members are its occurrences, not only
   neighbours.
4. The covered stretches go back to all places of each context, and are merged
   per document.

All removed bytes come from intervals of the array. For them a context's first
suffix passes for one that can't be extended to the left, as what stands before
it belongs to another context; ``maximal_repeats`` looks at the real bytes.

An anchor of over ``max_group`` different contexts is split by more bytes around
it, again and again if need be; at the end stand whole windows. Equal parts are
one with a count, so no group is left that grows with the data. The result
doesn't depend on ``max_group``.

Defined results: documents shorter than ``min_len`` keep everything; repeated
rows lose every string they have in common; ids may have any type and be null:
rows are told apart by hashes of id and text, so rows that agree in both get
the same result each. Long texts are hashed in chunks with an overlap, so
memory doesn't follow them in the first step; their bytes are held once where
spans are cut out. An empty table gives an empty result. Other columns, whatever
their names, are carried along as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if_small, discard, materialize, quoted, release, table, whole_row

MIN_LEN = 200
#: Bytes of an anchor: a power of two.
GRAM = 64
#: Bytes that are hashed at a time, without the overlap.
CHUNK = 1 << 19
#: Different contexts of one anchor that share a group at most.
MAX_GROUP = 512
#: Contexts that share a task's group, about.
GROUP_ROWS = 6000
SEED = 42
#: Bytes of a suffix that are compared at a time; the eighth says how many of them there are.
DIGIT = 7
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * _ODD[k]
    x += b
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each place on, by doubling."""
    h, width, k = _BYTE[data], 1, 0
    while 2 * width <= gram:
        h = _mix(h[:-width], h[width:], k)
        width, k = 2 * width, k + 1
    if width < gram:
        h = _mix(h[: len(h) - (gram - width)], h[gram - width :], k)
    h *= _ODD[k]
    h ^= h >> np.uint64(29)
    return h


def window_anchors(hashes: np.ndarray, span: int, pos_bits: int) -> np.ndarray:
    """The place of the least of each ``span`` hashes in a row, the first of equal ones.

    The lowest ``pos_bits`` bits of a hash give way to its place.
    """
    mask = np.uint64((1 << pos_bits) - 1)
    m = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: width - span], m[span - width :])
    return (m & mask).astype(np.int64)


def contexts_of(texts: list[bytes], min_len: int = MIN_LEN, gram: int = GRAM, chunk: int = CHUNK):
    """Yield arrays (text number, start, windows, anchor's hash, context's hash)."""
    bits = (chunk + 2 * min_len).bit_length()
    segments, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - min_len + 1, chunk):
            piece = text[at : at + chunk + min_len - 1]
            if size and size + len(piece) > chunk + min_len:
                yield _contexts(segments, min_len, gram, bits)
                segments, size = [], 0
            segments.append((number, at, piece))
            size += len(piece)
    if segments:
        yield _contexts(segments, min_len, gram, bits)


def _contexts(segments, min_len: int, gram: int, bits: int):
    data = np.frombuffer(b"".join(p for _, _, p in segments), np.uint8)
    lens = np.array([len(p) for _, _, p in segments])
    starts = np.cumsum(lens) - lens
    stops = starts + lens - min_len + 1  # of the windows
    hashes = gram_hashes(data, gram)
    anchor = window_anchors(hashes, min_len - gram + 1, bits)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    new[starts] = True
    valid = np.zeros(len(anchor) + 1, np.int64)
    valid[starts] += 1
    np.subtract.at(valid, stops[stops < len(valid)], 1)
    begin = np.flatnonzero(new & (np.cumsum(valid)[:-1] > 0))
    seg = np.searchsorted(starts, begin, "right") - 1
    end = np.minimum(np.r_[begin[1:], len(anchor)], stops[seg])
    windows, offset = end - begin, anchor[begin] - begin
    last = windows + min_len - 1 - gram
    mixed = (windows << 32 | offset).astype(np.uint64) * _ODD[63]
    for k, at in enumerate(range(0, 2 * min_len, gram)):
        mixed = _mix(mixed, hashes[begin + np.minimum(at, last)], 48 + k % 7)
    numbers, ats = np.array([n for n, _, _ in segments]), np.array([a for _, a, _ in segments])
    return numbers[seg], begin - starts[seg] + ats[seg], windows, hashes[anchor[begin]].view(np.int64), mixed.view(np.int64)


ANCHORS = pa.schema([("fp", pa.int64()), ("ctx", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _anchor_rows(min_len: int, gram: int, chunk: int):
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for number, start, windows, fp, ctx in contexts_of(texts, min_len, gram, chunk):
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ctx), batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], schema=ANCHORS)

    return run


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two arrays of digits share, at most as many as both have."""
    out = np.minimum(a & np.uint64(255), b & np.uint64(255)).astype(np.int64)
    differ = (a ^ b) >> np.uint64(8)
    for k in range(DIGIT):  # the k-th byte from the top differs: at most k are common
        out = np.where((differ >> np.uint64(8 * (DIGIT - 1 - k))) > 0, np.minimum(out, k), out)
        differ &= np.uint64((1 << (8 * (DIGIT - 1 - k))) - 1)
    return out


def _agree(data: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Are the strings of ``length`` bytes at a and b equal, pair by pair?"""
    if length < 8:
        return all((data[a + k] == data[b + k]).all() for k in range(length))
    return all((words[a + k] == words[b + k]).all() for k in [*range(0, length - 7, 8), length - 8])


def suffix_array(pieces: list[bytes], windows: np.ndarray, counts: np.ndarray, min_len: int):
    """(owner, place, lcp) of the suffixes that share min_len bytes with another one.

    ``windows``: how many suffixes of each piece count, from its start on.
    Suffixes are sorted by a hash of their first ``min_len`` bytes, which is
    checked, and then by the bytes that follow, ``DIGIT`` at a time and among
    equal ones only; no suffix goes beyond its piece. Any order in which equal
    prefixes stand together gives the same intervals. A suffix of a piece with
    a count of two or more stands twice. ``lcp``: common bytes with the suffix
    before, 0 where these are fewer than min_len.
    """
    lens = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(lens) - lens
    raw = b"".join(pieces) + bytes(min_len + 16)
    data = np.frombuffer(raw, np.uint8)
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    n = np.minimum(np.maximum(lens - min_len + 1, 0), windows)
    owner = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begins[owner] + place
    names = gram_hashes(data, min_len)[at]
    order = np.argsort(names, kind="stable")
    again = np.r_[False, names[order][1:] == names[order][:-1]]
    pair = np.flatnonzero(again)
    if not _agree(data, words, at[order[pair]], at[order[pair - 1]], min_len):  # different strings of one hash
        known: dict[bytes, int] = {}
        names = np.array([known.setdefault(raw[x : x + min_len], len(known)) for x in at.tolist()])
        order = np.argsort(names, kind="stable")
        again = np.r_[False, names[order][1:] == names[order][:-1]]
    kept = again | np.r_[again[1:], False] | (counts[owner[order]] > 1)
    order, again = order[kept], again[kept]
    lcp, rest = np.where(again, min_len, 0), lens[owner] - place
    run = np.cumsum(~again)
    depth = min_len
    active = np.flatnonzero(again | np.r_[again[1:], False])
    while len(active):
        entry = order[active]
        valid = np.clip(rest[entry] - depth, 0, DIGIT).astype(np.uint64)
        mask = np.where(valid > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(valid, np.uint64(1))), np.uint64(0))
        digit = (words[np.minimum(at[entry] + depth, len(words) - 1)].astype(np.uint64) & mask) | valid
        own = run[active]
        sort = np.lexsort((digit, own))
        order[active], digit = entry[sort], digit[sort]
        inner = np.flatnonzero(own[1:] == own[:-1]) + 1
        lcp[active[inner]] = depth + common_bytes(digit[inner], digit[inner - 1])
        tied = np.zeros(len(active), bool)
        tied[inner] = (digit[inner] == digit[inner - 1]) & ((digit[inner] & np.uint64(255)) == DIGIT)
        run[active] = np.cumsum(~tied)
        active = active[tied | np.r_[tied[1:], False]]
        depth += DIGIT
    twice = np.repeat(np.arange(len(order)), 1 + (counts[owner[order]] > 1))
    own = np.r_[False, twice[1:] == twice[:-1]]
    order = order[twice]
    return owner[order], place[order], np.where(own, rest[order], lcp[twice])


def maximal_intervals(lcp: list[int], changes: list[int], min_len: int):
    """Yield (first, last, length) of each maximal repeat, inner ones before outer ones.

    ``lcp[i]``: common prefix of the sorted suffixes i - 1 and i. ``changes[i]``:
    how often the preceding byte changed up to suffix i; an interval over which
    it never changes can be extended to the left and so isn't maximal.
    """
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) and lcp[i] >= min_len else 0
        first = i - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            if changes[i - 1] != changes[first]:
                yield first, i - 1, length
        if here and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def repeats_in(pieces: list[bytes], min_len: int = MIN_LEN, counts=None, before: list[bytes] | None = None, windows=None):
    """The enhanced suffix array of some byte strings, scanned for maximal repeats.

    ``counts``: how many equal strings each one stands for; ``before``: the
    byte that precedes each, empty at the start of a text or where it counts
    as one. Returns (owner, place, groups): the sorted suffixes as number of
    the string and offset in it, and arrays (first, last, length) over them.
    """
    counts = np.ones(len(pieces), np.int64) if counts is None else np.asarray(counts, np.int64)
    windows = np.full(len(pieces), 1 << 40) if windows is None else np.asarray(windows, np.int64)
    owner, place, lcp = suffix_array(pieces, windows, counts, min_len)
    if not len(owner):
        return owner, place, (np.empty(0, np.int64),) * 3
    data = np.frombuffer(b"".join(pieces) or b"\0", np.uint8)
    lens = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(lens) - lens
    edge = np.array([b[0] if b else -1 for b in before] if before is not None else np.full(len(pieces), -1), np.int64)
    left = np.where(place > 0, data[np.maximum(begins[owner] + place - 1, 0)].astype(np.int64), edge[owner])
    left = np.where(left < 0, 256 + np.arange(len(left)), left)
    differs = np.r_[False, left[1:] != left[:-1]]
    # Runs of suffixes that share min_len bytes; two suffixes are an interval without a stack.
    first = np.flatnonzero(lcp == 0)
    size = np.diff(np.r_[first, len(lcp)])
    two = first[size == 2]
    two = two[differs[two + 1]]
    found = [np.stack([two, two + 1, lcp[two + 1]])]
    many = np.repeat(size > 2, size)
    at = np.flatnonzero(many)
    if len(at):
        inner = list(maximal_intervals(lcp[at].tolist(), np.cumsum(differs[at]).tolist(), min_len))
        if inner:
            a = np.array(inner, np.int64).T
            found.append(np.stack([at[a[0]], at[a[1]], a[2]]))
    return owner, place, tuple(np.concatenate(found, axis=1))


def union(who: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """The union of the intervals of each owner, as arrays (owner, start, stop)."""
    order = np.lexsort((starts, who))
    lift = who[order].astype(np.int64) << 40
    starts, reach = starts[order] + lift, np.maximum.accumulate(stops[order] + lift)
    new = np.r_[True, starts[1:] > reach[:-1]][: len(starts)]
    at = np.flatnonzero(new)
    ends = reach[np.r_[at[1:] - 1, len(reach) - 1]] if len(at) else reach[:0]
    return who[order][at], starts[at] - lift[at], ends - lift[at]


SPANS = "fp long, ctx long, start int, stop int"


def _covered(min_len: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, place, (first, last, length) = repeats_in(pdf["piece"].tolist(), min_len, pdf["n"].to_numpy())
        # Longer intervals are written last, so that each suffix ends with its longest one.
        sort = np.argsort(length, kind="stable")
        reach = np.zeros(len(owner), np.int64)
        n = (last - first + 1)[sort]
        member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[sort], n)
        reach[member] = np.repeat(length[sort], n)
        hit = np.flatnonzero(reach)
        who, start, stop = union(owner[hit], place[hit], place[hit] + reach[hit])
        return pd.DataFrame({"fp": pdf["fp"].to_numpy()[who], "ctx": pdf["ctx"].to_numpy()[who], "start": start.astype(np.int32), "stop": stop.astype(np.int32)})

    return run


def grouped(pieces: DataFrame, key: str):
    """Pieces to be sorted, all of one key in one group, many keys in each."""
    spark = pieces.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // GROUP_ROWS)
    return pieces.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).groupBy("part")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and th (hashes of id and text) and text of each row."""
    return docs.select(F.xxhash64(quoted(doc_id)).alias("id"), F.xxhash64(quoted(text)).alias("th"), F.col(quoted(text)).cast("string").alias("text"))


def repeated_places(docs: DataFrame, min_len: int, gram: int, chunk: int) -> DataFrame:
    """Contexts (fp, ctx, id, th, start, windows) whose anchor occurs twice or more; materialized."""
    if gram & (gram - 1) or gram > min_len:
        raise ValueError("gram must be a power of two, and not over min_len")
    schema = "fp long, ctx long, id long, th long, start int, windows int"
    anchors = materialize(docs.mapInArrow(_anchor_rows(min_len, gram, chunk), schema), "anchors")
    twice = anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(twice.select(F.col("fp").alias("__fp")), "twice")
    places = materialize(anchors.join(twice, F.col("fp") == F.col("__fp"), "left_semi"), "places")
    discard(anchors, twice)
    release(docs.sparkSession)
    return places


def fetch(docs: DataFrame, wanted: DataFrame, cut) -> DataFrame:
    """The columns of ``wanted`` but id and th, with ``piece`` = cut(raw bytes, row).

    ``wanted``: id, th and others. Rows of one text are fetched together.
    """
    names = [c for c in wanted.columns if c not in ("id", "th")]
    by_doc = wanted.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct(*names)).alias("__need"))
    by_doc = materialize(by_doc, "needed")
    with_text = docs.join(by_doc, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th")))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    once = with_text.select(F.transform(F.array(raw), lambda b: F.transform("__need", lambda x: F.struct(*[x[c].alias(c) for c in names], *cut(b, x)))).alias("x"))
    return once.select(F.explode(F.flatten("x")).alias("x")).select("x.*")


def _bytes(raw, start, length):
    return F.call_function("substring", raw, start + 1, length)


def _anchor_offset(gram: int):
    """The place of the anchor in a context: the first gram of its hash."""

    @F.pandas_udf("int")
    def offset(pieces: pd.Series, fps: pd.Series) -> pd.Series:
        return pd.Series([int(np.argmax(gram_hashes(np.frombuffer(p, np.uint8), gram).view(np.int64) == fp)) for p, fp in zip(pieces, fps)])

    return offset


def split_contexts(hot: DataFrame, min_len: int, gram: int, max_group: int) -> DataFrame:
    """Parts of the contexts (fp, ctx, n, piece) of hot anchors, in groups of at most ``max_group``; materialized.

    The anchor stands at one of ``min_len - gram + 1`` offsets of a window. A
    context is halved into the windows of smaller and of larger offsets. All
    windows of a half share more bytes than the anchor, which make its ``key``;
    equal windows stay together. Halves of a key with over ``max_group``
    different ones are halved again; at last a half is one window and all
    halves of its key are equal. Halves of a key that occurs once end here.

    Returns fp, ctx, n, key, sub (a hash of the part), piece and at (its place in the context).
    """
    size = F.octet_length("piece") - min_len
    rows = hot.select("fp", "ctx", "n", F.lit(0).alias("at"), "piece", _anchor_offset(gram)("piece", "fp").alias("a"), F.lit(0).alias("lo"), F.lit(min_len - gram).alias("hi"))
    ready = []
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = rows.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("hi").alias("y")))))
        # The windows of the context that are of this half: offsets first to last.
        halves = halves.withColumns({"lo": F.col("half.x"), "hi": F.col("half.y"), "first": F.greatest("half.x", F.col("a") - size), "last": F.least("half.y", "a")}).where("first <= last")
        halves = halves.select("fp", "ctx", "n", (F.col("at") + F.col("a") - F.col("last")).alias("at"), _bytes(F.col("piece"), F.col("a") - F.col("last"), F.col("last") - F.col("first") + min_len).alias("piece"), F.col("last").alias("a"), "lo", "hi")
        shared = _bytes(F.col("piece"), F.col("a") - F.col("lo"), min_len - F.col("hi") + F.col("lo"))
        halves = materialize(halves.select("*", F.xxhash64("fp", "lo", "hi", shared).alias("key"), F.xxhash64("piece").alias("sub")), "halves")
        parts = halves.groupBy("key", "sub").agg(F.sum("n").alias("n"))
        sizes = materialize(parts.groupBy(F.col("key").alias("__key")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("total > 1").drop("total"), "sizes")
        placed = halves.join(sizes, F.col("key") == F.col("__key")).drop("__key")
        ready.append(materialize(placed.where(F.col("m") <= max_group).select("fp", "ctx", "n", "key", "sub", "piece", "at"), "ready"))
        rows = materialize(placed.where(F.col("m") > max_group).select(rows.columns), "hot")
        discard(halves, sizes)
        if rows.isEmpty():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    out = materialize(out, "halved")
    discard(*ready)
    return out


def covered_spans(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, max_group: int = MAX_GROUP, chunk: int = CHUNK) -> DataFrame:
    """id, th and spans (start, stop, start, ...; unmerged) of rows (id, th, text) with repeats; materialized."""
    spark = docs.sparkSession
    places = repeated_places(docs, min_len, gram, chunk)
    rep = F.min(F.struct("id", "th", "start", "windows")).alias("rep")
    own = materialize(places.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), rep), "contexts")
    hot = materialize(own.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_group).select(F.col("fp").alias("__fp")), "hot")
    wanted = own.select("rep.id", "rep.th", "fp", "ctx", "n", "rep.start", "rep.windows")
    pieces = fetch(docs, wanted, lambda raw, x: [_bytes(raw, x["start"], x["windows"] + min_len - 1).alias("piece")])
    pieces = pieces.select("fp", "ctx", "n", "piece").dropDuplicates(["fp", "ctx"])
    pieces = materialize(pieces.join(broadcast_if_small(hot), F.col("fp") == F.col("__fp"), "left"), "pieces")
    discard(own)
    release(spark)
    cold = pieces.where("__fp IS NULL").drop("__fp")
    spans = grouped(cold, "fp").applyInPandas(_covered(min_len), SPANS)
    made = [places, hot, pieces]
    if not hot.isEmpty():
        parts = split_contexts(pieces.where("__fp IS NOT NULL").drop("__fp"), min_len, gram, max_group)
        single = materialize(parts.groupBy("key", "sub").agg(F.sum("n").alias("n"), F.first("piece").alias("piece")), "parts")
        found = grouped(single.withColumnsRenamed({"key": "fp", "sub": "ctx"}), "fp").applyInPandas(_covered(min_len), SPANS)
        found = materialize(found.select(F.col("fp").alias("__key"), F.col("ctx").alias("__sub"), "start", "stop"), "hot-spans")
        hit = parts.select("fp", "ctx", "key", "sub", "at").join(found, (F.col("key") == F.col("__key")) & (F.col("sub") == F.col("__sub")))
        spans = spans.unionByName(hit.select("fp", "ctx", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop")))
        made += [parts, single, found]
    spans = materialize(spans.select(F.col("fp").alias("__fp"), F.col("ctx").alias("__ctx"), F.col("start").alias("__start"), "stop"), "spans")
    release(spark)
    hit = places.select("fp", "ctx", "id", "th", "start").join(spans, (F.col("fp") == F.col("__fp")) & (F.col("ctx") == F.col("__ctx")))
    moved = hit.select("id", "th", F.array(F.col("start") + F.col("__start"), F.col("start") + F.col("stop")).alias("span"))
    out = materialize(moved.groupBy("id", "th").agg(F.flatten(F.collect_list("span")).alias("spans")), "removed")
    discard(*made, spans)
    release(spark)
    return out


NODES = "repeat_id long, length int, fp long, ctx long, at int"


def _name(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "big", signed=True)


def _nodes(min_len: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pdf["piece"].tolist()
        owner, place, groups = repeats_in(pieces, min_len, pdf["n"].to_numpy(), pdf["before"].tolist(), pdf["windows"].to_numpy())
        names, lengths, members = [], [], [np.empty((2, 0), np.int64)]
        for first, last, length in zip(*(g.tolist() for g in groups)):
            p = int(place[first])
            # A piece that stands twice for its copies is one member.
            own = np.unique(np.stack([owner[first : last + 1], place[first : last + 1]]), axis=1)
            names.append(np.full(own.shape[1], _name(pieces[owner[first]][p : p + length])))
            lengths.append(np.full(own.shape[1], length))
            members.append(own)
        o, k = np.concatenate(members, axis=1)
        fp, ctx, at = (pdf[c].to_numpy() for c in ("fp", "ctx", "at"))
        return pd.DataFrame({"repeat_id": np.concatenate([np.empty(0, np.int64), *names]), "length": np.concatenate([np.empty(0, np.int64), *lengths]), "fp": fp[o], "ctx": ctx[o], "at": at[o] + k})

    return run


def _split_nodes(rows: DataFrame, width: int, max_group: int) -> tuple[DataFrame, list[DataFrame]]:
    """Intervals of classes that are too large for one group, found by aggregations.

    ``rows``: key, fp, ctx, n, before, piece (a suffix), at. All pieces of a
    key share a prefix, at first ``width`` bytes. The common prefix of a class
    is that of its least and greatest piece; the class is one interval, and
    falls into classes by the byte that follows. Returns the rows of classes
    of at most ``max_group`` pieces, and the intervals of the others.
    """

    @F.pandas_udf("int")
    def common(lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(lo, hi):
            x, y = (np.frombuffer(v[: min(len(a), len(b))], np.uint8) for v in (a, b))
            bad = np.flatnonzero(x != y)
            out.append(int(bad[0]) if len(bad) else len(x))
        return pd.Series(out)

    name = F.udf(lambda b: _name(bytes(b)), "long")
    small, nodes = [], []
    while True:
        size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.min("before").alias("b0"), F.max("before").alias("b1"))
        large = size.where(F.col("m") > max_group).select(F.col("key").alias("__key"), "total", common("lo", "hi").alias("depth"), "lo", "b0", "b1")
        large = materialize(large.withColumn("rid", name(F.substring("lo", F.lit(1), F.col("depth")))).drop("lo"), "classes")
        if large.isEmpty():
            return rows, nodes
        rest = materialize(rows.join(large.select("__key"), F.col("key") == F.col("__key"), "left_anti"), "small")
        inside = rows.join(large, F.col("key") == F.col("__key"))
        # Repeats of 2 * width or more are only noted here.
        diverse = (F.col("b0") != F.col("b1")) | ((F.octet_length("b0") == 0) & (F.col("total") > 1)) | (F.col("depth") >= 2 * width)
        nodes.append(materialize(inside.where(diverse).select(F.col("rid").alias("repeat_id"), F.col("depth").alias("length"), "fp", "ctx", "at"), "nodes"))
        deeper = inside.where((F.octet_length("piece") > F.col("depth")) & (F.col("depth") < 2 * width))
        key = F.xxhash64("key", "depth", F.substring("piece", F.col("depth") + 1, F.lit(1)))
        rows = materialize(rest.unionByName(deeper.select(key.alias("key"), *[c for c in rest.columns if c != "key"])), "split")


def repeats_of_width(docs: DataFrame, width: int, gram: int, max_group: int, chunk: int) -> DataFrame:
    """Maximal repeats of ``width`` to 2 * width - 1 bytes, and longer ones cut at 2 * width or more.

    Each context is taken with the byte before it and ``width`` bytes after it,
    so every suffix that starts in it shows 2 * width bytes or all there are.
    """
    spark = docs.sparkSession
    places = repeated_places(docs, width, gram, chunk)
    wanted = places.select("id", "th", "fp", F.col("id").alias("doc"), F.col("th").alias("hash"), "start", "windows")

    def cut(raw, x):
        return [_bytes(raw, x["start"] - 1, F.when(x["start"] > 0, 1).otherwise(0)).alias("before"), _bytes(raw, x["start"], x["windows"] + 2 * width - 1).alias("piece")]

    found = fetch(docs, wanted, cut)
    found = found.select("*", F.xxhash64("before", "piece", "windows").alias("ctx"))
    places = materialize(found.select("fp", "ctx", "doc", "hash", "start"), "copies")
    own = materialize(found.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("piece").alias("piece"), F.first("windows").alias("windows")), "contexts")
    hot = materialize(own.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_group).select(F.col("fp").alias("__fp")), "hot")
    own = own.join(broadcast_if_small(hot), F.col("fp") == F.col("__fp"), "left").withColumn("at", F.lit(0))
    nodes = [grouped(own.where("__fp IS NULL").drop("__fp"), "fp").applyInPandas(_nodes(width), NODES)]
    if not hot.isEmpty():
        each = own.where("__fp IS NOT NULL").select("fp", "ctx", "n", "before", "piece", F.explode(F.sequence(F.lit(0), F.least(F.col("windows"), F.octet_length("piece") - width + 1) - 1)).alias("at"))
        before = F.when(F.col("at") > 0, _bytes(F.col("piece"), F.col("at") - 1, F.lit(1))).otherwise(F.col("before"))
        suffix = _bytes(F.col("piece"), F.col("at"), F.lit(2 * width))
        each = each.select(F.xxhash64(F.substring(suffix, 1, width)).alias("key"), "fp", "ctx", "n", before.alias("before"), suffix.alias("piece"), "at")
        small, more = _split_nodes(materialize(each, "suffixes"), width, max_group)
        nodes += [grouped(small.withColumn("windows", F.lit(1)), "key").applyInPandas(_nodes(width), NODES), *more]
    all_nodes = nodes[0]
    for more in nodes[1:]:
        all_nodes = all_nodes.unionByName(more)
    all_nodes = materialize(all_nodes.distinct(), "nodes")
    out = all_nodes.join(places, ["fp", "ctx"]).select("repeat_id", "length", F.col("doc").alias("id"), F.col("hash").alias("th"), (F.col("start") + F.col("at")).alias("start"))
    return materialize(out.distinct(), "repeats")


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, gram: int = GRAM, max_group: int = MAX_GROUP, chunk: int = CHUNK) -> DataFrame:
    """repeat_id, length, doc_id and start of each occurrence of each maximal repeat.

    A string of ``min_len`` bytes or more that can't be made longer on either
    side without losing one of its occurrences. The lengths are covered in
    octaves: windows of w bytes find the repeats of w to 2w - 1, and documents
    in which longer ones begin are looked at again with windows of 2w. Repeated
    rows (equal id and text) count as one.
    """
    rows = materialize(docs.select(F.xxhash64(quoted(doc_id)).alias("id"), F.xxhash64(quoted(text)).alias("th"), F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(doc_id)).alias("doc_id")).dropDuplicates(["id", "th"]), "rows")
    left, width, out = rows.drop("doc_id"), min_len, None
    while True:
        found = repeats_of_width(left, width, gram, max_group, max(chunk, 2 * width))
        exact = found.where(F.col("length") < 2 * width)
        out = exact if out is None else out.unionByName(exact)
        longer = materialize(found.where(F.col("length") >= 2 * width).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "longer")
        if longer.isEmpty():
            break
        left, width = left.join(longer, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi"), 2 * width
    return out.join(rows.drop("text"), ["id", "th"]).select("repeat_id", "length", "doc_id", "start")


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` (as a struct ``row``) and its ``spans``, null if none."""
    found = covered_spans(keyed(docs, doc_id, text), **params)
    found = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans")
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64(quoted(doc_id)).alias("__rid"), F.xxhash64(quoted(text)).alias("__rth"))
    joined = rows.join(found, (F.col("__rid") == F.col("__id")) & (F.col("__rth") == F.col("__th")), "left")
    return joined.select("row", "spans")


def merged_spans(spans) -> list[int]:
    """Sorted disjoint start, stop, ... of an array of unmerged ones."""
    if spans is None or not len(spans):
        return []
    a = np.asarray(spans, np.int64)
    _, starts, stops = union(np.zeros(len(a) // 2, np.int64), a[0::2], a[1::2])
    return np.stack([starts, stops], 1).ravel().tolist()


def cut_out(raw: bytes, spans: list[int]) -> bytes:
    edges = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def whole_characters(raw: bytes, spans: list[int]) -> list[int]:
    """Shrink each span to the characters that lie wholly inside it."""
    out = []
    for a, b in zip(spans[0::2], spans[1::2]):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out += [a, b]
    return out


def removal_digests(found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of with_spans."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for text_, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
                raw, cut = (text_ or "").encode(), merged_spans(spans)
                kept = cut_out(raw, cut)
                rows.append((len(raw), len(raw) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    row = F.col("row")
    read = found.select(row.getField(doc_id).alias("doc_id"), row.getField(text).cast("string").alias("text"), "spans")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **params) -> DataFrame:
    """``docs`` without the repeated strings; whole characters are removed only.

    ``n_chars``, where there is such a column, follows the new text.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None:
                raw = t.encode()
                t = cut_out(raw, whole_characters(raw, merged_spans(s))).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    found = with_spans(docs, doc_id, text, **params)
    new = found.withColumn("new", F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(cut(F.col("row").getField(text), F.col("spans"))))
    given = {text: F.col("new")}
    if n_chars in docs.columns:
        given[n_chars] = F.when(F.col("spans").isNull(), F.col("row").getField(n_chars)).otherwise(F.char_length("new").cast(docs.schema[n_chars].dataType))
    return new.select(*[given.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without strings of 200 bytes that start elsewhere too."""
    return removal_digests(with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
