"""Byte-level BPE encoding and decoding with a given rank file.

Texts are cut by the split pattern into pieces, and each piece is encoded by
itself, so a block of documents only needs each distinct piece once. A task
cuts its documents into blocks of about ``block_bytes`` of text and folds the
ranked merges over the byte symbols of the block's distinct pieces: in each
step every piece merges the first of its pairs with the lowest rank, until no
pair has one. Nothing is shuffled, and memory follows the block.

A merged pair's rank is its symbol, so ranks are looked up by pair. The rank
map is an array under a perfect hash with one displacement per bucket, made on
the driver from the rank file, whose size doesn't depend on the data. An entry
holds the pair and its rank; XOR with the sought pair leaves the rank alone if
they agree, and something larger than any rank if not.

The fold has two forms with equal results. The main one works on all pieces of
a block at once, as arrays. The other, ``fold="sql"``, sends each block's
pieces through Spark's higher-order functions with the rank map as a literal;
it takes over four times the CPU seconds in all (see the README).

Decoding looks each symbol's bytes up in a literal and concatenates the binary
pieces, with higher-order functions.

Defined results: null and empty texts have no symbols and decode to nothing;
repeated rows are encoded one by one; an empty table gives no rows; other
columns, whatever their names, are left out. Pieces of over ``LONG`` bytes are
folded one by one, with a heap of their pairs: a text of n bytes without any
break takes n log n steps. Ranks must be below 65,536.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import let, quoted, table

BLOCK_BYTES = 6 << 20
#: Longer pieces are folded with a heap.
LONG = 256
#: Factors and moduli of the two hashes of a pair (all products fit 64 bits).
HASH_A = (40_503, 30_011)
HASH_B = (69_069, 104_729)
EMPTY = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of symbols that make a symbol: left, right and the rank."""
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    a = np.array(found, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class RankMap:
    """The rank of each pair under a perfect hash, as two arrays of numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = pair_ranks(ranks)
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ranks must fit 16 bits")
        self.buckets = _prime_from(max(len(left) // 3, 1) + 11)
        self.size = _prime_from(len(left) * 5 // 4 + 17)
        bucket = (left * HASH_A[0] + right * HASH_A[1]) % self.buckets
        slot = (left * HASH_B[0] + right * HASH_B[1]) % self.size
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(bucket, minlength=self.buckets))]
        self.shift = np.zeros(self.buckets, np.int64)
        self.entries = np.full(self.size, EMPTY, np.int64)
        taken = np.zeros(self.size, bool)
        packed = (((left << 16) | right) << 16) | rank
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            rows = order[cuts[b] : cuts[b + 1]]
            if not len(rows):
                break
            base = slot[rows]
            if len(np.unique(base)) < len(base):
                raise ValueError("two pairs of a bucket share a slot; change the factors")
            d = 0
            while taken[(base + d) % self.size].any():
                d += 1
            at = (base + d) % self.size
            taken[at], self.shift[b], self.entries[at] = True, d, packed[rows]

    @cached_property
    def by_pair(self) -> dict[int, int]:
        """The rank of each pair, by left << 16 | right."""
        known = self.entries[self.entries != EMPTY].tolist()
        return {e >> 16: e & 0xFFFF for e in known}

    def column(self, values: np.ndarray) -> Column:
        return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or 2**16 and more."""
        d = self.shift[(a * HASH_A[0] + b * HASH_A[1]) % self.buckets]
        return self.entries[(a * HASH_B[0] + b * HASH_B[1] + d) % self.size] ^ (((a << 16) | b) << 16)

    def lookup(self):
        """A function of two symbol columns that gives a rank, or 2**16 and more."""
        entries, shift = self.column(self.entries), self.column(self.shift)

        def rank(a: Column, b: Column) -> Column:
            d = F.get(shift, ((a * HASH_A[0] + b * HASH_A[1]) % self.buckets).cast("int"))
            e = F.get(entries, ((a * HASH_B[0] + b * HASH_B[1] + d) % self.size).cast("int"))
            return e.bitwiseXOR((a * (1 << 16) + b) * (1 << 16))

        return rank


def fold_long(symbols: np.ndarray, rank_map: RankMap) -> np.ndarray:
    """Fold the ranked merges over one long piece, with a heap of pairs over linked places."""
    ids, n, rank_of = symbols.tolist(), len(symbols), rank_map.by_pair
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = ids[i] << 16 | ids[i + 1]
        if (r := rank_of.get(pair)) is not None:
            heap.append((r, i, pair))
    heapq.heapify(heap)
    while heap:
        r, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or ids[i] << 16 | ids[j] != pair:
            continue  # one of the two has been merged since
        ids[i], ids[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right < n and (q := rank_of.get(new := ids[left] << 16 | ids[right])) is not None:
                heapq.heappush(heap, (q, left, new))
    return np.array([x for x in ids if x >= 0], np.int64)


def fold_merges(symbols: np.ndarray, lens: np.ndarray, rank_map: RankMap, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Fold the ranked merges over many pieces; those of over ``long`` symbols one by one."""
    cuts = np.r_[0, np.cumsum(lens)]
    alone = np.flatnonzero(lens > long)
    if not len(alone):
        return fold_short(symbols, lens, rank_map)
    short = np.where(lens > long, 0, lens)
    flat, out_lens = fold_short(symbols[np.repeat(lens <= long, lens)], short, rank_map)
    ends = np.cumsum(out_lens)
    parts, at = [], 0
    for k in alone.tolist():
        piece = fold_long(symbols[cuts[k] : cuts[k + 1]], rank_map)
        parts += [flat[at : ends[k]], piece]
        at, out_lens[k] = ends[k], len(piece)
    return np.concatenate([*parts, flat[at:]]), out_lens


def fold_short(symbols: np.ndarray, lens: np.ndarray, rank_map: RankMap) -> tuple[np.ndarray, np.ndarray]:
    """Fold the ranked merges over many pieces at once.

    ``symbols``: the byte symbols of all pieces; ``lens``: how many each has.
    Returns the same of what is left. A step takes one merge in each piece that
    has one, the leftmost of the lowest rank; finished pieces leave.
    """
    out_symbols, out_piece = [], []
    piece = np.repeat(np.arange(len(lens)), lens)
    while len(symbols):
        none = np.r_[piece[1:] != piece[:-1], True]
        rank = np.full(len(symbols), 1 << 16, np.int64)
        at = np.flatnonzero(~none)
        rank[at] = np.minimum(rank_map.ranks(symbols[at], symbols[at + 1]), 1 << 16)
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        least = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
        busy = least < (1 << 48)
        if not busy.all():
            done = ~np.repeat(busy, np.diff(np.r_[first, len(symbols)]))
            out_symbols.append(symbols[done])
            out_piece.append(piece[done])
        spot = least[busy] & 0xFFFFFFFF
        symbols[spot] = least[busy] >> 32
        keep = np.repeat(busy, np.diff(np.r_[first, len(symbols)]))
        keep[spot + 1] = False
        symbols, piece = symbols[keep], piece[keep]
    if not out_piece:
        return symbols, np.zeros(len(lens), np.int64)
    piece = np.concatenate(out_piece)
    order = np.argsort(piece, kind="stable")
    return np.concatenate(out_symbols)[order], np.bincount(piece, minlength=len(lens))


def merged(symbols: Column, rank) -> Column:
    """Fold the ranked merges over an array of byte symbols, by higher-order functions."""
    n = F.size(symbols)
    none = F.array().cast("array<bigint>")

    def merge(ids: Column, ranks: Column, m: Column, i: Column) -> Column:
        before = F.when(i > 1, F.concat(F.slice(ranks, 1, F.greatest(i - 2, F.lit(0))), F.array(rank(F.get(ids, i - 2), m)))).otherwise(none)
        after = F.when(i + 1 < F.size(ids), F.concat(F.array(rank(m, F.get(ids, i + 1))), F.slice(ranks, i + 2, F.size(ranks)))).otherwise(none)
        return F.struct(F.concat(F.slice(ids, 1, i - 1), F.array(m), F.slice(ids, i + 2, F.size(ids))).alias("ids"), F.concat(before, after).alias("ranks"))

    def step(s: Column, _: Column) -> Column:
        def of_least(m: Column) -> Column:
            at = F.array_position(s["ranks"], m).cast("int")
            return F.when(F.coalesce(m, F.lit(EMPTY)) >= 1 << 16, s).otherwise(let(at, lambda i: merge(s["ids"], s["ranks"], m, i)))

        return let(F.array_min(s["ranks"]), of_least)

    first = F.transform(F.sequence(F.lit(1), n - 1), lambda k: rank(F.get(symbols, k - 1), F.get(symbols, k)))
    start = F.struct(symbols.alias("ids"), first.alias("ranks"))
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["ids"])
    return F.when(n < 2, symbols).otherwise(folded)


def text_blocks(batches, ranks: dict[bytes, int], pattern: str, block_bytes: int):
    """Yield (docs, codes, words) for blocks of documents.

    ``words`` are the distinct pieces that aren't symbols themselves. A code is
    a place in ``words``, or -1 - symbol.
    """
    find = regex.compile(pattern).findall
    whole = {k.decode(): -1 - v for k, v in ranks.items() if _is_text(k)}
    docs, codes, size = [], [], 0
    known: dict[str, int] = {}
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code = []
            for w in find(text or ""):
                c = whole.get(w)
                if c is None:
                    c = known.get(w)
                    if c is None:
                        c = known[w] = len(known)
                code.append(c)
            docs.append(doc)
            codes.append(np.array(code, np.int32))
            size += len(text or "")
            if size >= block_bytes:
                yield docs, codes, [w.encode() for w in known]
                docs, codes, size, known = [], [], 0, {}
    if docs:
        yield docs, codes, [w.encode() for w in known]


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _byte_symbols(words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return symbol[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words], np.int64)


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _rows(docs: pa.Array, codes: list[np.ndarray], flat: np.ndarray, lens: np.ndarray, n_ranks: int, rows: int = 500):
    """Yield batches (doc_id, ids) of a block whose pieces are ``flat``, cut by ``lens``."""
    flat = np.r_[np.arange(n_ranks, dtype=np.int32), flat.astype(np.int32)]
    starts = np.r_[n_ranks + np.cumsum(lens) - lens, 0].astype(np.int64)
    lens = np.r_[lens, 1]
    for at in range(0, len(docs), rows):
        parts, sizes = [np.empty(0, np.int32)], []
        for code in codes[at : at + rows]:
            own = code < 0
            n = np.where(own, 1, lens[np.where(own, -1, code)])
            start = np.where(own, -1 - code, starts[np.where(own, -1, code)])
            total = np.cumsum(n)
            size = int(total[-1]) if len(total) else 0
            parts.append(flat[np.repeat(start - total + n, n) + np.arange(size)])
            sizes.append(size)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([docs.slice(at, rows), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)))], schema=IDS)


def _encode_arrays(ranks: dict[bytes, int], rank_map: RankMap, pattern: str, block_bytes: int):
    n_ranks = max(ranks.values()) + 1

    def run(batches):
        for docs, codes, words in text_blocks(batches, ranks, pattern, block_bytes):
            flat, lens = fold_merges(*_byte_symbols(words, ranks), rank_map)
            yield from _rows(pa.array(docs, pa.int64()), codes, flat, lens, n_ranks)

    return run


BLOCK = "docs array<bigint>, codes array<binary>, pieces array<array<bigint>>"


def _cut_blocks(ranks: dict[bytes, int], pattern: str, block_bytes: int):
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())), ("pieces", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for docs, codes, words in text_blocks(batches, ranks, pattern, block_bytes):
            flat, lens = _byte_symbols(words, ranks)
            pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(flat))
            outer = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pieces)
            yield pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), pa.array([[c.tobytes() for c in codes]], pa.list_(pa.binary())), outer], schema=schema)

    return run


def _join_pieces(n_ranks: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs, codes, pieces = (batch.column(c)[k].values for c in range(3))
                flat, lens = (x.to_numpy(zero_copy_only=False) for x in (pieces.flatten(), pieces.value_lengths()))
                yield from _rows(docs, [np.frombuffer(c, np.int32) for c in codes.to_pylist()], flat, lens.astype(np.int64), n_ranks)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fold: str = "arrays") -> DataFrame:
    """doc_id and ids (array of int) of each row; no special symbols are made."""
    ranks = read_ranks(default_ranks()) if ranks is None else ranks
    pattern = default_pattern() if pattern is None else pattern
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    rank_map = RankMap(ranks)
    if fold == "arrays":
        return rows.mapInArrow(_encode_arrays(ranks, rank_map, pattern, block_bytes), "doc_id long, ids array<int>")
    if fold != "sql":
        raise ValueError("fold is 'arrays' or 'sql'")
    rank = rank_map.lookup()
    blocks = rows.mapInArrow(_cut_blocks(ranks, pattern, block_bytes), BLOCK)
    folded = blocks.select("docs", "codes", F.transform("pieces", lambda p: merged(p, rank)).alias("pieces"))
    return folded.mapInArrow(_join_pieces(max(ranks.values()) + 1), "doc_id long, ids array<int>")


def decode(ids: Column, ranks: dict[bytes, int] | None = None) -> Column:
    """The bytes of an array of symbols."""
    ranks = read_ranks(default_ranks()) if ranks is None else ranks
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, r in ranks.items():
        pieces[r] = piece.hex()
    every = F.split(F.lit(",".join(pieces)), ",")
    nothing = F.lit(b"")
    # Chunks of about the root of the length: joining them copies no more than joining their pieces.
    step = F.greatest(F.lit(16), F.sqrt(F.size(ids)).cast("int"))

    def joined(k: Column) -> Column:
        return F.aggregate(F.slice(ids, k * step + 1, step), nothing, lambda out, i: F.concat(out, F.unhex(F.get(every, i))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / step).cast("int")), joined)
    return F.when(F.size(ids) == 0, nothing).otherwise(F.aggregate(chunks, nothing, lambda out, c: F.concat(out, c)))


def digests(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    ids = F.col("ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast(T.ArrayType(T.StringType())), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(ids, ranks), 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded again."""
    ranks = read_ranks(default_ranks())
    return digests(encode(table(spark, sf_dir, "documents"), ranks), ranks)
