"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text of n symbols has n - 1 adjacent pairs. A segment tree holds, for each pair, its merge rank and
position (one number, rank first), so the root is the leftmost pair of lowest rank. A merge rewrites one
symbol, closes one leaf and changes at most two others; each change climbs log n nodes. It ends when the root
holds no mergeable pair, so a piece costs O(n log n) however long it is.

``merge_many`` runs the trees of many pieces side by side in numpy, one merge of each piece per step; pieces
longer than ``LONG`` symbols go through ``merge_one``. Pieces of text recur, so each worker keeps the ids of up to
``CACHE`` of them (emptied when full; it changes no result).

Odd input: null and empty texts have no ids and decode to the empty text; the text of an added token is that token.
Ids that are null decode to the empty text, ids out of the vocabulary are skipped, and bytes that are no UTF-8
decode to U+FFFD, as in the ``tokenizers`` library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map, bound_arrow_batches, texts_of
from .wordbpe import byte_symbols

PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = np.iinfo(np.int64).max
LONG = 256
CACHE = 300_000
BLOCK_CELLS = 1 << 18


class Bpe:
    """A vocabulary file of byte-level BPE. ``encode``: ids of texts; ``decode``: text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], byte_symbols()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = np.zeros(256, np.int64)  # id of each single byte
        for symbol, b in byte_of.items():
            self.first[b] = vocab[symbol]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            known = all(c in byte_of for c in token)
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they do not merge."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NONE)

    def merge_one(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, with the tree in lists."""
        symbol = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbol)
        size = 1 << max(1, (n - 1).bit_length())
        tree = [NONE] * (2 * size)
        rank = lambda i, j: r * size + i if (r := self.rank_of.get(symbol[i] << 32 | symbol[j])) is not None else NONE
        for i in range(n - 1):
            tree[size + i] = rank(i, i + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while (root := tree[1]) != NONE:
            r, i = divmod(root, size)
            j = after[i]
            symbol[i], gone[j] = int(self.merged[r]), 1
            k = after[i] = after[j]
            put(j, NONE)
            put(i, rank(i, k) if k < n else NONE)
            if k < n:
                before[k] = i
            if (h := before[i]) >= 0:
                put(h, rank(h, i))
        return np.array([s for s, g in zip(symbol, gone) if not g], np.uint32)

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (as bytes of 32-bit numbers) of pieces of 2 to ``size`` symbols, one tree for each."""
        count = len(pieces)
        n = np.array([len(p) for p in pieces])
        inside = np.arange(size) < n[:, None]
        symbol = np.zeros((count, size), np.int64)
        symbol[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 1), (count, size)).copy()
        before = np.broadcast_to(np.arange(-1, size - 1), (count, size)).copy()
        tree = np.full((count, 2 * size), NONE)
        place = np.arange(size - 1)
        pairs = self.ranks(symbol[:, :-1], symbol[:, 1:])
        tree[:, size : 2 * size - 1] = np.where((pairs != NONE) & inside[:, 1:], np.where(pairs != NONE, pairs, 0) * size + place, NONE)
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        alive = inside.copy()
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            rank, i = np.divmod(tree[row, 1], size)
            j = after[row, i]
            k = after[row, j]
            symbol[row, i] = self.merged[rank]
            alive[row, j] = False
            after[row, i] = k
            tree[row, size + j] = NONE
            more = k < n[row]
            tree[row, size + i] = NONE
            r, a, b = row[more], i[more], k[more]
            before[r, b] = a
            fresh = self.ranks(symbol[r, a], symbol[r, b])
            tree[r, size + a] = np.where(fresh != NONE, np.where(fresh != NONE, fresh, 0) * size + a, NONE)
            h = before[row, i]
            left = h >= 0
            r, a, b = row[left], h[left], i[left]
            fresh = self.ranks(symbol[r, a], symbol[r, b])
            tree[r, size + a] = np.where(fresh != NONE, np.where(fresh != NONE, fresh, 0) * size + a, NONE)
            rows, node = np.concatenate((row, row, r)), np.concatenate((i, j, a)) + size
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] != NONE]
        flat, ends = symbol[alive].astype(np.uint32).tobytes(), np.cumsum(alive.sum(1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces that are not in the cache there."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if len(raw) > LONG:
                self.cache[p] = self.merge_one(raw).tobytes()
            elif len(raw) == 1:
                self.cache[p] = self.first[raw[0]].astype(np.uint32).tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for size, own in by_size.items():
            step = max(1, BLOCK_CELLS // size)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                self.cache.update(zip([p for p, _ in part], self.merge_many([raw for _, raw in part], size)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [[t] if self.split is None else self.split.split(t) for t in texts]
        pieces = [[PIECE.findall(x) if not i % 2 else x for i, x in enumerate(parts)] for parts in cut]
        wanted = {p for parts in pieces for x in parts if isinstance(x, list) for p in x}
        missing = wanted - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE:
            self.cache, missing = {}, wanted
        self.learn(missing)
        get, out = self.cache.__getitem__, []
        for parts in pieces:
            raw = b"".join(b"".join(map(get, x)) if isinstance(x, list) else np.uint32(self.added[x]).tobytes() for x in parts)
            out.append(np.frombuffer(raw, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        known, size = self.bytes_of, len(self.bytes_of)
        return b"".join([known[i] for i in ids.tolist() if 0 <= i < size]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def encode_batch(vocabulary: str, texts: pa.Array) -> pa.ListArray:
    return list_array([x.view(np.int32) for x in load(vocabulary).encode(texts_of(texts))], pa.int32())


def decode_batch(vocabulary: str, ids: pa.ListArray) -> pa.Array:
    bpe, offsets, flat = load(vocabulary), ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([bpe.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids`` (replacing one of that name)."""
    bound_arrow_batches(df.sparkSession)
    df = df.drop(ids).withColumn(ids, F.col(text).cast("string")) if ids != text else df
    at = df.columns.index(ids)
    schema = df.select(*[F.lit(None).cast("array<int>").alias(ids) if c == ids else F.col(c) for c in df.columns]).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([encode_batch(vocabulary, x) if i == at else x for i, x in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(batch_map(run), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the string column ``text`` (replacing one of that name), decoded from ``ids``."""
    bound_arrow_batches(df.sparkSession)
    df = df.drop(text).withColumn(text, F.filter(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")), lambda i: i.isNotNull()))
    schema = df.select(*[F.lit("").alias(text) if c == text else F.col(c) for c in df.columns]).schema
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([decode_batch(vocabulary, x) if i == at else x for i, x in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(batch_map(run), schema)


def round_trip_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every document; counts and digests of the ids and of the decoded text."""
    from hashlib import sha256

    bound_arrow_batches(df.sparkSession)
    numbers: list[str] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_batch(vocabulary, batch.column(1))
        texts = decode_batch(vocabulary, ids)
        if not numbers:
            numbers.extend(map(str, range(len(load(vocabulary).bytes_of))))
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        digests = [sha256(",".join([numbers[i] for i in flat[a:b].tolist()]).encode()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(digests), pa.array([sha256(t.encode()).hexdigest() for t in texts.to_pylist()])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batch_map(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
