"""Byte-level BPE: texts to token ids and back.

The pattern cuts a text into pieces.  A piece that is itself a token gives its
rank; any other piece starts as single bytes, and a segment tree over its byte
positions holds, at each position where a live token starts, the rank of that
token joined with the next one.  The root is the leftmost pair of least rank.  A
merge changes three leaves: that of the grown token, that of the token it took in,
and that of its live left neighbour; each change climbs the tree once.  Short pieces are
merged many at a time, a tree in each row of an array; longer ones have a tree of
their own.

Edge cases: a null or empty text has no tokens; a piece of any length is merged
whole, in O(n log n) steps and about 40 bytes of memory a byte; equal rows give equal results; an empty
table gives an empty result.  The ranks must hold every single byte, so any text
can be encoded.
"""

from __future__ import annotations

import base64
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, text_of

#: Pieces of at most so many bytes are merged many at a time and remembered, so many
#: of them in a task.
KEEP_BYTES, KEEP_PIECES = 64, 300_000
#: Pieces that are held before their ids are looked up, and rows of trees.
PIECES, ROWS = 1 << 18, 1 << 14
#: Texts longer than this are cut piece by piece, others at once (equal pieces).
LONG = 1 << 20
#: A leaf or node without a pair.
NONE = (1 << 63) - 1


def read_ranks(name: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 token, rank)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTree:
    """Segment tree over the byte positions of one piece.  A node holds the least
    ``rank << bits | position`` below it, so that of equal ranks the leftmost wins."""

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, len(keys) - 1).bit_length()
        self.tree = tree = array("q", [NONE]) * (2 * size)
        tree[size:size + len(keys)] = array("q", keys)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def least(self) -> int:
        return self.tree[1]

    def put(self, position: int, key: int) -> None:
        tree, i = self.tree, self.size + position
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return  # nothing changes above
            tree[i] = key


def merge_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one piece by merges in the order of rank, then of place."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    bits = n.bit_length()
    mask = (1 << bits) - 1

    def key(start: int, stop: int) -> int:
        rank = ranks.get(piece[start:stop]) if stop - start <= longest else None
        return NONE if rank is None else rank << bits | start

    tree = PairTree([key(i, i + 2) for i in range(n - 1)])
    stop = array("q", range(1, n + 1))  # where the live token that starts here ends
    before = array("q", range(-1, n))  # the live token left of the one that starts here
    while (found := tree.least()) != NONE:
        i = found & mask
        j = stop[i]
        end = stop[i] = stop[j]
        before[end] = i
        if j < n - 1:
            tree.put(j, NONE)
        tree.put(i, key(i, stop[end]) if end < n else NONE)
        if i:
            tree.put(before[i], key(before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:stop[i]]])
        i = stop[i]
    return out


class Merges:
    """The merges of a rank file, for single pieces and for many short ones at once:
    these are rows of one array of trees, and each step makes one merge in each row."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """``rank << bits | place`` of joined ids, NONE where they do not join (an id
        of -1 joins with nothing)."""
        pair = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.joined[at] << bits | place, NONE)

    def merge_rows(self, pieces: list[bytes], bits: int) -> list[bytes]:
        """Packed ids of pieces of at most ``2 ** bits`` bytes each."""
        size, n = 1 << bits, len(pieces)
        lengths = np.array([len(p) for p in pieces])
        column = np.arange(size)
        live = column < lengths[:, None]
        token = np.full((n, size + 2), -1, np.int64)  # -1 beyond the last byte and before the first
        token[:, :size][live] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        stop = np.tile(np.arange(1, size + 3), (n, 1))
        before = np.tile(np.arange(-1, size + 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = self.keys(token[:, :size], token[:, 1:size + 1], column, bits)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] != NONE]):
            found = tree[rows, 1]
            i = found & (size - 1)
            j = stop[rows, i]
            end, left = stop[rows, j], before[rows, i]
            grown = found >> bits
            token[rows, i], stop[rows, i], before[rows, end], live[rows, j] = grown, end, i, False
            right_key = self.keys(grown, token[rows, end], i, bits)
            left_key = self.keys(token[rows, left], grown, left, bits)  # the token at -1 is none
            tree[rows, size + j] = NONE
            tree[rows, size + i] = right_key
            has_left = left >= 0
            left = np.where(has_left, left, i)
            tree[rows, size + left] = np.where(has_left, left_key, right_key)
            for leaf in (j, i, left):
                node = leaf + size
                for _ in range(bits):
                    node >>= 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        packed, ends = token[:, :size][live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) <= KEEP_BYTES:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(k)
            else:
                out[k] = np.array(merge_piece(piece, self.ranks, self.longest), "<u4").tobytes()
        for bits, members in classes.items():
            for first in range(0, len(members), ROWS):
                part = members[first:first + ROWS]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part], bits)):
                    out[k] = ids
        return out


def encoder(name: str):
    """Function from texts to their packed ids.  Pieces wait until there are enough
    to merge many at once; ids of short pieces are remembered between calls."""
    import public_tokenizers
    import regex

    cut, merges, known = regex.compile(public_tokenizers.PATTERN), Merges(read_ranks(name)), {}

    def ids_of(parts: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(known) > KEEP_PIECES:
            known.clear()
        new = list(set().union(*(pieces for _, pieces in parts)).difference(known))
        data = [p.encode() for p in new]
        known.update(zip(new, merges.encode(data)))
        for row, pieces in parts:
            out[row].append(b"".join(map(known.__getitem__, pieces)))
        for piece, x in zip(new, data):
            if len(x) > KEEP_BYTES:
                del known[piece]

    def encode_texts(texts: list[str]) -> list[bytes]:
        out, waiting, n = [[] for _ in texts], [], 0
        for row, text in enumerate(texts):
            found = (m.group() for m in cut.finditer(text)) if len(text) > LONG else iter(cut.findall(text))
            while pieces := list(islice(found, PIECES)):
                waiting.append((row, pieces))
                n += len(pieces)
                if n >= PIECES:
                    ids_of(waiting, out)
                    waiting, n = [], 0
        ids_of(waiting, out)
        return [b"".join(x) for x in out]

    return encode_texts


def decoder(name: str):
    """Function from packed ids to bytes."""
    tokens = {rank: token for token, rank in read_ranks(name).items()}

    def decode_ids(packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(b"".join(map(tokens.__getitem__, ids[k:k + PIECES].tolist())) for k in range(0, len(ids), PIECES))

    return decode_ids


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens`` of
    every document, without special tokens."""

    def run(batches):
        encode_texts = encoder(name)
        for b in byte_portions(batches, "t"):
            ids = encode_texts(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("t")).mapInArrow(run, f"doc_id {id_type}, ids binary, n_tokens long")


def decode(encoded: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` (null: no bytes)."""
    from pyspark.sql import types as T

    def run(batches):
        decode_ids = decoder(name)
        for b in byte_portions(batches, "ids"):
            got = pa.array([decode_ids(x or b"") for x in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    out = decode(encode(docs, name), name)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
