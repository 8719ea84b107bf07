"""Byte-level BPE encoding and decoding, with a segment tree over byte positions.

A piece of n bytes starts as n one-byte tokens. Leaf i of the segment tree holds the rank of the pair that
starts at byte i, packed with i, so the root is always the leftmost pair of the lowest rank. A merge touches
three leaves: the pair at the merged token, the pair of its live left neighbour, and the pair of the byte
position that died; each is a point update on a path of log2(n) nodes.

Many short pieces take the same number of levels, so they are merged in step: the trees of thousands of pieces
lie side by side in one array and every step does one merge in each piece that has any left. Long pieces use
the same tree one at a time.

A worker holds the texts of one Arrow batch, the ids of GROUP_CHARS of them (of one text, if that is longer), and bounded tables
of pieces; results leave it group by group.

Defined results: a null text is the empty text (no ids); an empty text has no ids; texts are never cut; every row is encoded
by itself, so null and repeated doc_ids and equal rows are kept as they are; columns are passed by expression, so names of
further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoin.llm.common import groups

#: Pieces up to this many bytes are merged side by side.
WIDE = 256
#: Trees merged in step at a time.
SIDE_BY_SIDE = 16_384
#: Pieces whose ids a worker remembers, and their characters; it forgets all of them when they are more.
REMEMBERED, REMEMBERED_CHARS = 200_000, 3_000_000
#: Characters of text that are encoded and returned together.
GROUP_CHARS = 1_000_000

_NONE = np.int64(1) << 62


class Codec:
    """Ranks of one rank file, and the pattern that splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: whole for whole, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.base = max(self.bytes_of) + 1
        pairs = {}
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                left, right = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [0], dtype=np.int64)
        self.keys = np.append(self.keys, np.int64(1) << 61)
        self.seen: dict[str, bytes] = {}
        self.seen_chars = 0

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; _NONE where a side is missing or the pair never merges."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    # one long piece -------------------------------------------------------------------------------

    def merge_long(self, piece: bytes) -> bytes:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()
        low, far = (1 << shift) - 1, int(_NONE)
        token = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pair_rank(np.array(token[:-1], np.int64), np.array(token[1:], np.int64))
        leaves = np.full(size, far, np.int64)
        leaves[: n - 1] = np.where(rank < _NONE, (rank << shift) | np.arange(n - 1), _NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [far, *np.concatenate(levels[::-1]).tolist()]
        known = self._known()

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                value = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == value:
                    return
                tree[at] = value

        while (root := tree[1]) < far:
            at, new = root & low, root >> shift
            dead = after[at]
            nxt, prev = after[dead], before[at]
            token[at], token[dead], after[at] = new, -1, nxt
            put(dead, far)
            right = far
            if nxt < n:
                before[nxt] = at
                right = known.get(new * self.base + token[nxt], far)
            put(at, right << shift | at if right < far else far)
            if prev >= 0:
                left = known.get(token[prev] * self.base + new, far)
                put(prev, left << shift | prev if left < far else far)
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def _known(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys[:-1].tolist(), self.merged[:-1].tolist(), strict=True))
        return self._pairs

    # many short pieces ----------------------------------------------------------------------------

    def merge_side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Merges pieces of at most ``size`` bytes (a power of two) in step. Positions count from 1; 0 and n + 1 are borders."""
        n, many = np.array([len(p) for p in pieces]), len(pieces)
        token = np.full((size + 2, many), -1, np.int64)
        flat = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        column = np.repeat(np.arange(many), n)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
        token[row, column] = flat
        after = np.repeat(np.arange(1, size + 3)[:, None], many, 1).ravel()
        before = np.repeat(np.arange(-1, size + 1)[:, None], many, 1).ravel()
        places = np.arange(size)[:, None]
        tree = np.empty((2 * size, many), np.int64)
        rank = self.pair_rank(token[:size], token[1 : size + 1])
        tree[size:] = np.where(rank < _NONE, (rank << 16) | places, _NONE)
        at = size
        while at > 1:
            np.minimum(tree[at : 2 * at : 2], tree[at + 1 : 2 * at : 2], out=tree[at // 2 : at])
            at //= 2
        token, tree = token.ravel(), tree.ravel()
        col = np.arange(many)
        while True:
            root = tree[many + col]
            live = root < _NONE
            if not live.all():
                col, root = col[live], root[live]
            if not len(col):
                break
            at, new = root & 0xFFFF, root >> 16
            here = at * many + col
            dead = after[here]
            gone = dead * many + col
            nxt, prev = after[gone], before[here]
            right, left = nxt * many + col, prev * many + col
            token[here], token[gone] = new, -1
            after[here], before[right] = nxt, at
            r, le = self.pair_rank(new, token[right]), self.pair_rank(token[left], new)
            down = size * many
            # a dead or last position can lie beyond the leaves only as a border, which never starts a pair
            tree[np.minimum(dead, size - 1) * many + col + down] = np.where(dead < size, _NONE, tree[(size - 1) * many + col + down])
            tree[here + down] = np.where(r < _NONE, (r << 16) | at, _NONE)
            tree[left + down] = np.where(le < _NONE, (le << 16) | prev, _NONE)
            nodes = [size + np.minimum(dead, size - 1), size + at, size + prev]
            step = size
            while step > 1:
                step //= 2
                for i in range(3):
                    nodes[i] = nodes[i] >> 1
                    child = nodes[i] * (2 * many) + col
                    tree[nodes[i] * many + col] = np.minimum(tree[child], tree[child + many])
        ids = token.reshape(size + 2, many).T
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1)) * 4
        out = ids[kept].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    # texts ----------------------------------------------------------------------------------------

    def learn(self, pieces: set[str]) -> None:
        """Merges pieces that are not yet remembered."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.seen[p] = whole.to_bytes(4, "little")
            elif len(b) > WIDE:
                self.seen[p] = self.merge_long(b)
            else:
                sizes.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for size, found in sizes.items():
            width = max(64, min(SIDE_BY_SIDE, (SIDE_BY_SIDE * 16) // size))
            for i in range(0, len(found), width):
                part = found[i : i + width]
                self.seen.update(zip([p for p, _ in part], self.merge_side_by_side([b for _, b in part], size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        for part in groups(texts, GROUP_CHARS):
            split = [self.find(t) for t in part]
            new: set[str] = set()
            for pieces in split:
                new.update(pieces)
            fresh = new.difference(self.seen)
            chars = sum(map(len, fresh))
            if len(self.seen) + len(fresh) > REMEMBERED or self.seen_chars + chars > REMEMBERED_CHARS:
                self.forget()
                fresh, chars = new, sum(map(len, new))
            self.seen_chars += chars
            self.learn(fresh)
            out += [b"".join(map(self.seen.__getitem__, pieces)) for pieces in split]
        return out

    def forget(self) -> None:
        self.seen.clear()
        self.seen_chars = 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, loaded once in each worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _parts(batches: Iterator[pd.Series]) -> Iterator[list[str]]:
    """The texts of Arrow batches in groups of GROUP_CHARS."""
    for batch in batches:
        yield from groups((t or "" for t in batch), GROUP_CHARS)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """struct<ids array<int>, n_tokens long> of a text column."""

    @F.pandas_udf("ids array<int>, n_tokens long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in _parts(batches):
            ids = [np.frombuffer(x, "<i4") for x in own.encode(texts)]
            yield pd.DataFrame({"ids": ids, "n_tokens": [len(x) for x in ids]})
        own.forget()

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of an array<int> column of ids."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in batches:
            yield pd.Series([own.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch], dtype=object)

    return decode(ids)


def round_trip_column(text: Column, path: str, pattern: str, with_ids: bool = False) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> (and ids): encodes, decodes the ids, and digests both where they are."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in _parts(batches):
            ids = own.encode(texts)
            out = {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
            }
            if with_ids:
                out["ids"] = [np.frombuffer(x, "<i4") for x in ids]
            yield pd.DataFrame(out)
        own.forget()  # the worker may serve other stages next

    return digest(text)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document."""
    return docs.select("doc_id", encode_column(F.col("text"), path, pattern).alias("own")).select("doc_id", "own.ids", "own.n_tokens")
