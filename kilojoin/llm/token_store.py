"""Token files: one wavelet matrix per shard, with access, counting and lookup straight from the compressed file.

File format (all little-endian): ``KJWM``, u32 header length, JSON header, blocks. The header names the number
of tokens, the bit levels, the zeros of each level, the place of every compressed block, the ones before it, and the place of
the documents (ids, null flags and lengths). Level k holds bit (levels - 1 - k) of every token, in the order left by a
stable partition of the level above (zeros first); its bits are packed eight to a byte and cut into blocks that are
compressed each on its own, so one query opens one or two blocks of each level. An open block keeps its bits packed, with a
directory of the ones before each 64-bit word: rank adds the block's count, the word's and one popcount, select searches the
directory and one word. Both take arrays of positions.

Documents follow each other in ascending order of doc_id (equal ids in the order of their texts' hashes), each with the end id
appended. A shard is one row (one file) of a Parquet table in the shared folder: Spark's committer writes it, so that a lost
executor leaves no half-written shard, and the payload is the file above.

Defined results: a null text is the empty text, which has only the end id; rows of a null doc_id come first; rows of equal doc_id
follow each other and all are kept, dealt out by their texts; columns other than doc_id and text are not read, whatever their names;
an empty table gives no shards.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilojoin.llm.common import shared_dir

#: Tokens after which a task closes a shard (at the end of a document).
SHARD_TOKENS = 1_000_000
#: Bits in a block that is compressed on its own.
BLOCK_BITS = 1 << 19
#: Words, and pieces of words, whose ids a worker remembers.
REMEMBERED = 700_000
MAGIC = b"KJWM"

SHARD_SCHEMA = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class WaveletMatrix:
    """A sequence of ids as bit levels with rank and select."""

    def __init__(self, header: dict, blob: bytes):
        self.n, self.levels, self.zeros = header["n"], header["levels"], header["zeros"]
        self.places, self.blob, self.docs = header["places"], blob, header["docs"]
        self.ones = [np.array(x, np.int64) for x in header["ones"]]
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def write(ids: np.ndarray, doc_ids: list[int | None] | None = None, doc_tokens: list[int] | None = None) -> bytes:
        """The file of a sequence of ids, and of the documents that it is cut into."""
        ids = np.asarray(ids, np.uint32)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        own, zeros, places, ones, blocks, at = ids.astype(np.uint16 if levels <= 16 else np.uint32), [], [], [], [], 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for level in range(levels):
            bit = ((own >> (levels - 1 - level)) & 1).astype(bool)
            before, row, counts = 0, [], []
            for i in range(0, max(1, len(bit)), BLOCK_BITS):
                block = bit[i : i + BLOCK_BITS]
                data = pack(np.packbits(block, bitorder="little").tobytes())
                row.append([at, len(data)])
                counts.append(before)
                before += int(np.count_nonzero(block))
                at += len(data)
                blocks.append(data)
            zeros.append(len(bit) - before)
            places.append(row)
            ones.append(counts)
            own = np.concatenate([own[~bit], own[bit]])
        own = doc_ids or []
        docs = np.array([d or 0 for d in own], "<i8").tobytes() + np.array([d is None for d in own], "u1").tobytes() + np.array(doc_tokens or [], "<i8").tobytes()
        blocks.append(pack(docs))
        documents = {"n": len(own), "at": at, "size": len(blocks[-1])}
        header = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "places": places, "ones": ones, "docs": documents}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(header)), header, *blocks])

    @classmethod
    def read(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", data[4:8])
        return cls(json.loads(data[8 : 8 + size]), memoryview(data)[8 + size :])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The ids of the documents, and how many tokens each has."""
        n, at = self.docs["n"], self.docs["at"]
        raw = zstandard.ZstdDecompressor().decompress(self.blob[at : at + self.docs["size"]], max_output_size=17 * n + 1)
        null = np.frombuffer(raw, "u1", n, 8 * n)
        return [None if no else d for d, no in zip(np.frombuffer(raw, "<i8", n).tolist(), null.tolist(), strict=True)], np.frombuffer(raw, "<i8", n, 9 * n)

    def _bits(self, level: int, k: int) -> bytes:
        at, size = self.places[level][k]
        return zstandard.ZstdDecompressor().decompress(self.blob[at : at + size], max_output_size=BLOCK_BITS // 8)

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block and the ones before each of them in the block."""
        if (level, k) not in self._open:
            raw = self._bits(level, k)
            words = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
            self._open[level, k] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return self._open[level, k]

    def _ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a level."""
        out = np.empty(len(at), np.int64)
        blocks = np.minimum(at // BLOCK_BITS, len(self.places[level]) - 1)
        for k in np.unique(blocks).tolist():
            own = blocks == k
            words, before = self._block(level, k)
            inside = at[own] - k * BLOCK_BITS
            word, bit = inside >> 6, (inside & 63).astype(np.uint64)
            low = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1)) if len(words) else np.zeros(len(word), np.uint64)
            out[own] = self.ones[level][k] + before[word] + np.bitwise_count(np.where(bit > 0, low, 0).astype(np.uint64))
        return out

    def _places_of(self, level: int, bit: int, count: np.ndarray) -> np.ndarray:
        """The position of each occurrence number count (from 0) of a bit on a level."""
        out = np.empty(len(count), np.int64)
        starts = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK_BITS - self.ones[level]
        blocks = np.searchsorted(starts, count, side="right") - 1
        for k in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == k)
            words, before = self._block(level, k)
            wanted = count[own] - starts[k]
            if not bit:
                words, before = ~words, np.arange(len(before)) * 64 - before
            word = np.searchsorted(before, wanted, side="right") - 1
            for i in range(0, len(own), 1 << 16):  # the bits of so many words at a time
                w = word[i : i + (1 << 16)]
                bits = np.unpackbits(words[w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                nth = (wanted[i : i + (1 << 16)] - before[w])[:, None]
                out[own[i : i + (1 << 16)]] = k * BLOCK_BITS + w * 64 + (np.cumsum(bits, 1, dtype=np.int16) > nth).argmax(1)
        return out

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.levels):
            words, _ = self._block(level, at // BLOCK_BITS)
            inside = at % BLOCK_BITS
            bit = int(words[inside >> 6]) >> (inside & 63) & 1
            ones = int(self._ranks(level, np.array([at]))[0])
            at = self.zeros[level] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _span(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            x, y = self._ranks(level, np.array([a, b])).tolist()
            if token >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before a position (in all, if none is given)."""
        a, b = self._span(token, self.n if end is None else min(end, self.n))
        return b - a

    def select(self, token: int, ks: np.ndarray) -> np.ndarray:
        """The positions of the occurrences ks (from 0) of an id."""
        a, b = self._span(token, self.n)
        at = np.asarray(ks, np.int64)
        if len(at) and not (at.min() >= 0 and at.max() < b - a):
            raise IndexError(b - a)
        at = at + a
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._places_of(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the partitions of the levels are undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        own = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            blocks = [np.unpackbits(np.frombuffer(self._bits(level, k), np.uint8), bitorder="little") for k in range(len(self.places[level]))]
            bit = np.concatenate(blocks)[: self.n].view(bool)
            above = np.empty(self.n, kind)
            above[~bit] = own[: self.zeros[level]]
            above[bit] = own[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            own = above
        return own.astype(np.uint32)


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary (fixed values): printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """The ids of each word from a tokenizer that drops white space; a word that is new goes through the library.

    The tokenizer's normaliser and pre-tokenizer never join across ASCII white space, so a text's ids are those of its
    words in order. Most words are Latin letters and then marks: such letters are one piece, which goes lower-cased to
    the library's model, once for all its capitals and marks; the marks are another piece. All other words, and other
    white space inside them, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.piece = self.library.model.tokenize
        self.plain = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,:;!?()#*$%&|]*)").fullmatch
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return _pack(self.library.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        pieces, text = self.pieces, word.decode()
        if len(self) > REMEMBERED:
            self.clear()
        if len(pieces) > REMEMBERED:
            pieces.clear()
        m = self.plain(text)
        if m is None:
            own = self._whole(text)
        else:
            letters, marks = m.groups()
            low = letters.lower()
            own = pieces.get(low)
            if own is None:
                bytes_ = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                own = pieces[low] = _pack([t.id for t in self.piece(bytes_)])
            if marks:
                tail = pieces.get(marks)
                if tail is None:
                    tail = pieces[marks] = self._whole(marks)
                own += tail
        self[word] = own
        return own

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        own, last = self.__getitem__, end.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(own, t.encode().split())) + last, "<u4") for t in texts]


def _pack(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer: str, path: str, end: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the token files of docs (doc_id, text) as one table of shards, in ascending order of doc_id.

    The one exchange deals the documents out by ranges of doc_id and of the text's hash, so that many rows of one id don't meet in one task; each task then encodes its range in order and
    closes a shard whenever enough tokens have gathered, so its memory is bounded by a shard and a document.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard, start = word_encoder(tokenizer), 0, 0
        ids: list[np.ndarray] = []
        docs_in: list[int | None] = []
        size = part = 0

        def close() -> pd.DataFrame:
            row = [part, shard, start, size, WaveletMatrix.write(np.concatenate(ids), docs_in, [len(x) for x in ids])]
            return pd.DataFrame([row], columns=SHARD_SCHEMA.names)

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for i in range(0, len(batch), 512):
                few = batch.iloc[i : i + 512]
                keys = [None if null else int(k) for k, null in zip(few["doc_id"], few["doc_id"].isna(), strict=True)]
                for key, x in zip(keys, own.encode([t or "" for t in few["text"]], end), strict=True):
                    ids.append(x)
                    docs_in.append(key)
                    size += len(x)
                    if size >= shard_tokens:
                        yield close()
                        shard, start, ids, docs_in, size = shard + 1, start + size, [], [], 0
        if ids:
            yield close()

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
    dealt = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    dealt.mapInPandas(build, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: the ids of all shards before each.

    Parts are as many as the partitions of the exchange that wrote them (spark.sql.shuffle.partitions, which bounds the
    one task that sums their offsets in order); the offsets are one small table, and it goes to the shards by a join on the part.
    """
    from pyspark.sql import Window

    from kilojoin.llm.common import maybe_broadcast

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("part_start"))
    return shards.join(maybe_broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = WaveletMatrix.read(row.payload)
                data, (keys, many) = own.all().astype("<u4", copy=False), own.documents()
                ends = np.cumsum(many)
                first = ends - many
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(keys, dtype="Int64"),
                        "start": row.start + first,
                        "n_tokens": many,
                        "ids_crc32": [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)],
                    }
                )

    return shards.select("start", "payload").mapInPandas(open_, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """part, shard and position in the whole sequence of every occurrence of an id, by rank and select in each shard's file."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = WaveletMatrix.read(row.payload)
                at = row.start + own.select(token, np.arange(own.count(token)))
                yield pd.DataFrame({"part": row.part, "shard": row.shard, "position": at})

    return shards.select("part", "shard", "start", "payload").mapInPandas(find, "part long, shard long, position long")


def store_documents(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes docs to token files in the shared folder and returns what the files hold of each document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer, path, end)
    return documents_of(read_shards(spark, path))
