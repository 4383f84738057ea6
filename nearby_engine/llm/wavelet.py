"""Token ids in wavelet matrices, one compressed blob per shard of consecutive documents.

A blob holds the ids as bit planes: plane 0 has the highest bit of every id in order, then the ids are stably parted into
those with bit 0 and those with bit 1, plane 1 has the next bit of that order, and so on. Ranks before every 512 bits
are stored with each plane, so that access, rank, select and counting take one step per plane.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from nearby_engine.llm.ordering import RangeBuckets, range_buckets
from nearby_engine.llm.workers import kept
from nearby_engine.session import fresh_folder

MAGIC = b"WMX1"
BLOCK = 512
END_ID = 0
#: Special strings and runs of white space around a space are left to the tokenizer as whole texts. Such a run holds two
#: spaces or another white space before a space, which is found faster.
_WHOLE = re.compile(r"\s \s|\s \Z")
_MAYBE = re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
SPECIAL = "<|endoftext|>"
_MOST_REMEMBERED = 800_000


# --- wavelet matrix ------------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Bit planes of non-negative integers below 2**levels."""

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.zeros, self.planes, self.ranks = size, zeros, planes, ranks
        self.levels = len(planes)

    @classmethod
    def of(cls, values: np.ndarray, levels: int = 16) -> "WaveletMatrix":
        zeros, planes, ranks = [], [], []
        rest = values
        for level in range(levels):
            bit = (rest >> (levels - 1 - level)) & 1
            ones = bit.astype(bool)
            packed = np.packbits(ones)
            planes.append(packed)
            ranks.append(cls._ranks(packed))
            zeros.append(int(len(rest) - np.count_nonzero(ones)))
            rest = np.concatenate([rest[~ones], rest[ones]])
        return cls(len(values), zeros, planes, ranks)

    @staticmethod
    def _ranks(packed: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK bits."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
        padded[: len(packed)] = packed
        counts = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        block = at // BLOCK
        low, high = block * BLOCK // 8, at // 8
        total = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][low:high]).sum())
        if at % 8:
            total += int(self.planes[level][high] >> (8 - at % 8)).bit_count()
        return total

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8] >> (7 - at % 8)) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if value >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, before: int) -> int:
        """How often ``value`` occurs before a position."""
        if value >> self.levels:
            return 0
        low, high = self._range(value, 0, before)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence (from 0); -1 if there are fewer. Binary search on ranks."""
        if nth >= self.count(value):
            return -1
        low, high = 0, self.size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.rank(value, middle) <= nth else (low, middle)
        return low

    def values(self) -> np.ndarray:
        """All values in order, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        rest = np.zeros(self.size, kind)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.planes[level], count=self.size).astype(bool)
            back = np.empty(self.size, kind)
            back[~ones] = rest[: self.zeros[level]]
            back[ones] = rest[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            rest = back
        return rest


def pack(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    """One blob: header, documents and their lengths, planes with ranks; compressed part by part."""
    matrix = WaveletMatrix.of(values)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    parts = [ids.tobytes(), known.tobytes(), lengths.astype("<i8").tobytes(), np.array(matrix.zeros, "<i8").tobytes()]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        parts += [plane.tobytes(), ranks.astype("<u4").tobytes()]
    packed = [squeeze(p) for p in parts]
    head = MAGIC + struct.pack("<IIQI", len(doc_ids), matrix.levels, len(values), len(packed)) + struct.pack(f"<{len(packed)}Q", *map(len, packed))
    return head + b"".join(packed)


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if blob[:4] != MAGIC:
        raise ValueError("not a token blob")
    docs, levels, size, count = struct.unpack_from("<IIQI", blob, 4)
    at = 4 + struct.calcsize("<IIQI")
    sizes = struct.unpack_from(f"<{count}Q", blob, at)
    at += 8 * count
    parts, open_ = [], zstandard.ZstdDecompressor().decompress
    for n in sizes:
        parts.append(open_(blob[at : at + n]))
        at += n
    ids, known = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.uint8)
    names = [int(i) if k else None for i, k in zip(ids, known)]
    assert len(names) == docs
    planes = [np.frombuffer(p, np.uint8) for p in parts[4::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[5::2]]
    return names, np.frombuffer(parts[2], "<i8"), WaveletMatrix(size, [int(z) for z in np.frombuffer(parts[3], "<i8")], planes, ranks)


# --- encoding ------------------------------------------------------------------------------------------------------------


class ChunkEncoder:
    """Whole texts to ids (two bytes each), remembering what each space-led chunk of a text becomes.

    A space between two characters that are not both next to white space always starts a new piece of the tokenizer's
    pattern, so a text may be cut there; texts where that does not hold go to the tokenizer whole.
    """

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.remembered: dict[str, bytes] = {}
        # Ids whose piece starts with a space; the byte-level alphabet writes a space as U+0120.
        self.led_by_space = np.zeros(1 << 16, bool)
        self.led_by_space[[i for piece, i in self.tokenizer.get_vocab().items() if piece.startswith("\u0120")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks (without their leading space) as one text; in it, each id that starts with a space starts a chunk."""
        plain = [c for c in chunks if c and not c[0].isspace()]
        ids = np.array(self.tokenizer.encode("".join([" " + c for c in plain]), add_special_tokens=False).ids, "<u2")
        starts = np.flatnonzero(self.led_by_space[ids])
        if len(starts) == len(plain):
            data, edges = ids.tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
            self.remembered.update(zip(plain, (data[a:b] for a, b in zip(edges, edges[1:]))))
        rest = [c for c in chunks if c not in self.remembered]
        self.remembered.update(zip(rest, self._encode([" " + c for c in rest])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if len(self.remembered) > _MOST_REMEMBERED:
            self.remembered.clear()
        firsts, chunks = [], []
        for text in texts:
            if SPECIAL in text or ("  " in text or _MAYBE.search(text)) and _WHOLE.search(text):
                first, rest = text, []
            else:
                first, *rest = text.split(" ")
            firsts.append(first)
            chunks.append(rest)
        needed = set().union(*chunks).difference(self.remembered)
        if needed:
            self._learn(list(needed))
        known = self.remembered.__getitem__
        return [a + b"".join(map(known, c)) for a, c in zip(self._encode(firsts), chunks)]


# --- Spark ---------------------------------------------------------------------------------------------------------------


def encode_documents(docs: DataFrame, tokenizer_json: bytes, texts_at_once: int = 512) -> DataFrame:
    """doc_id, ids: the whole text's ids and the end id, two bytes each."""
    name = "encoder_" + hashlib.sha256(tokenizer_json).hexdigest()
    end = struct.pack("<H", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(name, lambda: ChunkEncoder(tokenizer_json))
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def build_shards(encoded: DataFrame, ranges: RangeBuckets, most_tokens: int = 1 << 22) -> DataFrame:
    """bucket, part, n_tokens, blob: shards of consecutive documents, ascending by doc_id (null first).

    A shard is a range of ids; one with more than ``most_tokens`` tokens is written as several parts, so that a task
    holds one part at a time.
    """
    placed = encoded.withColumn("bucket", ranges.of(F.col("doc_id"))).repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part, names, texts, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) // 2 for t in texts], np.int64)
            blob = pack(names, lengths, np.frombuffer(b"".join(texts), "<u2"))
            values = ([bucket], [part], [int(lengths.sum())], [blob])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["bucket", "part", "n_tokens", "blob"])

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for name, ids, where in zip(*[c.to_pylist() for c in batch.columns]):
                if names and (where != bucket or size + len(ids) // 2 > most_tokens):
                    yield flush()
                    part = part + 1 if where == bucket else 0
                    names, texts, size = [], [], 0
                bucket = where
                names.append(name)
                texts.append(ids)
                size += len(ids) // 2
        if names:
            yield flush()

    return placed.mapInArrow(run, "bucket long, part long, n_tokens long, blob binary")


def write_shards(docs: DataFrame, tokenizer_json: bytes, path: str, rows_per_shard: int = 500) -> None:
    """Encode and write; Spark's writer commits whole files, so a lost executor costs its tasks only."""
    ranges = range_buckets(docs, "doc_id", rows_per_shard)
    build_shards(encode_documents(docs, tokenizer_json), ranges).write.option("compression", "none").parquet(path)


def read_documents(blobs: DataFrame) -> DataFrame:
    """bucket, part, place, doc_id, offset, n_tokens, ids_crc32 of every document, decoded from the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "part", "place", "doc_id", "offset", "n_tokens", "ids_crc32"]
        for batch in batches:
            for bucket, part, blob in zip(*[c.to_pylist() for c in batch.columns]):
                doc_ids, lengths, matrix = unpack(blob)
                data = matrix.values().astype("<u4")
                starts = np.concatenate([[0], np.cumsum(lengths)])
                sums = [zlib.crc32(data[a:b].data) for a, b in zip(starts[:-1], starts[1:])]
                n = len(doc_ids)
                columns = ([bucket] * n, [part] * n, list(range(n)), doc_ids, starts[:-1], lengths, sums)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return blobs.select("bucket", "part", "blob").mapInArrow(
        run, "bucket long, part long, place long, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )


def token_counts(blobs: DataFrame, token: int) -> DataFrame:
    """bucket, part, occurrences, first: how often an id occurs in each shard and where first, by rank and select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, blob in zip(*[c.to_pylist() for c in batch.columns]):
                matrix = unpack(blob)[2]
                row = ([bucket], [part], [matrix.count(token)], [matrix.select(token, 0)])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], names=["bucket", "part", "occurrences", "first"])

    return blobs.select("bucket", "part", "blob").mapInArrow(run, "bucket long, part long, occurrences long, first long")


def write_and_read(docs: DataFrame, tokenizer_json: bytes, rows_per_shard: int = 500) -> DataFrame:
    """One row per document, read back from the written shards: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id only; null doc_ids come first; rows with one doc_id lie side by side, in the
    order of their ids. Extra columns are left out; an empty table gives no rows. Where a shard starts is a running sum
    over shards (one short row each).
    """
    spark = docs.sparkSession
    path = fresh_folder(spark, "wavelet")
    write_shards(docs, tokenizer_json, path, rows_per_shard)
    blobs = spark.read.parquet(path)
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blobs.select("bucket", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return (
        read_documents(blobs).join(starts, ["bucket", "part"])
        .select("doc_id", (F.col("base") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
