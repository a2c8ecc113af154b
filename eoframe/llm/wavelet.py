"""Token ids as wavelet matrices, one per shard of consecutive documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.llm.packing import in_slices
from eoframe.llm.tables import running_sums, shared_dir
from eoframe.llm.tokens import encoder

END_ID = 2
#: A shard ends with the document that brings it to this many ids.
SHARD_IDS = 1 << 20
SHARD_COLUMNS = "part int, nth int, n_ids long, doc_ids array<long>, lengths array<long>, matrix binary"
MAGIC = b"WVM1"
#: Ones are counted up to every this many bits.
STRIDE = 512


def build(ids: np.ndarray) -> bytes:
    """The wavelet matrix of an array of unsigned ids.

    Format, little-endian: magic, number of ids (u64), planes (u32), stride (u32); then per plane, from the highest bit: zeros in
    the plane (u64), counts of ones before every stride (u32 each), the bits (most significant first in a byte). A plane holds
    one bit of each id; the next plane holds the ids with a 0 before those with a 1, each in the order they had.
    """
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    out = [MAGIC, struct.pack("<QII", len(seq), planes, STRIDE)]
    for p in range(planes - 1, -1, -1):
        ones = (seq >> p & 1).astype(bool)
        packed = np.packbits(ones)
        out += [struct.pack("<Q", len(seq) - int(np.count_nonzero(ones))), _counts(packed).tobytes(), packed.tobytes()]
        seq = np.concatenate([seq[~ones], seq[ones]])
    return b"".join(out)


def _counts(packed: np.ndarray) -> np.ndarray:
    step = STRIDE // 8
    whole = np.zeros(-(-len(packed) // step) * step, dtype=np.uint8)
    whole[: len(packed)] = packed
    per_stride = np.bitwise_count(whole).reshape(-1, step).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per_stride)]).astype("<u4")


class WaveletMatrix:
    """Reads one shard's bytes without unpacking them: access, rank, select, and the whole sequence."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, planes, self.stride = struct.unpack_from("<QII", data, 4)
        at, self.planes = 20, []
        n_counts, n_bytes = -(-(-(-self.n // 8)) // (self.stride // 8)) + 1, -(-self.n // 8)
        for _ in range(planes):
            (zeros,) = struct.unpack_from("<Q", data, at)
            counts = np.frombuffer(data, "<u4", n_counts, at + 8)
            bits = np.frombuffer(data, np.uint8, n_bytes, at + 8 + 4 * n_counts)
            self.planes.append((zeros, counts, bits))
            at += 8 + 4 * n_counts + n_bytes

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        _, counts, bits = self.planes[plane]
        block = i // self.stride
        byte, first = i // 8, block * self.stride // 8
        n = int(counts[block]) + int(np.bitwise_count(bits[first:byte]).sum())
        return n + (int(bits[byte]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, (zeros, _, bits) in enumerate(self.planes):
            one = int(bits[i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(p, i)
            value, i = value << 1 | one, zeros + ones if one else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        if value >> len(self.planes):
            return 0, 0
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def rank(self, value: int, end: int | None = None) -> int:
        """How often the id occurs before position ``end`` (default: in all)."""
        start, stop = self._range(value, self.n if end is None else end)
        return stop - start

    def select(self, value: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of the id."""
        start, stop = self._range(value, self.n)
        if not 0 <= nth < stop - start:
            raise IndexError(nth)
        i = start + nth
        for p in range(len(self.planes) - 1, -1, -1):
            zeros, _, _ = self.planes[p]
            one = value >> (len(self.planes) - 1 - p) & 1
            want, low, high = (i - zeros if one else i), 0, self.n  # least prefix with want + 1 such bits
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(p, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        seq = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p, (zeros, _, bits) in zip(range(len(self.planes)), reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n).view(bool)
            above = np.empty_like(seq)
            above[~ones] = seq[:zeros]
            above[ones] = seq[zeros:] | seq.dtype.type(1 << p)
            seq = above
        return seq


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes (doc_id, text) whole, appends ``end_id`` to each and writes shards in ascending doc_id order.

    The file format is Parquet with a row per shard: part and nth (its place in the order), n_ids, doc_ids, lengths (ids of each
    document) and matrix (see ``build``). Documents are never split; a shard ends with the one that fills it.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # rows that share an id, or repeat, are told apart by text and place, so no task is given all of them
    rows = rows.repartitionByRange(parts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    fields = [("part", pa.int32()), ("nth", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
              ("lengths", pa.list_(pa.int64())), ("matrix", pa.binary())]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        n = 0

        def shard() -> pa.RecordBatch:
            lengths = [len(h) for h in held]
            matrix = build(np.concatenate(held))
            columns = [[part], [nth], [sum(lengths)], [doc_ids], [lengths], [matrix]]
            return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields)], schema=schema)

        for batch in batches:
            own_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                ids, bounds = words.encode(texts[a:b])
                for i in range(a, b):
                    held.append(np.append(ids[bounds[i - a] : bounds[i - a + 1]], end_id).astype(np.uint32))
                    doc_ids.append(own_ids[i])
                    n += len(held[-1])
                    if n >= shard_ids:
                        yield shard()
                        nth, n, held, doc_ids = nth + 1, 0, [], []
        if held:
            yield shard()

    rows.mapInArrow(encode, SHARD_COLUMNS).write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    sums = running_sums(shards.select("part", "nth", "n_ids"), ["part", "nth"], {"n_ids": "before"})
    placed = shards.join(sums.select("part", "nth", "before"), ["part", "nth"]).select("before", "doc_ids", "lengths", "matrix")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                before, doc_ids, lengths = (one.column(c).to_pylist()[0] for c in range(3))
                ids = WaveletMatrix(one.column(3)[0].as_buffer().to_pybytes()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - np.array(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [doc_ids, (starts + before).tolist(), lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids to wavelet files in the shared folder and returns what the files hold, one row per document.

    Null text counts as empty and has the end id alone; a null doc_id comes first; rows that repeat an id are documents of their
    own, in the order of their texts' hashes. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark, 'wavelet')}/shards"
    write_shards(docs, tokenizer, path)
    return read_documents(spark.read.schema(SHARD_COLUMNS).parquet(path))
