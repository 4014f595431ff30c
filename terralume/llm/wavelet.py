"""Token ids in binary shards, each one compressed wavelet matrix.

A shard holds the ids of consecutive documents as bit-planes from the highest bit down; after each
plane the zeros go stably before the ones. With counts of ones per block a plane answers rank and
select, so one file gives the token at a place, the number of times a token occurs in a range
and the places where it occurs, without decoding the rest.

File: 8 bytes magic, length of the header (little-endian 32-bit), header (JSON: tokens, documents,
bits, zeros and compressed size per plane, sizes of the two columns), then Zstandard blocks: keys as an
Arrow stream, so that they may be of any type, tokens per document (unsigned 32-bit), and the planes with their counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralume.session import materialize, shared_folder

from .common import dealt, get_file, put_file
from .tokens import batches, encoder

MAGIC = b"WVMATRX2"
SHARD_TOKENS = 1 << 20  # a shard is closed at this many ids; a longer document has its own
BLOCK_BITS = 512
RUN = 1 << 16  # values that are parted at a time
BATCH_CHARS = 4_000_000  # characters encoded at a time: larger batches repeat more pieces


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of non-negative integers."""

    def __init__(self, size: int, zeros: list[int], planes: list, counts: list):
        self.size, self.zeros, self.planes, self.counts = size, zeros, planes, counts
        self.bits = len(planes)

    @classmethod
    def build(cls, values, bits: int) -> WaveletMatrix:
        import numpy as np

        if len(values) and int(values.max()) >> bits:
            raise ValueError(f"token {int(values.max())} does not fit in {bits} bits")
        zeros, planes, counts = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (values & values.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(values) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            padded[: len(packed)] = packed
            each = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK_BITS // 64).sum(1, dtype=np.uint32)
            planes.append(padded)
            counts.append(np.concatenate([[0], np.cumsum(each)]).astype("<u4"))
            zeros.append(len(values) - int(np.count_nonzero(ones)))
            moved, low, high = np.empty_like(values), 0, zeros[-1]
            for at in range(0, len(values), RUN):
                part, set_ = values[at : at + RUN], ones[at : at + RUN]
                # Places first: taking by a random mask costs several times as much.
                for bit in (False, True):
                    found = part.take(np.flatnonzero(set_ == bit))
                    if bit:
                        moved[high : high + len(found)] = found
                        high += len(found)
                    else:
                        moved[low : low + len(found)] = found
                        low += len(found)
            values = moved
        return cls(sum(zeros[:1]) + int(counts[0][-1]) if bits else 0, zeros, planes, counts)

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        import numpy as np

        block, rest = divmod(at, BLOCK_BITS)
        found = int(self.counts[level][block])
        if rest:
            part = self.planes[level][block * BLOCK_BITS // 8 : -(-at // 8)]
            found += int(np.unpackbits(part, bitorder="little")[:rest].sum())
        return found

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) zero or one of a plane."""
        import numpy as np

        ahead = self.counts[level].astype(np.int64)
        if not bit:
            ahead = np.arange(len(ahead)) * BLOCK_BITS - ahead
        block = int(np.searchsorted(ahead, nth, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(part == bit)[nth - int(ahead[block])])

    def access(self, at: int) -> int:
        """The token at a place."""
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs from ``low`` to before ``high``."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, low, self.size if high is None else high)
        return b - a

    def occurrence(self, token: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of a token, -1 if there are fewer."""
        if token < 0 or token >> self.bits:
            return -1
        low, high = self._range(token, 0, self.size)
        if nth < 0 or low + nth >= high:
            return -1
        at = low + nth
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def values(self):
        """All tokens: the partitions are undone from the lowest plane up."""
        import numpy as np

        out = np.zeros(self.size, "<u4" if self.bits > 16 else "<u2")
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], bitorder="little", count=self.size).view(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            back[np.flatnonzero(ones)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = back
        return out


def shard_bytes(keys, lengths: list[int], ids: bytes, bits: int) -> bytes:
    """One shard file; ``keys`` is an Arrow array or a list."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    values = np.frombuffer(ids, "<u4")
    if len(values) and int(values.max()) >> bits:
        raise ValueError(f"token {int(values.max())} does not fit in {bits} bits")
    matrix = WaveletMatrix.build(values.astype("<u2") if bits <= 16 else values, bits)
    table = pa.table({"key": keys})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    parts = [pack(sink.getvalue()), pack(np.array(lengths, "<u4").tobytes())]
    parts += [pack(c.tobytes() + p.tobytes()) for p, c in zip(matrix.planes, matrix.counts, strict=True)]
    head = {"tokens": len(values), "documents": len(keys), "bits": bits, "zeros": matrix.zeros, "sizes": [len(p) for p in parts]}
    written = json.dumps(head).encode()
    return b"".join([MAGIC, len(written).to_bytes(4, "little"), written, *parts])


def open_shard(data: bytes):
    """Keys (an Arrow array), tokens per document and the matrix of a shard file."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    at = 12 + int.from_bytes(data[8:12], "little")
    head = json.loads(data[12:at])
    unpack, parts = zstandard.ZstdDecompressor().decompress, []
    for size in head["sizes"]:
        parts.append(unpack(data[at : at + size]))
        at += size
    blocks = -(-head["tokens"] // BLOCK_BITS) + 1
    planes = [np.frombuffer(p, np.uint8, offset=4 * blocks) for p in parts[2:]]
    counts = [np.frombuffer(p, "<u4", count=blocks) for p in parts[2:]]
    keys = pa.ipc.open_stream(parts[0]).read_all().column("key").combine_chunks()
    return keys, np.frombuffer(parts[1], "<u4"), WaveletMatrix(head["tokens"], head["zeros"], planes, counts)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None, end_id: int = 0, bits: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending order of ``key`` and list the files.

    Returns ``folder``, ``file``, ``part``, ``number``, ``tokens``, ``documents``, in order of ``part`` and ``number``. ``end_id``
    follows every document; a null or empty text is ``end_id`` alone. Null keys come first, rows with
    equal keys lie side by side. Keys may be of any type that can be ordered. ``bits`` are those of the largest id of the vocabulary
    unless given; an id that needs more is an error. A repeated task writes the same files again.
    """
    import uuid

    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie)

    def work(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part, number, kind = task.partitionId(), 0, None
        size = bits or max(end_id, encoder(path).tokenizer.get_vocab_size() - 1).bit_length()
        keys: list = []
        found: list[bytes] = []
        held = 0

        def close():
            nonlocal held, number
            data = shard_bytes(pa.array(keys, kind), [len(x) // 4 for x in found], b"".join(found), size)
            name = put_file(folder, f"{part:06d}-{number:06d}.wm", iter([data]), f"{task.taskAttemptId()}")
            row = dict(folder=folder, file=name, part=part, number=number, tokens=held, documents=len(keys))
            keys.clear()
            found.clear()
            held, number = 0, number + 1
            return row

        for frame in frames:
            kind = frame.schema.field(0).type
            names, texts, done = frame.column(0).to_pylist(), frame.column(1).to_pylist(), []
            for low, high in batches(texts, BATCH_CHARS):
                for name, ids in zip(names[low:high], encoder(path).batch(texts[low:high]), strict=True):
                    keys.append(name)
                    found.append(ids + end_id.to_bytes(4, "little"))
                    held += len(ids) // 4 + 1
                    if held >= SHARD_TOKENS:
                        done.append(close())
            yield pa.RecordBatch.from_pylist(done, schema=LISTED)
        if keys:
            yield pa.RecordBatch.from_pylist([close()], schema=LISTED)

    import pyarrow as pa

    LISTED = pa.schema([
        ("folder", pa.string()), ("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64()),
    ])
    return materialize(ranged.mapInArrow(work, "folder string, file string, part int, number int, tokens long, documents long"), "shards")


def read_shards(shards: DataFrame, kind: str = "long") -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` of every document, from the files.

    ``kind`` is the type of the keys.
    """
    of_part = shards.groupBy("part").agg(F.sum("tokens").alias("_all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    parts = of_part.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.join(parts, "part").select(
        "folder", "file", (F.col("_base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base")
    )

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                keys, lengths, matrix = open_shard(get_file(row["folder"], row["file"]))
                values = matrix.values().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = [values[e - n : e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                columns = [
                    keys,
                    pa.array(row["base"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids"])

    return dealt(placed, "file").mapInArrow(work, f"key {kind}, start long, n_tokens long, ids binary")
