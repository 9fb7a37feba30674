"""Token files: ids packed in the fewest bits that the vocabulary needs, with block offsets for random access.

A shard file, all numbers little-endian::

    header   magic "BTOK0001", bits u32, ids in a block u32
    blocks   each block's ids, ``bits`` bits an id, lowest bit first; every block but the last has as many ids
    tables   offsets of the blocks u64[n + 1]; doc ids i64[d]; null flags of the doc ids u8[d]; starts u64[d + 1]
    footer   place of the tables u64, n u64, d u64, ids in the file u64, magic

Any id is found by block = place // ids in a block; numpy unpacks a block as a whole. Documents lie in ascending order
of their ids over all shards (null first, equal ids in the order of their texts). Tasks write files under names of their
own and report them in a manifest table; only files of the manifest count, so an attempt that was lost leaves nothing
behind that is read.

Defined results: a null or empty text is its end token alone; rows that repeat an id are documents of their own, and any
number of them may share one (a range of the order may end among them); texts are encoded whole, however long; columns beside
doc_id and text are left out, whatever their names; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, shared_dir, small_batches, stored
from .encode import closed, crc, encoder

MAGIC = b"BTOK0001"
BLOCK_IDS = 1 << 16
#: Ids and documents of a file, after which a shard goes on in another one.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one shard in one pass; holds a block of ids and the document table."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.sink.write(MAGIC + struct.pack("<II", bits, block_ids))
        self.place = len(MAGIC) + 8
        self.offsets, self.docs, self.nulls, self.starts = [self.place], [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._flush(self.waiting // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending)
        for k in range(0, n, self.block_ids):
            data = pack_bits(ids[k : min(k + self.block_ids, n)], self.bits)
            self.sink.write(data)
            self.place += len(data)
            self.offsets.append(self.place)
        self.pending, self.waiting = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.sink.write(np.asarray(values, kind).tobytes())
        self.sink.write(struct.pack("<QQQQ", self.place, len(self.offsets) - 1, len(self.docs), self.n_ids) + MAGIC)


class Reader:
    """Random access to a shard through a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        head = source.read(len(MAGIC) + 8)
        source.seek(-40, 2)
        foot = source.read(40)
        if head[:8] != MAGIC or foot[-8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        place, n, d, self.n_ids = struct.unpack("<QQQQ", foot[:32])
        source.seek(place)
        self.offsets = np.frombuffer(source.read(8 * (n + 1)), "<u8").astype(np.int64)
        docs, nulls = np.frombuffer(source.read(8 * d), "<i8"), np.frombuffer(source.read(d), "u1")
        self.docs = [None if z else int(x) for x, z in zip(docs, nulls, strict=True)]
        self.starts = np.frombuffer(source.read(8 * (d + 1)), "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        return unpack_bits(self.source.read(int(self.offsets[k + 1] - self.offsets[k])), self.bits, min(self.block_ids, self.n_ids - k * self.block_ids))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at places start .. end - 1 of the shard, read from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order, each block being read once."""
        rest, at, k = np.zeros(0, "<u4"), 0, 0
        for doc, (start, end) in zip(self.docs, zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True), strict=True):
            if at + len(rest) < end:
                more = [rest[start - at :]]
                at, have = start, len(rest) - (start - at)
                while at + have < end:
                    more.append(self.block(k))
                    have, k = have + len(more[-1]), k + 1
                rest = np.concatenate(more)
            yield doc, start, rest[start - at : end - at]


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", shards: int | None = None, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes doc_id, text as shards below ``path``; gives the manifest: shard, part, file, n_docs, n_ids, base (ids before it).

    A task begins a new file (the shard's next part) after ``file_ids`` ids or ``file_docs`` documents, so what it and a reader
    hold of a file's tables doesn't grow with the shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        enc, shard, part = encoder(tokenizer), TaskContext.get().partitionId(), 0
        writer = sink = file = None

        def ended():
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "file": file, "n_docs": len(writer.docs), "n_ids": writer.n_ids}], schema=schema)

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if writer is not None and (writer.n_ids >= file_ids or len(writer.docs) >= file_docs):
                    yield ended()
                    writer, part = None, part + 1
                if writer is None:
                    file = f"{path}/shard-{shard:08d}-{part:06d}-{uuid.uuid4().hex}.btok"
                    fs, place = file_system(file)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(place)
                    writer = Writer(sink, bits_for(enc.vocabulary), block_ids)
                writer.add(doc, np.frombuffer(closed(data), "<u4"))
        if writer is not None:
            yield ended()

    # Rows of one id (or none) go on in the order of a hash of their text, so that a range may end among them.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    manifest = stored(ordered.mapInArrow(save, "shard int, part int, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (packed 32-bit) of every document, from the files."""

    def load(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = file_system(row["file"])
                with fs.open_input_file(place) as source:
                    rows = []
                    for doc, start, ids in Reader(source).documents():
                        rows.append((doc, row["base"] + start, len(ids), crc(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    spark = manifest.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "base").repartition(tasks).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes all documents to shared storage and gives what the files say about each."""
    return read(write(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer))
