"""Token ids in length-delimited binary records, with an index beside each file.

A record file is a run of frames, each::

    length of the payload, unsigned 64 bits     masked CRC-32 of those 8 bytes
    payload                                     masked CRC-32 of the payload

All numbers are little-endian; a CRC c is masked as rotate(c, 17) + 0xA282EAD8.
A payload has a flag byte (1: doc_id present, 2: 32-bit ids, else 16-bit), the
doc_id as a signed 64-bit number and the ids. The index of a file (``.idx``)
has two unsigned 64-bit numbers a record: the frame's place in the file and the
ids of the file's records before it; any record can be read with one seek.

Files are written under names of their own by each task attempt and count only
when the manifest, a Spark-committed table, names them; what a lost executor
left half-written is never read.

Defined results: null texts count as empty (one end id); a null doc_id sorts
first and stays null; rows that repeat a doc_id are records each, in the order
of the texts' first 32 characters, then of a hash; an empty table gives an empty
manifest and no rows.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.text import slices
from boxloom.llm.tokens import encoder
from boxloom.runtime import new_path, write_table

MASK = 0xA282EAD8
HAS_ID, WIDE = 1, 2
BLOCK = 4 << 20
#: Bytes of text a file is made of, about.
FILE_BYTES = 128 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    head = struct.pack("<Bq", (doc_id is not None) * HAS_ID + wide * WIDE, doc_id or 0)
    payload = head + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record of a binary stream, None at its end; ValueError if a checksum or length is wrong."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("broken record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("broken record payload")
    flags, doc_id = struct.unpack("<Bq", body[:9])
    ids = np.frombuffer(body, "<u4" if flags & WIDE else "<u2", offset=9, count=(size - 9) // (4 if flags & WIDE else 2))
    return (doc_id if flags & HAS_ID else None), ids.astype(np.uint32)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, path: str, end_id: int):
    fields = [("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        name, out, index, at, before, n = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec", None, None, 0, 0, 0
        system, place = _open(name)
        done = False
        try:
            for batch in slices(batches):
                if out is None:
                    out, index = system.open_output_stream(place), system.open_output_stream(f"{place}.idx")
                ids, cuts = enc.encode_ended(batch.column(1), end_id)
                frames = [frame(d, ids[a:b]) for d, a, b in zip(batch.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True)]
                sizes = np.array([len(x) for x in frames], np.int64)
                entry = np.stack([at + np.cumsum(sizes) - sizes, before + cuts[:-1]], axis=1).astype("<u8")
                out.write(b"".join(frames))
                index.write(entry.tobytes())
                at, before, n = at + int(sizes.sum()), before + len(ids), n + len(frames)
            done = True
        finally:
            for stream in (out, index):
                if stream is not None:
                    stream.close()
            if not done and out is not None:
                system.delete_file(place)
                system.delete_file(f"{place}.idx")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((part, name, n, before), fields, strict=True)], names=[f for f, _ in fields])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest (part, file, records, ids) of the files, in that order by part."""
    spark = docs.sparkSession
    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts
    if n is None:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    # rows that share a doc_id, or have none, may be many: they are dealt by their texts as well
    place = ["doc_id", F.substring("text", 1, 32), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *place).sortWithinPartitions(*place, "text")
    return write_table(ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part int, file string, records long, ids long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        doc, start, n, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, place = _open(name)
            rows = []
            with system.open_input_stream(place, buffer_size=BLOCK) as stream:
                while (got := unframe(stream)) is not None:
                    doc_id, ids = got
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    base += len(ids)
                    if len(rows) == 8192:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids_crc32 of every record, read from the files.

    The manifest has a row a file; only that much comes to the driver.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r["file"], base))
        base += r["ids"]
    jobs = spark.createDataFrame(files, "file string, base long")
    return jobs.repartition(max(1, len(files))).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled(files: Iterable[str], seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of ``files`` in an order drawn from ``seed``; only the indexes are held, each record is one seek."""
    where = []
    names = list(files)
    for k, name in enumerate(names):
        system, place = _open(f"{name}.idx")
        with system.open_input_stream(place) as stream:
            where += [(k, int(at)) for at in np.frombuffer(stream.read(), "<u8").reshape(-1, 2)[:, 0]]
    random.Random(seed).shuffle(where)
    opened = {}
    for k, at in where:
        if k not in opened:
            system, place = _open(names[k])
            opened[k] = system.open_input_file(place)
        opened[k].seek(at)
        yield unframe(opened[k])


def records_folder(spark: SparkSession) -> str:
    return new_path(spark, "records")
