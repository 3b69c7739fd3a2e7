"""Writers: canonical rows, sorted JSON lines, and folders that appear all at once."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.errors import ArtifactError
from boxloom.functions.detections import canonical


#: Bytes of a file that is read as one value; a larger one is streamed through the driver.
_WHOLE = 1 << 30


@F.arrow_udf(T.StringType())
def _canonical_lines(rows: pa.Array) -> pa.Array:
    return pa.array([canonical(r) for r in rows.to_pylist()], pa.string())


def canonical_json(row: Column) -> Column:
    """A struct as JSON with sorted keys, no spaces and nulls kept, which to_json does not give."""
    return _canonical_lines(row)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def entries(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds, by name."""
    return sorted(str(x.getPath().toString()) for x in _fs(spark, path).listStatus(_path(spark, path)))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in a folder, by name; none if it does not exist."""
    if not exists(spark, path):
        return []
    return sorted(x.getPath().toString() for x in _fs(spark, path).listStatus(_path(spark, path)) if x.isDirectory())


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.FileUtil.copy(_fs(spark, source), _path(spark, source), _fs(spark, target), _path(spark, target), False, spark.sparkContext._jsc.hadoopConfiguration())


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file of any size, streamed."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def write_lines(rows: DataFrame, path: str, key: str = "id", parts: int | None = None) -> None:
    """Canonical JSON lines in the order of ``key``; a file a range, or one file if ``parts`` is 1."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, key).sortWithinPartitions(key) if n > 1 else rows.coalesce(1).sortWithinPartitions(key)
    ordered.select(canonical_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value")).write.text(path)


def write_document(spark: SparkSession, path: str, value: Any) -> None:
    """A small JSON document, written under another name and renamed."""
    fs, part = _fs(spark, path), f"{path}.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, part), False)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False).encode() + b"\n"))
    out.close()
    if fs.exists(_path(spark, path)) or not fs.rename(_path(spark, part), _path(spark, path)):
        fs.delete(_path(spark, part), False)
        raise ArtifactError(f"{path} exists")


def read_document(spark: SparkSession, path: str) -> Any:
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        return json.loads(rows[0][0])
    except (IndexError, ValueError):
        raise ArtifactError(f"{path} is no JSON document") from None


class publish:
    """A folder that readers see whole or not at all: write into the yielded sibling, which takes the name at the end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.part = spark, path, f"{path}.part-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        if exists(self.spark, self.path):
            raise ArtifactError(f"{self.path} exists")
        return self.part

    def __exit__(self, kind, *_) -> None:
        fs = _fs(self.spark, self.path)
        if kind is None:
            if exists(self.spark, self.path) or not fs.rename(_path(self.spark, self.part), _path(self.spark, self.path)):
                fs.delete(_path(self.spark, self.part), True)
                raise ArtifactError(f"{self.path} exists")
        elif exists(self.spark, self.part):
            fs.delete(_path(self.spark, self.part), True)


def content_hash(rows: DataFrame) -> str:
    """A digest of a table that depends neither on its order nor on its partitions, in one aggregation.

    The rows' SHA-256 digests are added up in four parts of 64 bits, modulo
    2**64 each, with the number of rows; one row comes to the driver.
    """
    line = F.sha2(canonical_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)
    part = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)]
    found = rows.select(line.alias("h")).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return hashlib.sha256(":".join([str(found["n"]), *(str(int(found[f"s{i}"]) % 2**64) for i in range(4))]).encode()).hexdigest()


def file_hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of the files in a folder, by name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    small = rows.where(F.col("length") <= _WHOLE).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("h"))
    large = rows.where(F.col("length") > _WHOLE).select("path").collect()
    return {r["name"]: r["h"] for r in small.collect()} | {"/".join(r["path"].rsplit("/", 2)[1:]): file_digest(spark, r["path"]) for r in large}
