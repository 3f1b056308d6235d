"""Shared helpers: tables in the cluster's shared folder and word hashing on Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster, whose machines share none, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


class Tables:
    """Tables of one operator in the shared folder. They go when the block ends, but for those that its result reads (`keep`)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Write df and read it back: lineage ends there, and a lost executor costs nothing."""
        path = scratch(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(df))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A table that a result reads, and that stays."""
    return Tables(df.sparkSession).cut(df, keep=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a filter of keys, 32,768 to a row of 4 KB: 2 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def may_hold(df: DataFrame, column: Column, keys: DataFrame, key: str) -> DataFrame:
    """df with a boolean column as the last, false only where `column` (a long) is in no row of keys. The filter is broadcast and of bounded size.

    With more keys than bits nearly all rows pass: what follows has more to do, and the same result.
    """
    bit, bucket, bits, said = fresh(df, "bit", "bucket", "bits", "may")
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = spread(F.col(key))
    marks = keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    rows = df.withColumn(bit, spread(column))
    rows = rows.withColumn(bucket, F.bitmap_bucket_number(F.col(bit))).withColumn(bit, F.bitmap_bit_position(F.col(bit)))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(F.col(bit), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(marks), bucket, "left").withColumn(said, found).select(*df.columns, said)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def released(batches):
    """Batches of a task. Spark's Python workers live on, so what the task has used goes back to the system at its end."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(docs: DataFrame, run, schema) -> DataFrame:
    """docs.mapInArrow(run, schema) in little memory.

    From then on the session's Arrow batches hold 1,000 rows at most, since a text is long and a batch is held as a
    whole on either side.
    """
    conf, most = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(most)) <= 1000:
        conf.set(most, "1000")
    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def as_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and the text as UTF-8 bytes, null as empty, for kernels that read Arrow buffers."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def slices(batches, most: int = CHUNK):
    """Cut record batches into slices of whole rows with about `most` bytes of text; a longer row comes alone."""
    for batch in batches:
        offsets = text_offsets(batch.column(batch.schema.get_field_index("text")))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            yield batch.slice(a, min(b, n) - a)
            a = min(b, n)


def text_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and the rows' offsets in them."""
    offsets = text_offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and how many words come before each row: word k is in row i if first[i] <= k < first[i + 1]. between: which bytes part words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~between[data]
    opens, closes = inside[1:] > inside[:-1], inside[1:] < inside[:-1]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    glued = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])  # a row ends in a word and the next begins with one
    opens[glued] = closes[glued] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words, in blocks of about CHUNK bytes."""
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), _BASE, np.uint64))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        part = data[starts[a] : ends[b - 1]]
        n = sizes[a:b]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        at = within + np.repeat(starts[a:b] - starts[a], n)
        codes = _BYTE[_LOWER[part[at]] if lower else part[at]]
        out[a:b] = np.add.reduceat(codes * powers[within], first)
        a = b
    return mix(out ^ (sizes.astype(np.uint64) * _BASE))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row; as many as there are windows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + words[k : len(words) - n + 1 + k] + _U(k + 1))
    return total
