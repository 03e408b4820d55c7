"""What the training-data operators share: session settings, shared storage, word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a batch of very long texts must fit in a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
#: Rows of a few numbers (48 bytes, say) that a join may broadcast: some 50 MB.
BROADCAST_ROWS = 1 << 20
#: Tasks over which a join deals each key that may be hot.
SALTS = 16


def prepare(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ours where they are above. They stay so: results are lazy."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = re.match(r"(\d+)b?$", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not (now and 0 < int(now[1]) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has none that all its machines see, so there it
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="ferrule-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in the shared folder. A written table cuts lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it back. Nothing reads the shuffle files of the write again: they go with it."""
        where = self.path(name)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(where)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._ferrule_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for df in tables:
            self._fs(df._ferrule_path, lambda fs, p: fs.delete(p, True))

    def at_exit(self) -> None:
        """What the lazy result still reads goes when the session ends."""
        self._fs(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _fs(self, where, act):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        act(path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path)


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a table of a few numbers a row, to be broadcast in a join if it has at most ``rows`` rows; else it is joined by shuffle."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with table, a table of few numbers a key: by broadcast if it is small, else with each key dealt over ``salts`` tasks."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int")).join(table, [*on, "_salt"], how).drop("_salt")


def _release() -> None:
    """Give back what a worker's allocators hold of finished work: the worker stays for the next task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function of Arrow batches that gives memory back at the end of a task."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return work


def row_of(docs: DataFrame) -> DataFrame:
    """All columns of each row as one, ``row``; their names can't clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(batch: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.Array:
    """A column of the rows that ``row_of`` has packed."""
    return batch.column("row").field(name).cast(kind)


# ---------------------------------------------------------------- sums of arrays


def blobs(total: np.ndarray, slice_size: int) -> Iterator[pa.RecordBatch]:
    """An array of counts as rows (slice, counts), those of nothing but zeros left out."""
    parts = [(k, total[i : i + slice_size]) for k, i in enumerate(range(0, len(total), slice_size))]
    parts = [(k, zlib.compress(x.astype(np.int64).tobytes(), 1)) for k, x in parts if x.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["slice", "counts"])


def _sum_slice(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(blob), np.int64)
            total[k] = total[k] + x if k in total else x
    for k, x in total.items():
        blob = zlib.compress(x.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["slice", "counts"])


def summed(slices: DataFrame, size: int, slice_size: int) -> np.ndarray:
    """The sum of the arrays that ``blobs`` made, slice by slice on the executors. ``size`` numbers come to the driver."""
    total = np.zeros(size, np.int64)
    n = -(-size // slice_size)
    for r in slices.repartition(max(1, n), "slice").mapInArrow(tidy(_sum_slice), "slice int, counts binary").collect():
        x = np.frombuffer(zlib.decompress(r.counts), np.int64)
        total[r.slice * slice_size : r.slice * slice_size + len(x)] += x
    return total


# ---------------------------------------------------------------- words

_U = np.uint64


def _table(separators: np.ndarray) -> np.ndarray:
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    t[separators] = 0
    return t


_byte = np.arange(256)
#: Byte tables: 0 parts words; else the byte, A-Z lower-cased, plus 1.
SPACED = _table((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
ALNUM = _table((_byte <= 0x2F) | ((_byte >= 0x3A) & (_byte <= 0x40)) | ((_byte >= 0x5B) & (_byte <= 0x60)) | ((_byte >= 0x7B) & (_byte <= 0x7F)))

_BASE = 0x9E3779B97F4A7C55
_pow: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            out = np.full(size, b, _U)
            out[0] = 1
            _pow[k] = np.multiply.accumulate(out)
        if n > 1 << 21:  # a giant text: its tables do not stay
            big = list(_pow)
            _pow[:] = [x[: 1 << 21].copy() for x in big]
            return big
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def hash_words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """64-bit hashes of all words of texts laid end to end; first word of each text; byte span of each word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(len(offs), np.int64), z, z
    c = table[buf]
    inw = c != 0
    first, last = inw.copy(), inw.copy()
    first[1:] &= ~inw[:-1]
    last[:-1] &= ~inw[1:]
    edge = offs[:-1][np.diff(offs) > 0]
    first[edge] = inw[edge]
    edge = offs[1:][np.diff(offs) > 0] - 1
    last[edge] = inw[edge]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(c.astype(_U) * p[:n], out=total[1:])
    h = mix((total[e] - total[s]) * q[s] + (e - s).astype(_U))
    return h, np.searchsorted(s, offs), s, e


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes: from row, to row, their bytes, offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; position i covers words i to i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out + _U(k))


# ---------------------------------------------------------------- components


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node that has an edge (columns a, b).

    Large-star and small-star in turn, each a grouped minimum and a join; every round is written to the
    shared folder. Rounds grow with the logarithm of the longest path. No edge list leaves the executors.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
        out = both.join(low, F.col("u") == F.col("k"))
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m"))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, "edges")
    before = mark(e)
    while True:
        new = scratch.keep(star(star(e, True), False), "star")
        scratch.drop(e)
        e, now = new, mark(new)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())
