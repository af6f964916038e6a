"""Helpers that several operators share: the shared folder, text kernels over Arrow buffers, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space, as the regular expression [\x20\x09-\x0D] has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that a kernel works on at once; its arrays take about sixty times as much.
CHUNK = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    set_by = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors see")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint in the shared folder, so that lost executors cost no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Paths of tables that stored() has written, in order.
WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing will read again, by Spark's own file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: The most rows of a few numbers each that are broadcast (about 20 MB); beyond that, the other side is shuffled.
BROADCAST = 400_000
#: The most nodes of a graph whose minima are broadcast, in each of many rounds, through the driver.
FEW_NODES = 50_000
#: Documents in an Arrow batch, so that two Python workers and their executor stay small; a lower setting of the session stays.
BATCH_ROWS = 1000
#: Bytes of such a batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def joined(big: DataFrame, few: DataFrame, on: str | list[str], how: str, written: bool = False, most: int = BROADCAST) -> DataFrame:
    """A join of texts with a narrow table, which is written and counted first: broadcast up to `most` rows, else a shuffle of both sides."""
    few = few if written else cut(few)
    return big.join(F.broadcast(few) if few.count() <= most else few, on, how)


def arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow whose tasks give freed memory back to the system, as idle Python workers stay beside the executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(tidied, schema)


def small_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numpy kernels


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95 & ~7 | 3
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2**64, n + 1 of each at least."""
    if len(_POW.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["up"], _POW["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which slice_hash takes the hash of any slice."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of data[start:end], for arrays of starts and ends."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def text_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts take about most bytes together; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        after = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        after = min(n, max(first + 1, after))
        yield first, after
        first = after


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and for each text the number of the first word (one more at the end)."""
    solid = ~SPACE[data]
    n = len(data)
    start, end = solid.copy(), solid.copy()
    if n:
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edges = offsets[:-1]
        edges = edges[edges < n]
        start[edges] = solid[edges]
        edges = edges[edges > 0] - 1
        end[edges] = solid[edges]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blank_parts(data: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """A text in parts of about most bytes that end behind white space, before an ASCII character; a longer word is in one part."""
    first, n = 0, len(data)
    while first < n:
        after, at = min(n, first + most), first
        while after < n:
            blank = np.flatnonzero(SPACE[data[at:after]] & (data[at + 1 : after + 1] < 128))
            if len(blank):
                after = at + int(blank[-1]) + 1
                break
            at, after = after, min(n, after + most)
        yield first, after
        first = after


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and sizes of the words of some texts, A-Z lower-cased, and for each text the number of the first word (one more at the end).

    A text beyond two chunks goes through part by part, so that only arrays of words grow with it."""
    if len(data) <= 2 * CHUNK:
        own = lowered(data)
        start, end, first = words_of(own, offsets)
        return slice_hash(prefix_hash(own), start, end), end - start, first
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = data[a:b]
        parts = [hashed_words(text[x:y], np.array([0, y - x])) if y - x <= 2 * CHUNK else _one_word(text[x:y]) for x, y in blank_parts(text)]
        found.append([np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in ((0, U64), (1, np.int64))])
    first = np.concatenate(([0], np.cumsum([len(h) for h, _ in found])))
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found]), first


def _one_word(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a part that holds a word of more than a chunk: its hash is that of its pieces' hashes."""
    own = lowered(data)
    start, end, _ = words_of(own, np.array([0, len(own)]))
    out = np.zeros(len(start), U64)
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        each = [slice_hash(prefix_hash(own[x : min(b, x + CHUNK)]), np.array([0]), np.array([min(b, x + CHUNK) - x]))[0] for x in range(a, b, CHUNK)]
        out[k] = each[0]
        for h in each[1:]:
            out[k] = mix(out[k : k + 1] * U64(3) + h)[0]
    return out, end - start, np.array([0, len(start)])


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in an edge the smallest id it reaches, by alternating large-star and small-star rounds.

    A round joins each edge with the smallest neighbour of one end. These minima are aggregated before the shuffle and written, so that the join
    broadcasts them where they are few, and else splits a hot node's edges among tasks. No node's neighbours are ever gathered. Rounds grow
    with the logarithm of the longest path; each ends in a checkpoint. Edges with a null end and loops count as no edge.
    """
    u, v = F.col("u"), F.col("v")
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = joined(both.where(v > u), least, "u", "inner", most=FEW_NODES).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        smallest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = joined(large, smallest, "u", "inner", written=True, most=FEW_NODES)
        now = cut(small.select(v.alias("u"), F.col("m").alias("v")).where(u != v).union(smallest.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ends = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return ends.union(ends.select(F.col("component").alias("id"), "component").distinct())
