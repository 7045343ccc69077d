"""Shared plumbing: table access, folds, bounded label samples, token tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts; a word is a maximal run of anything else.
WHITE = "\t\n\x0b\x0c\r "
#: Rows per Arrow batch: long documents must not pile up in one batch.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def is_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) == rest, F.lit(False))


def work_dir(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the cluster's own or, where driver and executors are one process, one for tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="nimbus-ckpt-")
        sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    work_dir(df.sparkSession)
    release(df.sparkSession)  # what earlier steps left; this one's own shuffles are referred to until the caller has the result
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles nothing refers to any more; without, their files stay until the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes the files of rows that were ``saved`` and that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Lets a reused Python worker return the memory of a task that ended to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def merged(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) in groups of about ``chars`` characters; null texts as None."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
            if size >= chars or len(ids) >= 8192:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def usable_labels(spark: SparkSession, sf_dir: str, label: str, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id and y (0 or 1) of all rows of ``labels`` outside the held-out fold; of repeated ids the largest label counts."""
    return (
        table(spark, sf_dir, "labels")
        .select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~is_fold(F.col("doc_id"), modulus, rest))
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
    )


def sampled_labels(spark: SparkSession, sf_dir: str, label: str, rows: int, modulus: int = 4, rest: int = 2, max_chars: int = 100_000, beside: str | None = None, among: DataFrame | None = None) -> tuple:
    """Texts and labels of a bounded training sample, and the column ``beside`` if one is named.

    Rows of ``labels`` outside the held-out fold, or the rows ``among`` (doc_id, y), are taken in the order of a hash of
    their id until about ``rows`` are reached for each label value; texts over
    ``max_chars`` are not used for training (they are still scored whole). The driver
    holds at most ``2 * rows`` texts.
    """
    lab = usable_labels(spark, sf_dir, label, modulus, rest) if among is None else among.select("doc_id", "y")
    lab = lab.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("label-sample")), F.lit(1 << 30)))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (F.col("h") < int((1 << 30) * min(1.0, rows / n))))
    picked = lab.where(keep).select("doc_id", "y")  # about 2 * rows narrow rows, whatever the corpus
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    docs = docs.select("doc_id", F.struct("text", F.col(beside).alias("beside") if beside else F.lit(None).cast("string").alias("beside")).alias("row"))
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("row").alias("row")).select("doc_id", "y", "row.*").toArrow()  # a repeated id counts once
    order = np.lexsort((np.array(found["y"].to_pylist(), dtype=np.int64), np.array(found["doc_id"].to_pylist(), dtype=np.int64)))
    texts, ys = found["text"].to_pylist(), np.array(found["y"].to_pylist(), dtype=np.int64)
    if beside is None:
        return [texts[i] for i in order], ys[order]
    more = found["beside"].to_pylist()
    return [texts[i] for i in order], ys[order], [more[i] for i in order]


def planes(*columns: np.ndarray) -> bytes:
    """The columns' bytes, those of equal weight together, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), 1)


def from_planes(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(k)[:, 0])
        at += n * size
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, dtype=np.int64)


class TokenTable(dict):
    """Numbers tokens and keeps a row of numbers for each.

    ``rows`` turns a list of new tokens into a (n, width) array. The table is emptied
    when it holds ``most`` tokens, so that its memory doesn't follow the corpus; only
    the speed depends on it.
    """

    def __init__(self, rows: Callable[[list], np.ndarray], most: int = 300_000) -> None:
        self.make, self.most, self.fresh, self.matrix = rows, most, [], None

    def __missing__(self, token):
        self[token] = n = len(self)
        self.fresh.append(token)
        return n

    def lookup(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all tokens, one document after the other, and the documents' lengths."""
        if len(self) > self.most:
            self.clear()
            self.fresh, self.matrix = [], None
        get = self.__getitem__
        flat: list[int] = []
        for d in docs:
            flat.extend(map(get, d))
        if self.fresh:
            made = self.make(self.fresh)
            old = 0 if self.matrix is None else self.used
            need = old + len(made)
            if self.matrix is None or need > len(self.matrix):
                grown = np.zeros((max(need, 2 * old, 4096), made.shape[1]), dtype=made.dtype)
                if old:
                    grown[:old] = self.matrix[:old]
                self.matrix = grown
            self.matrix[old:need] = made
            self.used, self.fresh = need, []
        return np.array(flat, dtype=np.int64), np.array([len(d) for d in docs], dtype=np.int64)


def segment(op: np.ufunc, values: np.ndarray, lengths: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """``op`` over consecutive segments of rows; ``empty`` where a segment has none."""
    out = np.full((len(lengths), *values.shape[1:]), empty, dtype=values.dtype)
    some = lengths > 0
    if some.any():
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some] = op.reduceat(values, starts, axis=0)
    return out
