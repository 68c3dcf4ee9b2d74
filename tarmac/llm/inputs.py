"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as _parse

from tarmac.session import shared_path

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as (doc_id, text): other columns cannot clash with results."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label, unique=True)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of the input (from file sizes; starts no job).

    Where Spark has none (rows that Python or an RDD makes), 64 MB a shuffle partition.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 26
    return size


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (null: empty)."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = a.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string (on the driver; tasks get it with their function)."""
    return to_arrow_schema(_parse(ddl))


def give_back() -> None:
    """Return freed memory to the system.

    The C library keeps what small objects leave, about 150 MB after a fit on a full sample: the
    driver's later jobs would come on top, and a Python worker stays between tasks of other steps.
    """
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run):
    """A function over a task's batches that gives its memory back when the task is through."""
    def through(batches):
        yield from run(batches)
        give_back()

    return through


def with_results(df: DataFrame, ddl: str, make) -> DataFrame:
    """``df`` with the columns of ``ddl`` that ``make(batch)`` yields for its rows, part by part.

    ``make(part)`` gives a dict of Arrow arrays or lists by name, one value a row of ``part``;
    a column of ``df`` named like a result is replaced.
    """
    results = _parse(ddl)
    kept = [f for f in df.schema.fields if f.name not in results.fieldNames()]
    whole = StructType(kept + results.fields)
    schema = to_arrow_schema(whole)
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part, found in make(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(n).cast(schema.field(n).type) for n in names]
                    + [found[n] if isinstance(found[n], pa.Array) and found[n].type == schema.field(n).type
                       else pa.array(found[n], schema.field(n).type) for n in results.fieldNames()],
                    schema=schema)

    return df.mapInArrow(giving_back(run), whole)


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20):
    """Parts of a batch whose texts hold about ``most`` bytes (one text at least)."""
    _, offsets = raw_bytes(batch.column(name))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


# --- 64-bit hashes of all words (or byte windows) of a buffer, in numpy ------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (public domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * np.uint64(step)
        filled += more
        step = step * step & MASK
    return out


class PrefixHash:
    """Polynomial hashes of substrings: ``of(starts, ends)`` after one pass over the bytes.

    ``seed`` chooses the values of bytes, and the base too unless one is shared: the powers of a
    base are kept, 16 MB for a buffer of 1 MB, 80 MB at most.
    """

    _tables: dict = {}

    def __init__(self, data: np.ndarray, seed: int, base_seed: int | None = None):
        base_seed = seed if base_seed is None else base_seed
        base = (0x9E3779B97F4A7C15 * (2 * base_seed + 1) | 1) & MASK
        values = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
        n = len(data)
        kept = self._tables.get(base_seed)
        if kept is None or len(kept[0]) <= n:
            size = max(n + 1, 1 << 16)
            kept = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
            if size <= 5 << 20:
                self._tables[base_seed] = kept
        self.inverse = kept[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * kept[0][:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(h ^ (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; a run never crosses a document's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = inside & (~before | cut[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = inside & (~after | cut[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


#: Fixed by the contracts: lower-case A-Z; a word is a run of letters, digits and non-ASCII.
WORD_TABLE = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalnum() else 32
                   for i in range(256))
