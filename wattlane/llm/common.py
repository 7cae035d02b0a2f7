"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, amount: int, per_partition: int) -> int:
    """Partition count that keeps ``amount`` (rows or bytes) at about
    ``per_partition`` each, never fewer than the session's shuffle count."""
    return max(shuffle_partitions(spark), -(-int(amount or 0) // per_partition), 1)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one scan of the text column)."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and reread (lineage cut)."""
    return materialize(df, f"llm-{name}")


def unstage(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows: what Python holds of
    their texts at a time stays small. At the end of the task freed memory
    goes back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Hand freed memory of this worker back: workers live on between tasks
    and share the executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(fn):
    """``fn`` for applyInArrow, with ``release`` once its own memory is free."""
    @functools.wraps(fn)
    def call(*args):
        out = fn(*args)
        release()
        return out
    call.__signature__ = inspect.signature(fn)  # Spark counts the arguments
    return call


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered. Cleared when it holds
    ``limit`` words, so its memory does not grow with the corpus."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and ODD**-i modulo 2**64 for i in 0..n."""
    if len(_POW.get("up", ())) <= n:
        m = max(n, 1 << 16)
        _POW["up"], _POW["down"] = _powers(ODD, m), _powers(pow(ODD, -1, 1 << 64), m)
    return _POW["up"][:n + 1], _POW["down"][:n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a rolling hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every window of ``k`` consecutive word hashes
    (empty when there are fewer than ``k`` words)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
