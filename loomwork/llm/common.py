"""What the corpus operators share: tables, held-out folds, shared folders, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

SEED = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0x100000001B3)
#: Ids up to this number (16 MB) are sent to the scan of the texts; more are joined by shuffle.
SENT_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % k, F.lit(-1)).cast("int")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``; in local mode, where that may be unset, in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/loomwork-{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to a shared folder and read back (lineage ends, nothing runs twice), and a
    function that deletes the folder, to be called when all that reads it has been written."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    written(df, path, compression="zstd")

    def drop() -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), drop


def persisted(df: DataFrame, what: str) -> DataFrame:
    """As ``kept``, for what the returned rows themselves still read."""
    return kept(df, what)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        full = np.full(max(n, 2 * len(_POWERS)), _MULT, np.uint64)
        full[0] = 1
        _POWERS = np.cumprod(full, dtype=np.uint64)
    return _POWERS[:n]


def space_table() -> np.ndarray:
    """True for the bytes of words that white space (20, 09 to 0D) separates."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alnum_table() -> np.ndarray:
    """True for the bytes of words of 0-9, a-z and everything beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return keep


def word_spans(data: bytes, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as an array, and the start and end of each word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = keep[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, keep: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``data`` (UTF-8, already lower-cased), in order."""
    raw, starts, ends = word_spans(data, keep)
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = raw.astype(np.uint64) + np.uint64(1)
    value *= powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    # The sum over a word, times the power that moves every word to the same end.
    span = (total[ends] - total[starts]) * powers(len(raw) + 1)[len(raw) - starts]
    # The shift depends on the text's length, so it is undone by an odd (invertible) factor.
    span *= inverse_power(len(raw))
    return mixed(span ^ ((ends - starts).astype(np.uint64) * SEED))


def inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULT), -n, 1 << 64) if n else 1)


def times_seed(n: int) -> np.uint64:
    return np.uint64(int(SEED) * n & 0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; of the whole sequence if it has fewer, but not none."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, times_seed(width), np.uint64)
    for j in range(width):
        out = mixed(out ^ words[j : n - width + 1 + j]) + times_seed(j + 1)
    return out


def utf8(text: str | None) -> bytes:
    """Lone surrogates, which Spark's strings cannot hold, would otherwise stop a task."""
    return (text or "").encode("utf-8", "surrogatepass")
