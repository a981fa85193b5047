"""What the corpus operators share: table reading, lineage cuts and word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
_own: dict[str, str] = {}
#: What ``cut`` has written and not discarded, by session.
_written: dict[int, list[str]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="quillspark-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        found = f"file://{_own['dir']}"
    return found.rstrip("/")


#: For tables of very long values: row groups are closed by their size at every few rows, so a writer holds little.
LONG_ROWS = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 2}


def cut(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither
    compute it again nor depend on what a lost executor held."""
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _written.setdefault(id(df.sparkSession), []).append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and no later job reads; others are left alone."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            _delete(t.sparkSession, path)
            _written[id(t.sparkSession)].remove(path)


def written(spark: SparkSession) -> tuple[str, ...]:
    """What ``cut`` has written in this session and nobody has discarded."""
    return tuple(_written.get(id(spark), ()))


def discard_since(spark: SparkSession, before: tuple[str, ...], *keep: DataFrame) -> None:
    """Delete what ``cut`` has written since ``before``, but for the tables ``keep``."""
    stay = {*before, *(getattr(t, "_cut_path", None) for t in keep)}
    for path in written(spark):
        if path not in stay:
            _delete(spark, path)
            _written[id(spark)].remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(sizes: list[int], most: int):
    """(from, to) runs of consecutive rows of about ``most`` characters each, one row at least."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


class WordHash(dict):
    """word -> 64-bit hash, computed once for each word; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 500_000):
        import xxhash

        super().__init__()
        self.most, self.of = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.of(word)
        return h


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) over all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def texts(column: str = "text"):
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
