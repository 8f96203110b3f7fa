"""Shared helpers: staging tables in the cluster's shared folder, batching texts, stable hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has none that all see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="staged-")
        found = _own[app]
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_names(keep: Sequence[str], new: Sequence[str]) -> list[str]:
    """Names of kept columns beside new ones: kept_<name> for one that is named like a new one."""
    return [f"kept_{c}" if c in new else c for c in keep]


def fold(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about `most` characters each, one text at least."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


#: Byte classes of a word: lower-case of A-Z only, and the bytes 0x20 and 0x09-0x0D that part words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None
#: Longer words are hashed one by one; up to this length the vector hash has no weak strings.
LONG_WORD = 64


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of buf, all at once by a polynomial over prefix sums."""
    power, inverse = _power_tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=prefix[1:])
    length = (end - begin).astype(np.uint64)
    out = mix64((prefix[end] - prefix[begin]) * inverse[begin] ^ length * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        out[i] = long_hash(buf[begin[i] : end[i]].tobytes())
    return out


def long_hash(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _pieces(texts: Iterable[str | None], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (text number, bytes) of about `most` bytes; a longer text is parted at blanks."""
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = t.encode() if t else b""
        while len(raw) > most:
            cut = max(raw.rfind(b, most // 2, most) for b in (b" ", b"\n"))
            if cut < 0:
                cut = next((k for k in range(most, len(raw)) if BLANK[raw[k]]), len(raw))
            if held:
                yield held
                held, size = [], 0
            yield [(i, raw[:cut])]
            raw = raw[cut:]
        if size + len(raw) > most and held:
            yield held
            held, size = [], 0
        held.append((i, raw))
        size += len(raw) + 1
    if held:
        yield held


def word_hashes(texts: list[str | None], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    counts, found = np.zeros(len(texts), np.int64), []
    for piece in _pieces(texts, most):
        offsets = np.cumsum([0] + [len(raw) + 1 for _, raw in piece])
        buf = LOWER[np.frombuffer(b" ".join(raw for _, raw in piece) + b" ", np.uint8)]
        blank = BLANK[buf]
        inside = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        begin, end = np.flatnonzero(inside == -1), np.flatnonzero(inside == 1)
        found.append(span_hashes(buf, begin, end))
        per = np.diff(np.searchsorted(begin, offsets))
        np.add.at(counts, [i for i, _ in piece], per)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts
