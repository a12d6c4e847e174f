"""Helpers of the training-data operators: shared folder, written tables, text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS.encode())] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cyclespark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (one place more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and how many words lie before each text's start.

    inside marks the bytes that belong to words (by default all but blanks). A word never crosses texts.
    """
    mask = (inside if inside is not None else ~_IS_BLANK)[data]
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = at[:-1][at[:-1] < len(mask)]
    first[heads] = mask[heads]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] = mask[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def _odd_powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


_BYTE = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_BASE = [0x5851F42D4C957F2D, 0x2545F4914F6CDD1D]
_CHUNK = 1 << 18
_POWERS = {}


def _powers(lane: int, n: int) -> np.ndarray:
    if lane not in _POWERS or len(_POWERS[lane]) < n:
        _POWERS[lane] = _odd_powers(n + 1024, _BASE[lane])
    return _POWERS[lane]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for each span (spans in order of start); depends on the content only."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    longest, k, n = int((ends - starts).max()), 0, len(starts)
    power = _powers(lane, _CHUNK + longest + 1)
    while k < n:  # in stretches, so that the running sums stay small
        lo = int(starts[k])
        stop = int(np.searchsorted(starts, lo + _CHUNK, "right"))
        hi = min(lo + _CHUNK + longest, len(values))
        part = values[lo:hi]
        part = _BYTE[lane][part] if part.dtype == np.uint8 else mixed(part + np.uint64(lane + 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        a, b = starts[k:stop] - lo, ends[k:stop] - lo
        # the power of a span's end is divided out by multiplying to one common exponent
        out[k:stop] = (total[b] - total[a]) * power[_CHUNK - np.minimum(a, _CHUNK)]
        k = stop
    return mixed(out + mixed((ends - starts).astype(np.uint64) + np.uint64(lane)))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def batches(inputs, rows: int = 2000, room: int = 1 << 20, column: str = "text"):
    """The record batches cut so that each holds at most so many rows and, but for single long texts, bytes."""
    for batch in inputs:
        k, total = 0, batch.num_rows
        if not total:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        while k < total:
            stop = max(k + 1, min(total, k + rows, int(np.searchsorted(ends, ends[k] + room, "right")) - 1))
            yield batch.slice(k, stop - k)
            k = stop
