"""Best-fit decreasing packing of token pieces into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, stored

EOS = 2


def encoder(tokenizer: str, ranks: str, pattern: str):
    """text -> ids of the byte-level BPE: by the vocabulary's ranks; texts that spell out a special token by the tokenizer file."""
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast, slow = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), None

    def encode(text: str) -> np.ndarray:
        nonlocal slow
        if "<|endoftext|>" in text:
            if slow is None:
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(tokenizer)
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def public_encoder():
    import public_tokenizers as P

    return encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, text: str = "text", size: int = 1024, make_encoder=public_encoder, with_ids: bool = False) -> DataFrame:
    """docs (without the text) with a row per piece of its ids, which end with id 2.

    Only documents longer than `size` are cut; their first piece takes what is left over, the others are full. Null and empty
    texts have the single id 2. with_ids adds the ids as an array.
    """
    own = [c for c in docs.columns if c not in ("piece", "start", "length", "ids_crc32", "ids", text)]
    schema = T.StructType([docs.schema[c] for c in own] + T._parse_datatype_string(PIECES + (", ids array<int>" if with_ids else "")).fields)

    def cut(inputs):
        encode = make_encoder()
        for batch in batches(inputs, column=text):
            rows, made, ids_of = [], [], []
            for k, t in enumerate(batch.column(text).to_pylist()):
                ids = np.append(encode(t or ""), np.uint32(EOS)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                for piece, start in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[start : (first if not piece else start + size)]
                    rows.append(k)
                    made.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                    ids_of += [part.astype(np.int32)] if with_ids else []
            at = pa.array(rows, pa.int32())
            cells = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            cells += [pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in own] + cells, names=schema.names)

    return docs.select(*own, text).mapInArrow(cut, schema)


class Capacities:
    """Segment tree over remaining capacities 0..size: finds the tightest one in use that is large enough in O(log size)."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.used = [0] * (2 * self.width)

    def set(self, capacity: int, on: bool) -> None:
        k = capacity + self.width
        self.used[k] = int(on)
        while k > 1:
            k //= 2
            self.used[k] = self.used[2 * k] | self.used[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        k = least + self.width
        while not self.used[k]:
            while k & 1:  # a right child: nothing further right below this parent
                k //= 2
            if k <= 1:
                return None
            k += 1
        while k < self.width:
            k = 2 * k if self.used[2 * k] else 2 * k + 1
        return k - self.width


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing on counts: rows (length, first rank, first sequence, offset).

    The pieces of a length, by rank, go one each into consecutive sequences from the first one given. A sequence takes as many
    pieces of a length as fit before the next one gets any, as best fit does. Equal lengths and equal capacities are handled at
    once, so the work depends on the number of different lengths, not of pieces.
    """
    steps, fresh, tree = [], 0, Capacities(size)
    open_at: dict[int, deque] = {}

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at.setdefault(capacity, deque()).append((first, n))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # new sequences, each as full of this length as needed and possible
                each = size // length
                n = -(-left // each)
                full = left // each
                for k in range(each):
                    take = full + (1 if k < left - full * each else 0)
                    if take:
                        steps.append((length, rank, fresh, k * length))
                        rank += take
                put(size - each * length, fresh, full)
                if n > full:
                    put(size - (left - full * each) * length, fresh + full, 1)
                fresh, left = fresh + n, 0
                continue
            first, n = open_at[capacity].popleft()
            if not open_at[capacity]:
                tree.set(capacity, False)
            each = capacity // length  # a sequence just used is the tightest for the next piece, until it is full
            n_full = min(n, left // each)
            some = left - n_full * each if n_full < n else 0
            for k in range(each):
                take = n_full + (1 if k < some else 0)
                if take:
                    steps.append((length, rank, first, size - capacity + k * length))
                    rank += take
            left -= n_full * each + some
            put(capacity - each * length, first, n_full)
            used = n_full
            if some:
                put(capacity - some * length, first + n_full, 1)
                used += 1
            put(capacity, first + used, n - used)
    return steps


def pack(pieces: DataFrame, size: int = 1024, key: str = "doc_id", salts: int | None = None) -> DataFrame:
    """pieces (with length, at most `size`) with sequence_id and offset, by best-fit decreasing over all of them.

    Lengths are whole numbers up to `size`, so a histogram says all that best-fit decreasing needs: the plan is made on it, and
    a piece finds its place by its length and its rank among the pieces of that length. Ranks are counted in two steps, within
    salts and over the counts of salts, so that no length is ranked in one task; salts grow with the number of pieces.
    Pieces that are alike in all columns may change places. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    salts = salts or max(8, n // 100_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_before"])
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    steps = sorted(plan(histogram, size))
    sent = spark.sparkContext.broadcast((np.array([s[:2] for s in steps], np.int64).reshape(-1, 2), np.array([s[2:] for s in steps], np.int64).reshape(-1, 2)))
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(before.select("length", "_salt", "_before"), ["length", "_salt"]).select(*own, (F.col("_before") + F.col("_rank")).alias("_rank"))
    schema = T.StructType([pieces.schema[c] for c in own] + T._parse_datatype_string("sequence_id long, offset long").fields)

    def place(inputs):
        at, to = sent.value
        keys = at[:, 0] << 42 | at[:, 1]
        for batch in inputs:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            k = np.searchsorted(keys, length << 42 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(to[k, 0] + rank - at[k, 1]), pa.array(to[k, 1])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, text: str = "text", size: int = 1024, key: str = "doc_id", make_encoder=public_encoder) -> DataFrame:
    """The pieces of docs with their places; see cut_pieces and pack.

    Null keys are allowed; repeated rows are packed one by one; an empty table gives no rows. Columns called like the new ones
    are replaced.
    """
    return pack(stored(cut_pieces(docs, text, size, make_encoder), "pieces"), size, key)
