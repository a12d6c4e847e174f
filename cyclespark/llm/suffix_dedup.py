"""Removal of byte strings that stand in an earlier document, decided by suffix arrays with common-prefix values.

Every window of `size` bytes picks its gram of smallest hash as its anchor, so equal windows have equal anchors, wherever
they stand. Consecutive windows with one anchor make a stretch: their bytes, some 66 of them. The suffix array of all texts thus
falls apart into shards by anchor: the windows that can be equal meet in one shard, and no others are needed there.

1. Anchors are counted. A stretch whose anchor occurs once in the table has no repeated window.
2. The other stretches go to their shards. Spark's spilling sort is the disk-backed queue that brings a shard's stretches up in
   order of anchor, so a shard may be far larger than memory; blocks of some megabytes then get their suffix array by induced sorting
   (see induced), with the common prefixes that it carries along. Neighbours with `size` bytes in common are equal windows: all but
   those of the smallest key are repeated. Stretches that can't share a window, by runs of bytes around their anchors, are not sorted.
3. The shard replies with the runs of repeated windows, and the texts are cut.

Texts are dealt to groups by a hash; a group is read in the same order in every pass, so replies name rows by number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, span_hashes, utf8
from .induced import Block, sort_suffixes, words8

_GRAM = 16
_PART = 1 << 22  # bytes of text that windows are sought in at a time
_BLOCK = 1 << 21  # bytes of a block that is sorted at once
_NULL = 2**63 - 1  # the place of null keys in the order: the last


def stretches(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: place of the first window, how many windows, the anchor's place and its hash.

    data, at: texts as utf8 gives them. A text longer than a part is read in parts; a run may be cut there.
    """
    width, out = size - _GRAM + 1, []
    for lo in range(0, len(data), _PART):
        part = data[lo : lo + _PART + size - 1]
        if len(part) < size:
            break
        n = min(_PART, len(part) - size + 1)
        eight = words8(part)
        hashes = mixed(mixed(eight[: 1 - _GRAM]) + eight[_GRAM - 8 : len(part) - 7])
        least = (hashes & ~np.uint64(_PART * 2 - 1)) | np.arange(len(hashes), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            least, w = np.minimum(least[:-w], least[w:]), 2 * w
        if w < width:
            least = np.minimum(least[: w - width], least[width - w :])
        anchor = (least[:n] & np.uint64(_PART * 2 - 1)).astype(np.int64)
        # windows that end within their text
        cut = at[(at > lo) & (at < lo + n + size)] - lo
        whole = np.zeros(n + 1, np.int32)
        np.add.at(whole, np.clip(cut - size + 1, 0, n), 1)
        np.add.at(whole, np.clip(cut, 0, n), -1)
        fit = np.cumsum(whole[:n]) == 0
        new = fit.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~fit[:-1]
        first = np.flatnonzero(new)
        stop = fit.copy()
        stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~fit[1:]
        n_windows = np.flatnonzero(stop) + 1 - first
        out.append((first + lo, n_windows, anchor[first] + lo, hashes[anchor[first]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers and bytes as one compressed blob; rising numbers should come as differences."""
    parts = [np.array([len(arrays)] + [len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        # bytes of equal weight stand together, so that small numbers shrink
        parts.append(a.tobytes() if a.dtype == np.uint8 else a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types) + 1)[1:]
    at, out = 8 * (len(types) + 1), []
    for n, t in zip(sizes, types):
        wide = np.dtype(t).itemsize
        flat = np.frombuffer(raw, np.uint8, int(n) * wide, at)
        out.append(flat if wide == 1 else np.ascontiguousarray(flat.reshape(wide, int(n)).T).view(t).reshape(-1))
        at += int(n) * wide
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class _Group:
    """The rows of one group in a fixed order: by key, then by content."""

    def __init__(self, rows: pa.Table):
        keys = rows.column("_key").to_numpy()
        ids = rows.column("_id").to_numpy()
        self.rows = rows.take(pa.array(np.lexsort((ids, keys))))
        self.keys = self.rows.column("_key").to_numpy()
        self.data, self.at = utf8(self.rows.column("text"))

    def stretches(self, size: int, hot: np.ndarray):
        """first, n, anchor, hash; windows of a hot anchor stand alone and go by their own hash (anchor -1)."""
        first, n, anchor, h = stretches(self.data, self.at, size)
        if len(hot):
            is_hot = np.isin(h, hot)
            if is_hot.any():
                one = np.repeat(first[is_hot] - np.concatenate([[0], np.cumsum(n[is_hot])[:-1]]), n[is_hot]) + np.arange(n[is_hot].sum())
                own = span_hashes(self.data, one, one + size)
                first, n = np.concatenate([first[~is_hot], one]), np.concatenate([n[~is_hot], np.ones(len(one), np.int64)])
                anchor, h = np.concatenate([anchor[~is_hot], np.full(len(one), -1)]), np.concatenate([h[~is_hot], own])
        return first, n, anchor, h


def _dealt(order: np.ndarray, bucket: np.ndarray):
    """(bucket, slice of order) for each bucket, keeping the order within."""
    by = np.argsort(bucket[order], kind="stable")
    order = order[by]
    heads = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, int)
    for lo, hi in zip(heads, np.append(heads[1:], len(order))):
        yield int(bucket[order[lo]]), order[lo:hi]


def _groups_of(inputs, column: str):
    """Tables of consecutive rows with one value of the column, from batches in its order."""
    held, value = [], None
    for batch in inputs:
        values = batch.column(column).to_numpy()
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
        for lo, hi in zip(heads, np.append(heads[1:], len(values)).astype(int)):
            if held and values[lo] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = values[lo]
            held.append(batch.slice(int(lo), int(hi - lo)))
    if held:
        yield value, pa.Table.from_batches(held)


def _counted(inputs):
    """For each blob of anchors a reply: which of them occur in another group too, as a bit each."""
    for bucket, rows in _groups_of(inputs, "bucket"):
        groups = rows.column("g").to_numpy()
        blobs = [_unpack(b, np.uint32)[0] for b in rows.column("blob").to_pylist()]
        names = [np.cumsum(d, dtype=np.uint32) for d in blobs]
        every = np.sort(np.concatenate(names))
        many = np.unique(every[1:][every[1:] == every[:-1]])
        ends = np.append(many, many[-1:])
        bits = [np.packbits(ends[np.searchsorted(many, x)] == x if len(many) else np.zeros(len(x), bool)).tobytes() for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.full(len(groups), bucket)), pa.array(bits, pa.binary())], names=["g", "bucket", "bits"])


def repeated(text: np.ndarray, ends: np.ndarray, n: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window in it) of the windows that also start at a smaller key, by the block's suffix array.

    text: bytes of the stretches, ends: where each stops, n: windows of each, keys: its key.
    """
    block = Block(text, ends)
    order, lcp = sort_suffixes(block)
    group = np.cumsum(lcp < size)
    starts = np.concatenate([[0], ends[:-1]]) + np.arange(len(ends)) + 1
    owner = np.zeros(len(block.text), np.int32)
    owner[1:] = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.concatenate([[0], ends])) + 1)
    key = keys[owner[order]]
    least = np.minimum.reduceat(key, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group - group[0]]
    hit = order[(key > least) & (block.left[order] >= size)]
    who = owner[hit]
    nth = hit - starts[who]
    fit = nth < n[who]
    return who[fit], nth[fit]


def _blocks(anchor: np.ndarray, sizes: np.ndarray):
    """Slices of stretches in order of anchor: of about a block's bytes each, and ending between anchors."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    breaks = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor)) if len(anchor) else np.zeros(1, int)
    k = 0
    while k < len(breaks) - 1:
        stop = max(k + 1, int(np.searchsorted(total[breaks], total[breaks[k]] + _BLOCK, "right")) - 1)
        yield slice(breaks[k], breaks[stop])
        k = stop


def _bytes_of(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans one after the other, and where each ends there."""
    to = np.cumsum(sizes)
    return text[np.repeat(starts - (to - sizes), sizes) + np.arange(to[-1])], to


def may_share(text: np.ndarray, ends: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Which stretches may have a window in common with another of these, by the bytes around their anchors.

    text, ends: as for `repeated`; place: where a stretch's anchor stands in text. Equal windows have their anchor at one place, say p
    bytes in. With l the multiple of a step at or below p, a run from l bytes before the anchor to the window's end, less than a step
    short of that, is then in both stretches. Runs are compared by hash, so some stretches may pass that share nothing.
    """
    width = size - _GRAM
    step = max(1, width // 8)
    starts, hit, eight = np.concatenate([[0], ends[:-1]]), np.zeros(len(ends), bool), words8(text)
    for l in range(0, width + 1, step):
        long = _GRAM + l + max(0, width - step + 1 - l)
        k = np.flatnonzero((place - l >= starts) & (place - l + long <= ends))
        name = np.full(len(k), l, np.uint64)
        for at in [*range(0, long - 8, 8), long - 8]:
            name = mixed(name + eight[place[k] - l + at])
        _, of, n = np.unique(name, return_inverse=True, return_counts=True)
        hit[k[n[of] > 1]] = True
    return hit


def _compared(size: int):
    def run(inputs):
        for bucket, rows in _groups_of(inputs, "bucket"):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("g", "blob")], names=["g", "blob"])
            else:
                yield from _shard(rows, size)

    return run


def _shard(rows: pa.Table, size: int):
    groups = rows.column("g").to_numpy()
    cells = [_unpack(b, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8) for b in rows.column("blob").to_pylist()]
    counts = np.array([len(c[2]) for c in cells])
    keys = np.concatenate([np.cumsum(c[0])[c[2]] for c in cells])
    n = np.concatenate([c[4] for c in cells]).astype(np.int64)
    off = np.concatenate([c[5] for c in cells]).astype(np.int64)
    text = np.concatenate([c[6] for c in cells])
    ends = np.cumsum(n + size - 1)
    starts = ends - (n + size - 1)
    # Equal stretches are one in the suffix array, with the smallest key; the others are repeated as a whole.
    a, b = span_hashes(text, starts, ends), span_hashes(text, starts, ends, 1)
    place = np.where(off < 255, starts + off, starts)
    by = np.argsort(place, kind="stable")
    anchor = np.empty(len(place), np.uint64)
    anchor[by] = span_hashes(text, place[by], place[by] + np.where(off[by] < 255, _GRAM, size))
    order = np.lexsort((keys, b, a, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    heads = order[new]
    kind = np.cumsum(new) - 1
    least = keys[heads][kind]
    whole = keys[order] > least
    found = [(order[whole], np.zeros(int(whole.sum()), np.int64), n[order[whole]])]
    # An anchor with one stretch is decided by that. The rows that stand for a stretch with its smallest key share the fate of its head.
    edge = np.append(True, anchor[heads][1:] != anchor[heads][:-1])
    several = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
    sought = np.flatnonzero(several)
    # Most stretches with a common anchor have too little else in common; only the others are sorted.
    near = np.zeros(len(sought), bool)
    for some in _blocks(anchor[heads[sought]], n[heads[sought]] + size - 1):
        own = heads[sought[some]]
        bytes_, to = _bytes_of(text, starts[own], n[own] + size - 1)
        near[some] = may_share(bytes_, to, to - (n[own] + size - 1) + off[own], size) | (off[own] == 255)
    sought = sought[near]
    runs = []
    for some in _blocks(anchor[heads[sought]], n[heads[sought]] + size - 1):
        own = heads[sought[some]]
        who, nth = repeated(*_bytes_of(text, starts[own], n[own] + size - 1), n[own], keys[own], size)
        runs.append((sought[some][who], nth))
    if runs:
        who, nth = (np.concatenate(x) for x in zip(*runs))
        by = np.lexsort((nth, who))
        who, nth = who[by], nth[by]
        head = np.append(True, (who[1:] != who[:-1]) | (nth[1:] != nth[:-1] + 1)) if len(who) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(who)))
        who, nth = who[at], nth[at]
        # to all rows of the head's stretch and key
        like = order[~whole]
        kind_of = kind[~whole]
        lo, hi = np.searchsorted(kind_of, who), np.searchsorted(kind_of, who, "right")
        many = hi - lo
        each = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        found.append((like[each], np.repeat(nth, many), np.repeat(length, many)))
    row = np.concatenate([c[1][c[2]] for c in cells])
    start = np.concatenate([np.cumsum(c[3], dtype=np.uint32) for c in cells])
    stretch, nth, length = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(stretch, kind="stable")
    stretch, nth, length = stretch[by], nth[by], length[by]
    cut = np.searchsorted(stretch, np.concatenate([[0], np.cumsum(counts)]))
    for k, g in enumerate(groups):
        own = slice(cut[k], cut[k + 1])
        if cut[k + 1] > cut[k]:
            s = stretch[own]
            blob = _pack(row[s], (start[s] + nth[own]).astype(np.uint32), length[own].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([blob], pa.binary())], names=["g", "blob"])


def drop_seen(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 50, with_spans: bool = True, room: int = 1 << 20) -> DataFrame:
    """One row per row of docs: its columns but the text, n_bytes, n_removed, n_spans, kept_sha256, and the spans removed.

    A byte of the UTF-8 text goes if a window of `size` bytes (16 to 200) covers it that also starts in a row with a smaller key.
    Windows overlap, stand within one row, and are judged on the input. n_spans counts the maximal removed runs; with_spans adds them as
    `spans` (start, length), in bytes. `room` sets the bytes of text that a task holds: 1.5 times it of texts, 16 times it of stretches.

    Null texts are empty. Rows with the same key are no copies of each other; null keys come last, as one key. Texts shorter than
    the window stay whole. An empty table gives no rows. Columns called like the new ones are replaced.
    """
    if not _GRAM <= size <= 200:
        raise ValueError("size must be 16 to 200")
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    own = [c for c in docs.columns if c != text and c not in new]
    plain = docs.select(F.struct(*own).alias("_own"), F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("_key"), F.col(text).alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, counters, n_groups = max(1, total // (16 * room)), max(1, total // (32 * room)), max(1, 2 * total // (3 * room))
    plain = plain.withColumn("_id", F.xxhash64("_key", "text", "_own"))
    plain = plain.withColumn("g", F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(n_groups)))
    # Anchors so frequent that one shard could not hold their stretches are found in a sample; a longer list means no other result.
    hot = _hot_anchors(plain, size)

    def count(rows: pa.Table) -> pa.Table:
        group = _Group(rows)
        h = np.unique(group.stretches(size, hot)[3])
        g, blobs, buckets = rows.column("g")[0].as_py(), [], []
        for bucket, which in _dealt(np.arange(len(h)), _bucket(h, counters)):
            name = np.unique(h[which].astype(np.uint32))
            blobs.append(_pack(np.diff(name, prepend=np.uint32(0))))
            buckets.append(bucket)
        return pa.table({"g": pa.array([g] * len(blobs), pa.int64()), "bucket": pa.array(buckets, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    marks = plain.groupBy("g").applyInArrow(count, "g long, bucket long, blob binary")
    marks = marks.repartition("bucket").sortWithinPartitions("bucket")
    live = marks.mapInArrow(_counted, "g long, bucket long, bits binary")

    def ask(rows: pa.Table, bits: pa.Table) -> pa.Table:
        out = {"g": [], "bucket": [], "blob": []}
        if rows.num_rows:
            group = _Group(rows)
            first, n, anchor, h = group.stretches(size, hot)
            values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            seen = np.zeros(len(values), bool)
            reply = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))
            for bucket, which in _dealt(np.arange(len(values)), _bucket(values, counters)):
                name, at = np.unique(values[which].astype(np.uint32), return_inverse=True)
                seen[which] = np.unpackbits(np.frombuffer(reply[bucket], np.uint8))[: len(name)][at]
            keep = np.flatnonzero((seen | (count > 1))[inverse])
            keep = keep[np.argsort(first[keep], kind="stable")]
            row = np.searchsorted(group.at, first[keep], "right") - 1
            # Of equal stretches in the group those of a larger key than the smallest are repeated, whatever else there is.
            f, m, key_of = first[keep], n[keep], group.keys[row]
            a, b = span_hashes(group.data, f, f + m + size - 1), span_hashes(group.data, f, f + m + size - 1, 1)
            by = np.lexsort((key_of, b, a))
            fresh = np.ones(len(by), bool)
            fresh[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
            low = np.empty(len(by), np.int64)
            low[by] = key_of[by[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1] if len(by) else 0
            gone = key_of > low
            g = int(rows.column("g")[0].as_py())
            out["g"].append(g)
            out["bucket"].append(-1 - g)  # only passes through
            out["blob"].append(_pack(row[gone].astype(np.uint32), (f[gone] - group.at[row[gone]]).astype(np.uint32), m[gone].astype(np.uint32)))
            f, m, row, an, hh = f[~gone], m[~gone], row[~gone], anchor[keep][~gone], h[keep][~gone]
            for bucket, k in _dealt(np.arange(len(f)), _bucket(mixed(hh), shards)):
                rows_of, at = np.unique(row[k], return_inverse=True)
                span = m[k] + size - 1
                to = np.cumsum(span)
                bytes_ = group.data[np.repeat(f[k] - (to - span), span) + np.arange(to[-1])]
                off = np.where(an[k] < 0, 255, an[k] - f[k])
                place = (f[k] - group.at[row[k]]).astype(np.uint32)
                out["g"].append(g)
                out["bucket"].append(bucket)
                out["blob"].append(_pack(np.diff(group.keys[rows_of], prepend=0), rows_of.astype(np.uint32), at.astype(np.uint32), np.diff(place, prepend=np.uint32(0)), m[k].astype(np.uint8), off.astype(np.uint8), bytes_))
        return pa.table({"g": pa.array(out["g"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

    asked = plain.groupBy("g").cogroup(live.groupBy("g")).applyInArrow(ask, "g long, bucket long, blob binary")
    spans = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compared(size), "g long, blob binary")

    fields = [plain.schema["_own"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>")]
    schema = T.StructType(fields)
    kinds = pa.schema([pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string())])
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
        group = _Group(rows)
        parts = [_unpack(b, np.uint32, np.uint32, np.uint32) for b in replies.column("blob").to_pylist()]
        row, start, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        at, data = group.at, group.data
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, at[row] + start, 1)
        np.add.at(change, at[row] + start + n + size - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        heads = at[:-1][at[:-1] < len(data)]
        begin[heads] = gone[heads]
        end = gone.copy()
        end[:-1] &= ~gone[1:]
        tails = at[1:][at[1:] > 0] - 1
        end[tails] = gone[tails]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        edge = np.searchsorted(begin, at)
        removed = np.concatenate([[0], np.cumsum(end - begin)])
        raw = data.tobytes()
        digests = []
        for k in range(len(at) - 1):
            digest, last = hashlib.sha256(), int(at[k])
            for i in range(edge[k], edge[k + 1]):
                digest.update(raw[last : begin[i]])
                last = int(end[i])
            digest.update(raw[last : at[k + 1]])
            digests.append(digest.hexdigest())
        text_of = np.searchsorted(at, begin, "right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(begin - at[text_of]), pa.array(end - begin)], names=["start", "length"])
        spans = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pairs).cast(span_kind)
        cells = [np.diff(at), np.diff(removed[edge]), np.diff(edge)]
        return pa.table([group.rows.column("_own"), *[pa.array(c.astype(np.int64)) for c in cells], pa.array(digests, pa.string()), spans], names=["_own", *kinds.names, "spans"])

    whole = plain.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(cut, schema)
    return whole.select("_own.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans"] if with_spans else []))


def _hot_anchors(plain: DataFrame, size: int, share: int = 64, least: int = 4096, most: int = 100_000) -> np.ndarray:
    """Hashes of anchors with `least` or more stretches in a 1/share sample of the rows, the `most` most frequent at the most.

    It only decides how work is split: windows of a hot anchor travel alone, by their own hash.
    """

    def run(inputs):
        for batch in inputs:
            data, at = utf8(batch.column("text"))
            h, n = np.unique(stretches(data, at, size)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = plain.filter(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(share)) == 0).select("text").mapInArrow(run, "h long, n long")
    hot = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most)
    return np.array([r["h"] for r in hot.collect()], np.int64).view(np.uint64)
