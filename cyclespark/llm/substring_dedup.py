"""Removal of repeated passages by recompression: runs and pairs of words get names that are the same everywhere.

A round names each maximal run of one symbol, then flips a coin per symbol name (left or right) and names each left symbol
that a right one follows together with it. Names are hashes of what they stand for, so every task gives equal substrings equal
symbols, but for their ends, without a common dictionary. What is shared is then found by Spark on the symbols of all texts:

1. Low symbols. A symbol depends on a few words around it. Each window of words takes one low symbol whose dependence lies
   within the window (the one of smallest hash; the window itself where there is none), so equal windows take equal symbols.
   A window whose symbol occurs once in all texts is not repeated. This rules out nearly all windows of unique text.
2. High symbols stand for long runs of words, and whole texts for themselves. A high symbol that occurs earlier elsewhere
   reveals a long repeat: all windows inside it are repeated, and need no comparison of their own.
3. The windows that are left are compared by 96-bit hashes of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, mixed, span_hashes, utf8, word_spans

LOW, HIGH = 2, 12
_ROOM = 1 << 20  # bytes of text that a task handles at a time; keeps the arrays near the processor
_LAST = 2**63 - 1  # stands for a null key


class Symbols:
    """Symbols of the texts of a batch: names, first and last word, and the words that a symbol depends on."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        n = len(words)
        self.name, self.start = words.copy(), np.arange(n, dtype=np.int32)
        self.end = self.start + 1
        self.lo, self.hi, self.round = self.start, self.end, 0
        self.text = np.repeat(np.arange(len(before) - 1, dtype=np.int32), np.diff(before))
        self.edges = before.astype(np.int32)

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """How far the dependence of the left and of the right neighbour goes; beyond the text where there is none."""
        left, right = self.edges[self.text] - 1, self.edges[self.text + 1] + 1
        same = self.text[1:] == self.text[:-1]
        left[1:][same] = self.lo[:-1][same]
        right[:-1][same] = self.hi[1:][same]
        return left, right

    def next_round(self, dependence: bool = True) -> None:
        """One round; without dependence lo and hi are no longer kept up."""
        if not len(self.name):
            return
        self.round += 1
        self._runs(dependence)
        self._pairs(dependence)

    def _runs(self, dependence: bool) -> None:
        head = np.ones(len(self.name), bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(head)
        if len(first) == len(head):
            if dependence:
                left, right = self._beside()
                self.lo, self.hi = np.minimum(self.lo, left), np.maximum(self.hi, right)
            return
        last = np.append(first[1:], len(head)) - 1
        n = last - first + 1
        name = self.name[first]
        many = np.flatnonzero(n > 1)
        name[many] = mixed(name[many] + n[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if dependence:
            left, right = self._beside()
            self.lo, self.hi = np.minimum(self.lo[first], left[first]), np.maximum(self.hi[last], right[last])
        self.name, self.start, self.end, self.text = name, self.start[first], self.end[last], self.text[first]

    def _pairs(self, dependence: bool) -> None:
        is_left = mixed(self.name ^ np.uint64(self.round)) >> np.uint64(63) == 1
        joined = np.zeros(len(self.name), bool)
        joined[:-1] = is_left[:-1] & ~is_left[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(len(self.name), bool)
        second[1:] = joined[:-1]
        at = np.flatnonzero(joined)
        self.name[at] = mixed(mixed(self.name[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + self.name[at + 1])
        self.end[at] = self.end[at + 1]
        if dependence:
            left, right = self._beside()
            lo = np.where(~is_left & ~second, np.minimum(self.lo, left), self.lo)
            hi = np.where(is_left & ~joined, np.maximum(self.hi, right), self.hi)
            lo[at], hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        keep = np.flatnonzero(~second)
        self.name, self.start, self.end, self.text = self.name[keep], self.start[keep], self.end[keep], self.text[keep]
        if dependence:
            self.lo, self.hi = lo[keep], hi[keep]


def _window_starts(before: np.ndarray, size: int) -> np.ndarray:
    sizes = np.maximum(np.diff(before) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(before[:-1] - first[:-1], sizes) + np.arange(first[-1])


def window_anchors(low: Symbols, starts: np.ndarray, size: int) -> np.ndarray:
    """For each window the number of its symbol, or -1 where no symbol's dependence lies within it."""
    # How many symbols have lo below a place, and hi up to a place: the candidates are [a, b).
    n = int(low.edges[-1]) + 2
    a = np.cumsum(np.bincount(low.lo + 1, minlength=n + 1))[starts]
    b = np.cumsum(np.bincount(low.hi, minlength=n + 1))[starts + size]
    rank = np.append(mixed(low.name + np.uint64(7)), np.uint64(2**64 - 1))
    # The least rank of [a, b) is that of two stretches of a power of two, tabled by doubling.
    best = np.full(len(starts), -1)
    table, width = np.arange(len(rank) - 1), 1
    count = b - a
    while len(table):
        own = np.flatnonzero((count >= width) & (count < 2 * width))
        if len(own):
            x, y = table[a[own]], table[b[own] - width]
            best[own] = np.where(rank[y] < rank[x], y, x)
        if not (count >= 2 * width).any():
            break
        x, y = table[: len(table) - width], table[width:]
        table, width = np.where(rank[y] < rank[x], y, x), 2 * width
    return best


def _first_and_later(rank: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks one row of the smallest rank for each key, the rows of larger rank, and the rows whose key occurs again."""
    by = np.lexsort((rank, *keys))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    first, later, many = np.zeros(len(by), bool), np.zeros(len(by), bool), np.zeros(len(by), bool)
    first[by[new]] = True
    later[by] = rank[by] > rank[by][new][group]
    many[by] = (np.bincount(group) > 1)[group]
    return first, later, many


class Parsed:
    """What one batch of texts needs in both passes."""

    def __init__(self, column: pa.Array, key: np.ndarray, size: int):
        self.data, self.at = utf8(column)
        starts, ends, self.before = word_spans(self.data, self.at)
        self.lanes = [span_hashes(self.data, starts, ends, lane) for lane in (0, 1)]
        self.tag = _tags(self.lanes[0], self.before)
        self.key, self.size = key, size
        self.symbols = Symbols(self.lanes[0], self.before)
        for _ in range(LOW):
            self.symbols.next_round()
        self.windows = _window_starts(self.before, size)
        self.anchor = window_anchors(self.symbols, self.windows, size)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, word, "right") - 1

    def place(self, word: np.ndarray) -> np.ndarray:
        text = self.text_of(word)
        return self.tag[text] << 32 | (word - self.before[text])

    def rank(self, word: np.ndarray) -> np.ndarray:
        """Order of places by key, then by start; rows with the same key and start are alike."""
        text = self.text_of(word)
        _, dense = np.unique(self.key, return_inverse=True)
        return dense[text].astype(np.int64) << 40 | (word - self.before[text])


def _marks(parsed: Parsed):
    """Rows (k1, k2, key, place, words, weight) of low symbols (words 0) and high ones.

    Within the batch, only the first row of a key keeps it; for the others it is known that they are repeated (weight 2), and
    they get keys of their own, so that a hot key has no more than one row per batch.
    """
    p = parsed
    used = np.unique(p.anchor[p.anchor >= 0])
    bare = p.windows[p.anchor < 0]
    lo = np.concatenate([p.symbols.lo[used], bare])
    hi = np.concatenate([p.symbols.hi[used], bare + p.size])
    by = np.argsort(lo, kind="stable")
    k1 = np.empty(len(lo), np.uint64)
    k1[by] = span_hashes(p.lanes[0], lo[by], hi[by])
    word = np.concatenate([p.symbols.start[used], bare])
    # Low symbols only let windows through, so rows with the same key may share them: no tag.
    place = (word - p.before[p.text_of(word)]) << 1 | np.concatenate([np.zeros(len(used), np.int64), np.ones(len(bare), np.int64)])
    first, _, many = _first_and_later(p.rank(word), k1)
    own = mixed(place.astype(np.uint64) + mixed(p.key[p.text_of(word)].astype(np.uint64)))
    low = (np.where(first, k1, own), np.zeros(len(k1), np.uint64), p.key[p.text_of(word)], place, np.zeros(len(k1), np.int64), np.where(many, 2, 1))

    high = p.symbols
    for _ in range(HIGH - LOW):
        high.next_round(dependence=False)
    long = np.flatnonzero(high.end - high.start >= p.size) if len(high.name) else np.zeros(0, np.int64)
    texts = np.flatnonzero(np.diff(p.before) >= p.size)
    spans = np.concatenate([np.stack([high.start[long], high.end[long]], 1), np.stack([p.before[:-1][texts], p.before[1:][texts]], 1)])
    start, end = np.unique(spans, axis=0).T
    keys = [span_hashes(lane, start, end, i) for i, lane in enumerate(p.lanes)]
    _, later, _ = _first_and_later(p.rank(start), *keys)
    place = p.place(start)
    own = mixed(mixed(place.astype(np.uint64)) + end.astype(np.uint64) + mixed(p.key[p.text_of(start)].astype(np.uint64) + np.uint64(1)))
    high_rows = (np.where(later, own, keys[0]), keys[1] | np.uint64(1), p.key[p.text_of(start)], place, end - start, np.where(later, 2, 1))
    return [np.concatenate(x) for x in zip(low, high_rows)]


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, with_text: bool = False) -> DataFrame:
    """One row per row of docs: its columns but the text, n_words, n_removed and kept_sha256.

    with_text adds the text: as it was where nothing is removed, else the kept words joined by one space.

    A word goes if a window of `size` words covers it whose word sequence also starts earlier: at a smaller key, or earlier in
    the same text. Windows are judged on the input. Words are what stands between blanks.

    Null texts have no words. Rows with the same key count as one place in the order: of equal windows in them the one with
    the smaller start is earlier, and at the same start none is. Null keys come last, as one such place. Texts shorter than
    the window stay whole. An empty table gives no rows. Columns called like the new ones are replaced.
    """
    own = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256")]
    plain = docs.select(F.struct(*own).alias("_own"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_key"), F.col(text).alias("text"))

    def mark(inputs):
        for batch in batches(inputs, room=_ROOM):
            parsed = Parsed(batch.column("text"), batch.column("_key").to_numpy(zero_copy_only=False), size)
            if len(parsed.windows):
                k1, k2, owner, place, words, weight = _marks(parsed)
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(owner), pa.array(place), pa.array(words.astype(np.int32)), pa.array(weight.astype(np.int32))], names=["k1", "k2", "_key", "place", "words", "weight"])

    rows = plain.select("_key", "text").mapInArrow(mark, "k1 long, k2 long, _key long, place long, words int, weight int")
    alike = Window.partitionBy("k1", "k2")
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.struct("_key", start.alias("s"))
    told = rows.withColumn("n", F.sum("weight").over(alike)).withColumn("first", F.min(at).over(alike))
    told = told.filter(F.when(F.col("words") == 0, F.col("n") > 1).otherwise((F.col("weight") > 1) | (at > F.col("first"))))
    told = told.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("place", "words")).alias("marks"))

    def ask(inputs):
        """The windows that marks leave open, with their hashes; those that an earlier row of the batch has come as runs."""
        for batch in batches(inputs, rows=1000, room=_ROOM):
            p = Parsed(batch.column("text"), batch.column("_key").to_numpy(zero_copy_only=False), size)
            marks = batch.column("marks")
            live = np.zeros(len(p.windows), bool)
            edge = np.searchsorted(p.text_of(p.windows), np.arange(batch.num_rows + 1))
            for t in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)):
                own = marks[int(t)].values
                place, words = own.field("place").to_numpy(), own.field("words").to_numpy()
                low = place[words == 0]
                mine = slice(edge[t], edge[t + 1])
                a, w = p.anchor[mine], p.windows[mine] - p.before[t]
                named = np.where(a >= 0, (p.symbols.start[a] - p.before[t]) << 1, w << 1 | 1)
                live[mine] = np.isin(named, low)
                for start, m in _high(place, words, p.tag[t]):
                    live[edge[t] + start : edge[t] + start + m - size + 1] = False
            w = p.windows[live]
            k = [span_hashes(lane, w, w + size, i) for i, lane in enumerate(p.lanes)]
            _, later, _ = _first_and_later(p.rank(w), *k)
            open_w, gone = w[~later], w[later]
            head = np.ones(len(gone), bool)
            head[1:] = (np.diff(gone) > 1) | (np.diff(p.text_of(gone)) > 0)
            heads = np.flatnonzero(head)
            runs, n = gone[heads], np.diff(np.append(heads, len(gone)))
            at = np.concatenate([open_w, runs])
            text = p.text_of(at)
            own = mixed(mixed(at.astype(np.uint64)) + mixed(p.key[text].astype(np.uint64)))  # keys of their own for the runs
            k1 = np.concatenate([k[0][~later], own[len(open_w) :]])
            k2 = np.concatenate([k[1][~later], own[len(open_w) :]])
            # n: windows of a run that is known to be repeated, or 0 for one that is open
            cells = [p.key[text], p.place(at), np.concatenate([np.zeros(len(open_w), np.int64), n]), k1.view(np.int64), (k2 >> np.uint64(32)).astype(np.uint32).view(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cells, ("i8", "i8", "i4", "i8", "i4"))], names=["_key", "place", "n", "k1", "k2"])

    # Both passes over the texts read one shuffle of them, as they are parts of one plan.
    joined = plain.join(told, F.col("_key") == F.col("_k"), "left").select("_own", "_key", "text", "marks")
    asked = joined.mapInArrow(ask, "_key long, place long, n int, k1 long, k2 int")
    later = asked.withColumn("first", F.min(at).over(alike)).filter((F.col("n") > 0) | (at > F.col("first")))
    later = later.groupBy(F.col("_key").alias("_l")).agg(F.collect_list(F.struct("place", F.greatest("n", F.lit(1)).alias("n"))).alias("later"))
    fields = [plain.schema["_own"], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string").fields]
    schema = T.StructType(fields + ([T.StructField("_text", T.StringType())] if with_text else []))

    def cut(inputs):
        for batch in batches(inputs, rows=1000):
            rows = []
            for k, t in enumerate(batch.column("text").to_pylist()):
                words = (t or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                marks, later = batch.column("marks")[k], batch.column("later")[k]
                if marks.is_valid or later.is_valid:
                    tag = _tag(t)
                    spans = []
                    if marks.is_valid:
                        own = marks.values
                        spans += _high(own.field("place").to_numpy(), own.field("words").to_numpy(), tag)
                    if later.is_valid:
                        own = later.values
                        place = own.field("place").to_numpy()
                        mine = place >> 32 == tag
                        spans += zip((place[mine] & 0xFFFFFFFF).tolist(), (own.field("n").to_numpy()[mine] + size - 1).tolist())
                    for start, m in spans:
                        gone[start] += 1
                        gone[start + m] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                n = int(len(words) - stay.sum())
                kept = b" ".join([words[i] for i in np.flatnonzero(stay)] if n else words)
                rows.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if n else t))
            cells = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            cells += [pa.array([r[3] for r in rows], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("_own"), *cells], names=schema.names)

    whole = joined.join(later, F.col("_key") == F.col("_l"), "left").select("_own", "text", "marks", "later")
    return whole.mapInArrow(cut, schema).select("_own.*", "n_words", "n_removed", "kept_sha256", *([F.col("_text").alias(text)] if with_text else []))


def _high(place: np.ndarray, words: np.ndarray, tag: int) -> list[tuple[int, int]]:
    """(first word, words) of the high symbols among marks that belong to the row with that tag."""
    own = (words > 0) & (place >> 32 == tag)
    return list(zip((place[own] & 0xFFFFFFFF).tolist(), words[own].tolist()))


def _tags(lane: np.ndarray, before: np.ndarray) -> np.ndarray:
    """30 bits of each text's hash, to tell rows with the same key apart."""
    return (span_hashes(lane, before[:-1], before[1:]) >> np.uint64(34)).astype(np.int64)


def _tag(text: str) -> int:
    data, at = utf8(pa.array([text], pa.string()))
    starts, ends, before = word_spans(data, at)
    return int(_tags(span_hashes(data, starts, ends), before)[0])
