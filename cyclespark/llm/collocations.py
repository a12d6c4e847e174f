"""Phrase collocation mining: frequent word sequences by Misra-Gries summaries, then counted exactly.

First pass: every run of 1 to 4 words is hashed (with its language) into one of many partitions. A task sums equal hashes of some
megabytes of text; each partition's sums are merged into one Misra-Gries summary. When a summary holds twice its capacity,
the count of rank capacity + 1 is taken off all counters, and those that are used up go; the summary keeps how much was taken off
in all. A run's true count lies between its counter and its counter plus that amount, so no run of the threshold or more is lost
while the amount stays below the threshold: where a cut would lift it that far, the capacity doubles instead, i.e. it exceeds the
partition's mass divided by the threshold whenever that is needed.

Second pass: the runs whose hash survived are counted again as what they are, language and words. Each task sums some megabytes of
text and sends the sums by hash partition, in blocks; a partition's blocks are summed exactly. The survivors reach the texts as a
filter of bits of bounded size; what else it lets through is counted too and falls to the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, mixed, span_hashes, stored, utf8, word_spans

LONGEST, LEAST, KEPT = 4, 30, 2000
_FLUSH = 1 << 21  # runs of words that a task sums at a time
_CAPACITY = 1 << 17  # counters of a partition's summary to begin with
_FILTER_BITS = 1 << 28  # the most that the filter of survivors takes: 32 MB

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False


class Runs:
    """Words of the texts of a batch, and for each the hashes of the runs of 1 to LONGEST words that begin there."""

    def __init__(self, batch: pa.RecordBatch):
        data, self.at = utf8(batch.column("text"))
        self.data = _LOWER[data]
        self.start, self.end, before = word_spans(self.data, self.at, _INSIDE)
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(before))
        langs = batch.column("lang").dictionary_encode()
        self.langs, code = langs.dictionary, langs.indices.to_numpy()
        lang_bytes, lang_at = utf8(self.langs)
        seed = mixed(span_hashes(lang_bytes, lang_at[:-1], lang_at[1:]) + np.uint64(11))
        self.code = code[self.text]
        breaks = np.cumsum(_BREAK[self.data]) if len(self.data) else np.zeros(0, np.int64)
        piece = breaks[self.start] if len(self.start) else np.zeros(0, np.int64)
        words = span_hashes(self.data, self.start, self.end)
        self.hashes, self.first, self.row = [], [], None
        h, first = mixed(words + seed[self.code]) if len(words) else words, np.arange(len(words))
        for k in range(1, LONGEST + 1):
            self.hashes.append(h)
            self.first.append(first)
            if k == LONGEST or not len(first):
                continue
            fit = first + k < len(words)
            first, h = first[fit], h[fit]
            fit = (piece[first] == piece[first + k]) & (self.text[first] == self.text[first + k])
            first, h = first[fit], h[fit]
            h = mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[first + k])

    def phrases(self, first: np.ndarray, words: int) -> pa.Array:
        """The runs as text, words joined by one space."""
        last = first + words - 1
        size = self.end - self.start + 1
        to = np.cumsum(size)
        if self.row is None:  # all words in a row, each with a space after it
            at = np.repeat(self.start - (to - size), size) + np.arange(to[-1] if len(to) else 0)
            self.row = np.append(self.data, np.uint8(32))[at]
            self.row[to - 1] = 32
        lo, hi = to[first] - size[first], to[last] - 1
        n = hi - lo
        at = np.concatenate([[0], np.cumsum(n)])
        out = self.row[np.repeat(lo - at[:-1], n) + np.arange(at[-1])]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


class Summary:
    """A Misra-Gries summary of 64-bit hashes: no hash of `least` or more is missing, whatever is merged into it."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.off = capacity, least, 0
        self.names, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list = []
        self.n_waiting = 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((names, counts))
        self.n_waiting += len(names)
        if self.n_waiting >= self.capacity:
            self._merge()

    def _merge(self) -> None:
        names = np.concatenate([self.names, *[x for x, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.n_waiting = [], 0
        self.names, self.counts = summed(names, counts)
        while len(self.names) > 2 * self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.off + cut >= self.least:
                self.capacity *= 2
                continue
            self.off += cut
            stay = self.counts > cut
            self.names, self.counts = self.names[stay], self.counts[stay] - cut

    def survivors(self) -> np.ndarray:
        """All hashes that may have come `least` times or more."""
        self._merge()
        return self.names[self.counts + self.off >= self.least]


def summed(names: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, in order, with the sum of its counts (1 each where none are given)."""
    if counts is None:
        names = np.sort(names)
    else:
        by = np.argsort(names, kind="stable")
        names, counts = names[by], counts[by]
    head = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    total = np.diff(np.append(head, len(names))) if counts is None else np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
    return names[head], total


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that rising numbers' differences shrink."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _blob(names: np.ndarray, counts: np.ndarray) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype(np.int64)
    raw = np.int64(len(names)).tobytes() + _planes(np.diff(names, prepend=np.uint64(0))) + small.tobytes() + large.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).reshape(-1)
    counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, -1, 8 + 9 * n)
    return np.cumsum(steps, dtype=np.uint64), counts


def _short(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes as they travel: their highest bits. Runs that share one only make their sum larger, so none is lost."""
    return h >> np.uint64(64 - width)


def surviving(docs: DataFrame, least: int, partitions: int, width: int, capacity: int = _CAPACITY) -> DataFrame:
    """(h): hashes of `width` bits that all runs of `least` or more have, and few others."""
    wide = -(-(1 << width) // partitions)

    def count(inputs):
        held, n = [], 0

        def out():
            names, counts = summed(np.concatenate(held))
            edge = np.searchsorted(names, np.arange(partitions + 1, dtype=np.uint64) * np.uint64(wide))
            own = np.flatnonzero(np.diff(edge))
            blobs = [_blob(names[edge[p] : edge[p + 1]], counts[edge[p] : edge[p + 1]]) for p in own]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], names=["p", "blob"])

        for batch in inputs:
            for part in batches([batch], room=1 << 20):
                for h in Runs(part).hashes:
                    held.append(_short(h, width))
                    n += len(h)
                if n >= _FLUSH:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merge(inputs):
        part, summary = None, None
        for batch in inputs:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist()):
                if p != part:
                    if summary:
                        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["h"])
                    part, summary = p, Summary(capacity, least)
                summary.add(*_unblob(blob))
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["h"])

    sums = docs.mapInArrow(count, "p int, blob binary")
    return sums.repartition("p").sortWithinPartitions("p").mapInArrow(merge, "h long")


def _bits_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x, y = mixed(h + np.uint64(1)), mixed(h + np.uint64(2))
    return [(v & np.uint64(bits - 1)).astype(np.int64) for v in (x, y, x >> np.uint64(32), y >> np.uint64(32))]


def filter_of(found: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits that every hash of `found` passes; bytes of it are set by tasks and joined by Spark."""
    page = 1 << 13

    def run(inputs):
        own: dict[int, np.ndarray] = {}
        for batch in inputs:
            h = batch.column("h").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_bits_of(h, bits))) if len(h) else np.zeros(0, np.int64)
            where = at // (8 * page)
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(at)]]))):
                if hi > lo:
                    bytes_ = own.setdefault(int(where[lo]), np.zeros(page, np.uint8))
                    place = at[lo:hi] % (8 * page)
                    np.bitwise_or.at(bytes_, place >> 3, (1 << (place & 7)).astype(np.uint8))
        for k, v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    def join(inputs):
        last, held = None, None
        for batch in inputs:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist()):
                if k != last:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["k", "v"])
                    last, held = k, np.zeros(page, np.uint8)
                held |= np.frombuffer(v, np.uint8)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["k", "v"])

    out = np.zeros(bits // 8, np.uint8)
    for r in found.mapInArrow(run, "k int, v binary").repartition("k").sortWithinPartitions("k").mapInArrow(join, "k int, v binary").toLocalIterator():
        out[r["k"] * page : (r["k"] + 1) * page] = np.frombuffer(r["v"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, capacity: int = _CAPACITY, deal: int = 10_000) -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to LONGEST words that come `least` times or more in a language, counted exactly.

    A row with words 0 and an empty phrase has all words of the language. docs: lang and text, no nulls.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # some 0.6 runs a byte; counters that hold a fourth of the threshold each
    partitions = int(min(max(1, total * 0.6 * 4 / least // capacity), 1 << 14))
    width = min(63, int(total).bit_length() + 12)
    found = stored(surviving(docs, least, partitions, width, capacity), "survivors")
    n = found.count()
    bits = 1 << 16
    while bits < 16 * n and bits < _FILTER_BITS:
        bits *= 2
    shared = spark.sparkContext.broadcast(filter_of(found, bits).tobytes())

    dealt = max(1, n // deal)
    columns = ["lang", "words", "phrase", "f"]

    def count(inputs):
        known, held, n, totals = np.frombuffer(shared.value, np.uint8), [], 0, {}

        def out():
            """What is held, summed, as one row per hash partition."""
            data, at = utf8(pa.array(list(totals), pa.string()))
            held.append((np.zeros(len(totals), np.int64), span_hashes(data, at[:-1], at[1:]), np.array(list(totals.values()), np.int64), pa.array([""] * len(totals), pa.string()), pa.array(list(totals), pa.string())))
            words, names, counts = (np.concatenate([x[k] for x in held]) for k in range(3))
            text, lang = (pa.concat_arrays([x[k] for x in held]) for k in (3, 4))
            by = np.lexsort((names, names % np.uint64(dealt)))
            words, names, counts, text, lang = words[by], names[by], counts[by], text.take(pa.array(by)), lang.take(pa.array(by))
            # neighbours of one 64-bit hash are summed only if they are the same text
            same = np.zeros(len(by), bool)
            same[1:] = (names[1:] == names[:-1]) & (words[1:] == words[:-1]) & pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False) & pc.equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(~same)
            part = (names[head] % np.uint64(dealt)).astype(np.int32)
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            take = pa.array(head)
            cells = (lang.take(take), pa.array(words[head].astype(np.int32)), text.take(take), pa.array(np.add.reduceat(counts, head)))
            lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), c) for c in cells]
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), *lists], names=["p", *columns])

        for batch in inputs:
            for part in batches([batch], room=1 << 20):
                runs = Runs(part)
                for name, c in zip(runs.langs.to_pylist(), np.bincount(runs.code, minlength=len(runs.langs)).tolist()):
                    totals[name] = totals.get(name, 0) + c
                for words, (h, first) in enumerate(zip(runs.hashes, runs.first), 1):
                    ok = np.ones(len(h), bool)
                    for at in _bits_of(_short(h, width), bits):
                        ok &= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    h, first = h[ok], first[ok]
                    by = np.argsort(h, kind="stable")
                    h, first = h[by], first[by]
                    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                    n += len(head)
                    held.append((np.full(len(head), words), h[head], np.diff(np.append(head, len(h))), runs.phrases(first[head], words), runs.langs.take(pa.array(runs.code[first[head]])).cast(pa.string())))
                if n >= _FLUSH // 8:
                    yield out()
                    held, n = [], 0
        if totals:
            yield out()

    def merge(inputs):
        """The sums of each hash partition; what is frequent in none of its blocks alone may be so in all."""
        part, held, n = None, [], 0
        kinds = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

        def summed_up():
            table = pa.Table.from_batches(held, kinds).combine_chunks().group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
            return table.rename_columns(["lang", "words", "phrase", "f"]).cast(kinds).to_batches()

        def chosen():
            for b in summed_up():
                yield b.filter(pc.or_(pc.greater_equal(b.column("f"), least), pc.equal(b.column("words"), 0)))

        for batch in inputs:
            for k, p in enumerate(batch.column("p").to_pylist()):
                if p != part and held:
                    yield from chosen()
                    held, n = [], 0
                part = p
                own = pa.RecordBatch.from_arrays([batch.column(c)[k].values for c in columns], schema=kinds)
                held.append(own)
                n += own.num_rows
                if n > 1 << 18:
                    held = summed_up()
                    n = sum(b.num_rows for b in held) // 2
        if held:
            yield from chosen()

    blocks = docs.mapInArrow(count, "p int, lang array<string>, words array<int>, phrase array<string>, f array<long>")
    return blocks.repartition("p").sortWithinPartitions("p").mapInArrow(merge, "lang string, words int, phrase string, f long")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, kept: int | None = KEPT, capacity: int = _CAPACITY, deal: int = 10_000) -> DataFrame:
    """Per language its best phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, those at spaces and tabs into words. n counts the
    words of a language, f a phrase's contiguous occurrences within pieces. Candidates have a = f(phrase) of `least` or more. A cut after
    the first k words gives l = f(first part), r = f(rest), score = floor(2,000,000 a / (l + r)); the lowest-scoring cut counts, of
    ties the smallest k. A candidate goes if its words lie within a longer one with at least 80 % of its occurrences. `kept` phrases of
    each language are returned, by score, a (both falling) and phrase (bytes, rising); None returns all.

    Null texts are empty, a null language is `und`. Repeated rows count each. An empty table gives no rows. Only the two columns are read.
    """
    plain = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sums = stored(frequent_phrases(plain, least, capacity, deal), "phrases")
    f = sums.filter("words > 0").select("lang", "phrase", "words", "f")
    parts = F.split("phrase", " ")
    candidates = f.filter("words > 1").withColumn("_w", parts)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        F.array_join(F.slice("_w", F.lit(1), k), " ").alias("x"), F.array_join(F.slice("_w", k + 1, F.col("words") - k), " ").alias("y"),
    ))).alias("k", "c")).select("lang", "phrase", "a", "k", "c.x", "c.y")
    # Parts of a frequent phrase are frequent: both are in the table.
    left = f.select(F.col("lang").alias("_lx"), F.col("phrase").alias("x"), F.col("f").alias("l"))
    right = f.select(F.col("lang").alias("_ly"), F.col("phrase").alias("y"), F.col("f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("_lx")) & (cuts["x"] == left["x"])).join(right, (F.col("lang") == F.col("_ly")) & (cuts["y"] == right["y"]))
    wide = "decimal(38,0)"
    # floor by whole numbers: the quotient of decimals would be rounded
    whole = F.expr(f"cast(cast(2000000 as {wide}) * cast(a as decimal(19,0)) div (cast(l as {wide}) + cast(r as {wide})) as long)")
    cuts = cuts.withColumn("score", whole)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    within = F.expr("""array_distinct(flatten(transform(sequence(2, words - 1), m ->
        transform(sequence(1, words - m + 1), s -> array_join(slice(_w, s, m), ' ')))))""")
    inner = candidates.filter("words > 2").select("lang", "f", F.explode(within).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left_over = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"most is null or cast(100 as {wide}) * cast(most as decimal(19,0)) < cast(80 as {wide}) * cast(a as decimal(19,0))"))
    ranked = left_over.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if kept is not None:
        ranked = ranked.filter(F.col("rank") <= kept)
    totals = sums.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
