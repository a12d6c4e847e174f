"""Collocations, suffix-array dedup and whitening against brute force, on edge cases and split many ways."""

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cyclespark.llm import collocations, suffix_dedup, whitening
from cyclespark.llm.collocations import Summary, mine_collocations
from cyclespark.llm.induced import Block, sort_suffixes
from cyclespark.llm.suffix_dedup import drop_seen
from cyclespark.llm.whitening import components, inertia, whiten

NULL = 2**63 - 1


def test_induced_sorting():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([b"a", b"ab", b"abc", bytes([0, 1, 255]), b"abcdefgh"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 40, 300]))) for _ in range(rng.randint(1, 6))]
        strings += strings[:1] * rng.randint(0, 2)
        order, lcp = sort_suffixes(Block(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])))
        suffix, at = {0: b""}, 1
        for s in strings:
            suffix |= {at + i: s[i:] for i in range(len(s) + 1)}
            at += len(s) + 1
        got = [suffix[i] for i in order.tolist()]
        assert sorted(order.tolist()) == sorted(suffix) and got == sorted(got)
        for k in range(1, len(got)):
            x, y = got[k - 1], got[k]
            same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            assert lcp[k] == min(same, 255)


def brute_seen(rows, size):
    first, out = {}, []
    place = lambda key: NULL if key is None else key
    for key, text in sorted(rows, key=lambda r: place(r[0])):
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], place(key))
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < place(key):
                gone[i : i + size] = b"\1" * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é\0") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(base)[rng.randint(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 6))]
        rows.append((i if rng.random() < 0.9 else rng.choice([None, 3, 7]), rng.choice([None, ""]) if rng.random() < 0.05 else "".join(parts)))
    return rows + [(50, "ab" * 3000), (60, "x" + "ab" * 2000), (70, "aaaa" * 500), (71, "a" * 1999 + "b"), (71, "a" * 1999 + "b")]


@pytest.mark.parametrize(("size", "room", "hot"), [(50, 1 << 20, False), (50, 1 << 10, False), (20, 1 << 10, True)])
def test_seen_strings(spark, monkeypatch, passages, size, room, hot):
    """One group and one shard, many of them, and with windows of frequent anchors dealt one by one."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "_hot_anchors", functools.partial(suffix_dedup._hot_anchors, share=1, least=20))
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = drop_seen(docs, size=size, room=room, with_spans=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute_seen(passages, size)


@pytest.mark.parametrize("size", [16, 19, 50, 51, 200])
def test_only_stretches_near_each_other_are_sorted(monkeypatch, size):
    """One anchor in 300 surroundings; wherever it stands in a window, two more stretches share that window and nothing beyond it."""
    rng, width = np.random.default_rng(size), size - 16
    noise = lambda n, low=0, high=256: rng.integers(low, high, n).astype(np.uint8)
    anchor, stretches = noise(16), []
    for p in range(width + 1):
        window = np.concatenate([noise(p), anchor, noise(width - p)])
        for own in ((0, 128), (128, 256)):
            before, after = int(rng.integers(0, width - p + 1)), int(rng.integers(0, p + 1))
            stretches.append((before + after + 1, before + p, np.concatenate([noise(before, *own), window, noise(after, *own)])))
    near = len(stretches)
    stretches += [(1, 0, np.concatenate([anchor, noise(width)])) for _ in range(300)] if size > 16 else []
    n, off, text = zip(*stretches)
    number = np.arange(len(n), dtype=np.uint32)
    blob = suffix_dedup._pack(np.diff(number.astype(np.int64), prepend=0), number, number, number * 0, np.array(n, np.uint8), np.array(off, np.uint8), np.concatenate(text))
    rows = pa.table({"g": pa.array([0]), "bucket": pa.array([0]), "blob": pa.array([blob], pa.binary())})
    sorted_, plain = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda text, ends, *rest: (sorted_.append(len(ends)), plain(text, ends, *rest))[1])
    row, start, length = (np.concatenate(x).tolist() for x in zip(*[suffix_dedup._unpack(b, np.uint32, np.uint32, np.uint32) for r in suffix_dedup._shard(rows, size) for b in r.column("blob").to_pylist()]))
    assert sorted(zip(row, start, length)) == [(k, off[k] - k // 2, 1) for k in range(1, near, 2)]
    assert sum(sorted_) <= near


def test_long_text_in_parts(monkeypatch):
    """Windows of a text that is read in parts have the anchors they have in one."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    at = np.array([0, 2000, 2000, 2030, 5000])
    whole = suffix_dedup.stretches(data, at, 50)
    monkeypatch.setattr(suffix_dedup, "_PART", 512)
    parts = suffix_dedup.stretches(data, at, 50)

    def windows(s):
        return {int(f + i): int(h) for f, n, _, h in zip(*s) for i in range(n)}

    assert windows(whole) == windows(parts) and len(windows(whole)) == 1951 + 2921


def test_spans_and_clashes(spark):
    text = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs = spark.createDataFrame([(1, text, 7, "g"), (2, "é" + text + "!", 8, "h"), (None, None, 9, "i")], "doc_id long, text string, n_bytes int, g string")
    got = {r["doc_id"]: r for r in drop_seen(docs).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 62)] and got[2]["n_removed"] == 62 and got[2]["g"] == "h"
    assert got[1]["spans"] == [] and got[None]["n_bytes"] == 0
    assert got[2]["kept_sha256"] == hashlib.sha256("é!".encode()).hexdigest()
    assert drop_seen(docs.limit(0)).collect() == []


def brute_phrases(rows, least, kept):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(lang, p[i : i + m]) for (lang, p), v in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v >= 80 * f[lang, p[i : i + m]]}
    best = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    for lang, rows_ in best.items():
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:kept], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "kept", "capacity", "flush"), [(30, 2000, 1 << 17, 1 << 22), (5, 50, 20, 1000), (30, 3, 5, 300)])
def test_collocations(spark, monkeypatch, least, kept, capacity, flush):
    """Few large summaries, and many small ones that are cut and merged often."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["The", "the", "Of", "a", "quick  fox", "é!", "x.", "\ty", "\n", "b;c", "new york", "12"]) for _ in range(rng.randint(0, 200))) if rng.random() < 0.9 else None, rng.choice(["en", "de", None, ""])) for _ in range(200)]
    rows += rows[:20]
    monkeypatch.setattr(collocations, "_FLUSH", flush)
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, n int, phrase string").repartition(6)
    assert sorted(map(tuple, mine_collocations(docs, least=least, kept=kept, capacity=capacity, deal=10_000 if capacity > 100 else 7).collect())) == brute_phrases(rows, least, kept)
    assert mine_collocations(docs.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [500, 8200])
def test_summary_keeps_the_frequent(capacity):
    """No hash of the threshold is lost, whatever the order; a capacity of four times mass by threshold never has to grow."""
    rng = np.random.default_rng(1)
    names = np.concatenate([np.repeat(np.arange(50, dtype=np.uint64), 30), rng.integers(1000, 10**9, 60_000).astype(np.uint64)])
    rng.shuffle(names)
    summary = Summary(capacity, 30)
    for part in np.array_split(names, 200):
        summary.add(*collocations.summed(part))
    found = summary.survivors()
    assert set(range(50)) <= set(found.tolist()) and 0 < summary.off < 30
    if capacity > 4 * len(names) / 30:
        assert summary.capacity == capacity and len(summary.names) <= 2 * capacity and summary.off <= len(names) / (capacity + 1)


def test_inertia():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = rng.integers(1, 25)
        a = rng.standard_normal((n, n))
        a = a + a.T
        if rng.random() < 0.5:
            np.fill_diagonal(a, 0)  # pivots of order two
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert inertia(a) == (values > 0).sum()


def test_components(spark):
    """Close, equal and zero eigenvalues; more wanted than there are."""
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    wanted = np.array([9, 9, 9, 5, 5 - 1e-6, 3, 2, 1, 1e-3, 1e-5] + [0] * 10, float)
    v = q * wanted @ q.T
    v = (v + v.T) / 2
    values, axes = components(spark, v, 12, room=4)
    assert np.allclose(values, wanted[:10], rtol=1e-9, atol=1e-12) and np.allclose(axes.T @ axes, np.eye(10), atol=1e-12)
    assert np.abs(v @ axes - axes * values).max() < 1e-11
    assert len(components(spark, np.zeros((3, 3)))[0]) == 0
    # far-off eigenvalues above a dense crowd, of which some are wanted
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    crowd = np.concatenate([[900, 130], 60 + np.sort(rng.random(62))[::-1] * 12])
    v = q * crowd @ q.T
    values, _ = components(spark, (v + v.T) / 2, 32)
    assert np.allclose(values, crowd[:32], rtol=1e-11)


def test_whitening(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40))
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)] + [(None, [float(c) for c in x[0]], "y"), (5, [float(c) for c in x[5]], "z")]
    used = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64) + 1_000_000
    bad = [(900, None, "a"), (901, [None] + [1.0] * 39, "b"), (902, [float("nan")] * 40, "c"), (903, [float("inf")] * 40, "d"), (904, [1.0], "e"), (905, [], "f")]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, whitened string").repartition(7)
    got = whiten(vectors).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, s = len(used), used.sum(0)
    centred = used - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = centred @ axes / np.sqrt(values)
    own = got[got.vec_id == 17].sort_values("component")
    assert np.allclose(np.abs(own.whitened), np.abs(want[17]), rtol=1e-7, atol=1e-9)
    assert set(own.deviation) == {sum((n * int(a) - int(b)) ** 2 for a, b in zip(used[17], s))} and set(got.n) == {n}
    assert np.allclose(own.explained, values / np.trace(centred.T @ centred / n), rtol=1e-9) and got.identity_error.max() < 1e-9
    assert len(got) == 32 * n and len(got[got.vec_id == 5]) == 64 and got.vec_id.isna().sum() == 32
    assert whiten(vectors.limit(0)).collect() == [] and whiten(vectors.filter("vec_id >= 900")).filter("vec_id <> 904").collect() == []


def test_deviation_beyond_a_long(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0**33, 5.0]), (3, [1.0, 2.0**20])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whiten(vectors).collect()}
    x = [[1_000_000, 1_000_064], [2**39 + 1_000_000, 1_000_320], [1_000_064, 2**26 + 1_000_000]]
    want = {i + 1: sum((3 * a - sum(r[k] for r in x)) ** 2 for k, a in enumerate(v)) for i, v in enumerate(x)}
    assert got == {k: v if v < 1 << 63 else None for k, v in want.items()}
