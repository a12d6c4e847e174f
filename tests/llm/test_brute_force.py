"""Operators against brute force on a generated fixture with copies, near copies, shared passages and labels."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from cyclespark.llm.lang_id import held_out, identify, train
from cyclespark.llm.license_rules import PHRASES, rules
from cyclespark.llm.license_scan import kept_detections, scan_licences
from cyclespark.llm.near_dedup import aligned, near_duplicates
from cyclespark.llm.packing import Capacities, plan
from cyclespark.llm.pieces import Pieces, best_states, combined
from cyclespark.llm.substring_dedup import drop_repeats
from cyclespark.llm.syncmers import fingerprint_documents
from cyclespark.llm.toxicity import score_toxicity

SYLLABLES = {"en": "the an er on th ing ed ou st".split(), "de": "der ein sch ung ver keit pf heit".split(), "fr": "eau oi ment les une tre qu ai".split()}


def made_docs(n=160, seed=11):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"passage{i}" for i in range(60))
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 220))]
        kind = i % 8
        if kind == 1 and len(words) > 20:
            words[10:10] = passage.split()
        if kind in (2, 3):
            _, copied, lang, _ = rng.choice(rows)
            words = copied.split(" ")
        if kind == 3:
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited" + str(rng.random())[2:6]
        if kind == 4:
            words = words[:12] * 6
        if kind == 5:
            words += "You are a worthless idiot and pathetic scum".split()
        if kind == 6:
            words += "Licensed under the Apache License, Version 2.0. All rights, reserved; cc-BY 4.0 general public license".split(" ")
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(5)


def insulting(rows):
    return [(k, int(bool({"worthless", "idiot", "pathetic", "scum"} & set(t.split())))) for k, t, *_ in rows]


def brute_substrings(rows, size=20):
    seen, out = set(), {}
    for key, text, *_ in sorted(rows):
        w = text.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [20, 3])
def test_substrings(docs, rows, size):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in drop_repeats(docs, size=size).collect()}
    assert got == brute_substrings(rows, size)


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(last[j + 1], now[-1]))
        last = now
    return last[-1]


def test_alignment():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 9)) if rng.random() < 0.5 else b.pop(rng.randrange(len(b))) if len(b) > 1 else None
        same = lcs(a, b)
        like = same / (len(a) + len(b) - same)
        for least in (0.8, 0.4):
            assert aligned(a, b, least) == pytest.approx(like if like >= least else 0)


def brute_groups(rows):
    shingles = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, t, *_ in rows for w in [t.split()]}
    parent = {k: k for k in shingles}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(shingles)
    text = {k: t.split() for k, t, *_ in rows}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if text[a] == text[b] or aligned(shingles[a], shingles[b], 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def test_near_duplicates(docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) and got == want


def test_licences(docs, rows):
    got = {r["doc_id"]: r for r in scan_licences(docs).collect()}
    for key, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES if words[i : i + len(phrase)] == list(phrase)]
        r = got[key]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert any("apache-2.0" in r["labels"] for r in got.values())


def test_rules_and_suppression():
    ordered = rules()
    assert len(ordered) > 250 and [r.priority for r in ordered] == sorted(r.priority for r in ordered)
    kept = kept_detections(b"licensed under the apache license, version 2.0", ordered)
    assert [r.label for _, _, r in kept] == ["apache-2.0"]
    assert [r.kind for _, _, r in kept_detections(b"spdx-license-identifier: mit", ordered)] == ["tag"]


def test_languages(docs):
    docs = docs.withColumn("held_out", held_out("doc_id", 5, 0))
    got = identify(docs, train(docs.filter("not held_out"))).filter("held_out").collect()
    assert got and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.9 * len(got)


def test_toxicity(spark, docs, rows):
    truth = dict(insulting(rows))
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    got = score_toxicity(docs, labels, ~held_out("doc_id", 4, 2)).withColumn("held_out", held_out("doc_id", 4, 2)).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in got)


def test_syncmers(docs, rows):
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    texts = {}
    for key, text, *_ in rows:
        assert texts.setdefault(text, got[key]["fingerprint"]) == got[key]["fingerprint"]
    long = [got[k] for k, t, *_ in rows if len(t.split()) > 60 and k % 8 in (0, 7)]
    assert all(r["near_edited"] > r["near_next"] for r in long)


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(100):
        size = rng.choice([8, 16, 30])
        histogram = {n: rng.randint(1, 9) for n in range(1, size + 1) if rng.random() < 0.5}
        room = []
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
            room.append(min(fits) - n if fits else size - n)
        steps, fill = plan(histogram, size), {}
        for n, total in histogram.items():
            own = sorted(s for s in steps if s[0] == n)
            for rank in range(total):
                s = max(x for x in own if x[1] <= rank)
                fill.setdefault(s[2] + rank - s[1], []).append((s[3], n))
        assert len(fill) == len(room)
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= size


def test_capacities():
    tree = Capacities(10)
    for c in (3, 7, 10):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 8)] == [3, 3, 7, 10]
    tree.set(10, False)
    assert tree.tightest(8) is None


def test_max_plus_scan():
    import numpy as np
    import public_tokenizers

    rng = np.random.default_rng(1)
    a, b, c = (rng.normal(size=s) for s in ((2, 3), (3, 4), (4, 2)))
    assert np.allclose(combined(combined(a, b), c), combined(a, combined(b, c)))
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(4)
    for _ in range(60):
        text = "".join(draw.choice("aeinrst  the.\n1é日😀x") for _ in range(draw.randint(1, 150)))
        whole, n, cut, parts = model.escaped(text), model.longest, draw.choice([17, 25, 64]), []
        for k in range((len(whole) - 1) // cut + 1):
            start = max(k * cut - n, 0)
            part = whole[start : (k + 1) * cut + n]
            parts.append((part, k * cut - start, min((k + 1) * cut - start, len(part))))
        states = best_states([model.matrix(*p) for p in parts])
        assert sum((model.trace(*p, i, j) for p, i, j in zip(parts, states, states[1:])), []) == model.encode(text)


def test_unigram_scores(tmp_path):
    """The same vocabulary read as a unigram model: the scan finds a path with the library's best score."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for k, p in enumerate(proto.pieces):
        p.score = -5 - (k * 7919 % 9973) / 999 if p.type == pb.ModelProto.SentencePiece.NORMAL else p.score
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model, library = Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("the worthless internationalisation of tests", "aaaa bb  cc", "Straße und Übung"):
        ours, theirs = model.encode(text), library.encode(text)
        assert sum(model.score.get(model.text[i], 0) for i in ours) == pytest.approx(sum(model.score.get(model.text[i], 0) for i in theirs), abs=1e-3)


def test_pipeline_stages(spark, tmp_path, docs, rows):
    """Each stage against brute force on what its predecessor kept."""
    truth = insulting(rows)
    spark.createDataFrame(truth, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        after = kept.collect()
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            assert ids == {k for k, y in truth if not y}
        if name == "quality":
            short = {k for k, r in before.items() if len(r["text"].split()) < 20}
            assert not ids & short and {k for k, r in before.items() if k % 8 in (0, 7) and len(r["text"].split()) >= 20} <= ids
        if name == "near_dedup":
            assert ids == set(brute_groups([(k, r["text"]) for k, r in before.items()]).values())
        if name == "substring_dedup":
            want = brute_substrings([(k, r["text"]) for k, r in before.items()])
            assert {r["doc_id"]: hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() for r in after} == {k: w[2] for k, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "packing":
            assert ids == set(before) and max(Counter(r["sequence_id"] for r in after).values()) > 1


def test_gates_let_all_matches_pass():
    wrapped = {
        "GNU General\nPublic License version 2": "gpl-2.0",
        "Creative\nCommons Attribution 4.0": "cc-by",
        "Attribution no-derivatives 4.0": "cc-by-nd",
        "the PSF license": "python-2.0",
        "SIL Open  Font\nLicense": "ofl-1.1",
        "Open Data Commons\nOpen Database License": "odbl",
        "Permission is hereby\ngranted, free of charge, to any person": "mit",
        "redistribution and use in source\nand  binary forms": "bsd",
        "placed in the public\ndomain, donated to the public\ndomain": "public-domain",
        "this program is free\nsoftware; you": "gpl",
        "do what the fuck you\nwant to public license": "wtfpl",
    }
    ordered = rules()
    for text, label in wrapped.items():
        low = text.lower().encode()
        assert label in {r.label for _, _, r in kept_detections(low, ordered)}, text
        assert all(all(g in low for g in r.gates) for r in ordered if r.pattern.search(low)), text
    assert [r.kind for _, _, r in kept_detections(b"released under the simplified bsd", ordered)] == ["grant"]
    assert not any(b" " in g for r in ordered for g in r.gates)


def test_packing_plan_is_best_fit():
    """Free room of all sequences as per-piece best fit leaves it, for few lengths with many copies."""
    import bisect

    rng = random.Random(8)
    cases = [(100, Counter({60: 2, 20: 2, 12: 3}))]
    cases += [(1024, Counter({rng.randint(1, 1024): rng.randint(1, 60) for _ in range(rng.randint(2, 9))})) for _ in range(100)]
    for size, histogram in cases:
        room = []
        for n in sorted(histogram.elements(), reverse=True):
            i = bisect.bisect_left(room, n)
            bisect.insort(room, (room.pop(i) if i < len(room) else size) - n)
        fill = Counter()
        for (n, rank, first, _), following in zip(steps := sorted(plan(dict(histogram), size)), [*steps[1:], (0, 0, 0, 0)]):
            for k in range((following[1] if following[0] == n else histogram[n]) - rank):
                fill[first + k] += n
        assert sorted(size - f for f in fill.values()) == room


def test_remembered_units_are_bounded_and_frequent_ones_stay(monkeypatch):
    import public_tokenizers

    from cyclespark.llm import pieces as module

    monkeypatch.setattr(module, "_MEMO", 50)
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = model.unit("▁often")
    for i in range(400):
        model.unit(f"▁seldom{i}")
        assert model.unit("▁often") == want
        assert "▁often" in model._memo or "▁often" in model._older
    assert len(model._memo) <= 50 and len(model._older) <= 50
