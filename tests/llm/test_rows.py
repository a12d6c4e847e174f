"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from cyclespark.llm.lang_id import identify, train
from cyclespark.llm.license_scan import scan_licences
from cyclespark.llm.near_dedup import near_duplicates, one_of_each_group
from cyclespark.llm.packing import pack_documents
from cyclespark.llm.pieces import decode_ids, encode_texts
from cyclespark.llm.quality import judge_quality
from cyclespark.llm.substring_dedup import drop_repeats
from cyclespark.llm.syncmers import fingerprint_documents
from cyclespark.llm.toxicity import score_toxicity
from cyclespark.llm.url_filter import judge_urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
CLASHES = "n_words long, n_base long, labels string, score double, predicted int, hits string, path string, host string, rule string, verdict string, kept string, length int, piece int, ids string, fingerprint string, n_chars string, lang_pred string, words int, node string, root string, _t string, n int"
ROWS = [
    (1, "All rights reserved. under the MIT License", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \t\n ", "fr", "a"),
    (5, LONG, "en", "b"),
    (5, LONG, "en", "b"),
    (6, "le chat é 😀 dort", "fr", "b"),
    (None, "no key here", "en", "a"),
    (None, None, None, None),
    (7, "the same text for two rows of one key", "en", "a"),
    (7, "the same text for two rows of one key", "en", "a"),
    (7, "another text of that key", "en", "a"),
    (8, "!!! 123 ???", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [r + (1, 1, "x", 0.5, 1, "h", "p", "h", "r", "v", "k", 3, 4, "i", "f", "c", "l", 9, "n", "r", "t", 2) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + CLASHES)


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


OPERATORS = {
    "licences": lambda d: scan_licences(d),
    "quality": lambda d: judge_quality(d),
    "languages": lambda d: identify(d, train(d)),
    "toxicity": lambda d: score_toxicity(d, d.select("doc_id", F.when(F.col("doc_id") > 5, 1).otherwise(0).alias("toxic")), F.lit(True)),
    "syncmers": lambda d: fingerprint_documents(d),
    "pieces": lambda d: decode_ids(encode_texts(d, MODEL), MODEL),
    "substrings": lambda d: drop_repeats(d),
    "near": lambda d: near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, name):
    assert OPERATORS[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing", "one"])
def test_empty_table(docs, name):
    more = {"packing": pack_documents, "one": one_of_each_group}
    assert (OPERATORS | more)[name](docs.limit(0)).collect() == []


def test_packing_rows(docs):
    got = pack_documents(docs).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)


def test_words_and_labels(docs):
    got = {r["doc_id"]: r for r in scan_licences(docs).collect() if r["doc_id"] in (1, 2, 3)}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (7, 1, 0, "reserved", "mit,reserved")
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[3]["score"] == 0


def test_languages(docs):
    got = rows_of(identify(docs, train(docs)).filter("doc_id in (2, 3, 4, 8)"), "doc_id", "lang_pred", "score")
    assert got == [(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (8, "und", 0.0)]
    assert {r[0] for r in identify(docs, train(docs.limit(0))).select("lang_pred").collect()} == {"und"}


def test_repeated_keys_and_substrings(docs):
    got = rows_of(drop_repeats(docs, size=5).filter("doc_id in (2, 5, 7)"), "doc_id", "n_words", "n_removed")
    assert got == [(2, 0, 0), (5, 30_000, 19_993), (5, 30_000, 19_993), (7, 5, 0), (7, 9, 0), (7, 9, 0)]


def test_groups(docs):
    got = rows_of(near_duplicates(docs), "doc_id", "copy_of", "class_id")
    assert [r for r in got if r[0] in (2, 3, 4)] == [(2, 2, 2), (3, 2, 2), (4, 2, 2)]
    kept = rows_of(one_of_each_group(docs), "doc_id")
    assert kept == [(1,), (2,), (5,), (6,), (7,), (7,), (8,), (None,)]


def test_round_trip(docs):
    got = decode_ids(encode_texts(docs, MODEL, giant=1000, chunk=300), MODEL).select("text", "ids", "decoded").collect()
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    for text, ids, decoded in got:
        assert ids == library.encode(text or "") and decoded == (text or "")


def test_columns_called_like_the_operators_own(spark):
    """Giant texts meet their ids by a name; a column called name, own or k is none of theirs."""
    rows = spark.createDataFrame([(1, LONG, "x", "y", 3), (2, None, None, None, None), (3, "a \x00 é \u2028 b", "x", "y", 3)], "doc_id long, text string, name string, own string, k int")
    got = decode_ids(encode_texts(rows, MODEL, giant=1000), MODEL).collect()
    assert {(r["doc_id"], r["name"], r["own"], r["k"], r["decoded"] == (r["text"] or "")) for r in got} == {(1, "x", "y", 3, True), (2, None, None, None, True), (3, "x", "y", 3, True)}
    odd = spark.createDataFrame([(None,), ([],), ([0, 1, 2],)], "ids array<int>")
    assert [r["decoded"] for r in decode_ids(odd, MODEL).collect()][:2] == [None, ""]


def test_letters_alone_make_words(spark):
    """Numeric signs are no letters; vowel signs stay in their words."""
    from cyclespark.llm.lang_id import count_words

    texts = spark.createDataFrame([(1, "½ ² Ⅷ ①", "en"), (2, "हिन्दी की किताब", "hi"), (3, "don't x2y", "en"), (4, "\u0301 \u0903", "hi")], "doc_id long, text string, lang string")
    assert rows_of(count_words(texts, "text", "lang"), "lang", "word", "n") == sorted([("en", "don", 1), ("en", "t", 1), ("en", "x", 1), ("en", "y", 1), *[("hi", w, 1) for w in "हिन्दी की किताब".split()]], key=repr)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(texts, train(texts)).collect()}
    assert got == {1: "und", 2: "hi", 3: "en", 4: "und"}


def test_edited_text(spark, docs):
    texts = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).filter("text <> 'another text of that key' or text is null")
    order = sorted(((r["doc_id"], r["text"] or "") for r in texts.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint_documents(texts).collect()}
    for k, (key, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]
        assert got[key]["n_chars"] == len(text) and got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == "" and got[3]["near_next"] == 1.0


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "block"), ("b.org", None, "block")], "host string, path string, action string")
    urls = ["http://A.org/xy?z", "http://q.a.org/y", "http://ba.org/x", "http://a.org", "no scheme", None, "", "ftp://u@B.ORG:8/é#f", "http://a.org/xy?z"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, None])], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert got == {
        0: ("a.org", "/xy", "a.org/x", "block"),
        1: ("q.a.org", "/y", "org/", "allow"),
        2: ("ba.org", "/x", "org/", "allow"),
        3: ("a.org", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("u@b.org:8", "/é", None, "allow"),
        8: ("a.org", "/xy", "a.org/x", "block"),
        9: ("", "", None, "allow"),
    }
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_language_counts_are_whole(spark):
    """A word counted in two languages keeps both counts, however few words the model holds at hand."""
    big = [" ".join(f"big{chr(97 + i)}{chr(97 + j)}" for j in range(26) for _ in range(9)) for i in range(20)]
    texts = [(t + " rare rare rare rare", "en") for t in big] + [("rare klein winzig", "de")]
    docs = spark.createDataFrame(texts, "text string, lang string")
    asked = spark.createDataFrame([(1, "rare"), (2, "klein"), (3, "bigzzzz"), (4, "bigaa klein winzig")], "doc_id long, text string")
    got = [rows_of(identify(asked, train(docs, max_words=n)), "doc_id", "lang_pred", "score") for n in (0, 3, 400_000)]
    assert got[0] == got[1] == got[2]
    words = {r["word"]: r["scores"] for r in train(docs, max_words=3)["words"].collect()}
    assert len(words) == 523
    assert words["rare"][1] > words["klein"][1] + 5 * 2**24


def test_stems_from_all_labels(spark, monkeypatch):
    """Stems are counted in all labelled texts, also where the classifier is fitted on few."""
    from cyclespark.llm import toxicity

    texts = spark.createDataFrame([(i, f"text{'abcdefgh'[i % 8]} " + ("grobulon" if i % 2 else "harmless")) for i in range(300)], "doc_id long, text string")
    seen, induce = [], toxicity.induce
    monkeypatch.setattr(toxicity, "induce", lambda *a: seen.extend(induce(*a)) or seen)
    score_toxicity(texts, texts.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True), sample=5)
    assert ("grobulon", 150, 0) in seen


def test_links_are_named_for_what_they_count(docs):
    got = near_duplicates(docs)
    assert "n_links" not in got.columns and "n_spanning_links" in got.columns


def test_ranges_of_keys_are_even(spark):
    """A far-off key, a key with many rows and many null keys: no range gets most rows, and the order stays."""
    from pyspark.sql import Window

    from cyclespark.llm.syncmers import with_next

    keys = [*range(300), 10**15, *[500] * 300, *[None] * 300]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "doc_id long, text string")
    seen = []
    got = with_next(df, ["text"], prepare=lambda x: seen.append(x) or x, ranges=64).select("text", "next_text").collect()
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert max(sizes) < 60 and sum(sizes) == len(keys)
    order = [r["text"] for r in df.withColumn("t", F.xxhash64("doc_id", "text")).orderBy(F.col("doc_id").desc_nulls_last(), "t").collect()]
    assert dict(map(tuple, got)) == dict(zip(order, [*order[1:], order[0]]))
