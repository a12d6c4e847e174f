"""Language identification: known words first, shorter and shorter character n-grams for unseen ones."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, stored

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SIZES = (3, 2, 1)
UNKNOWN = "und"
SCALE = 2**24  # scores are whole numbers of this part of a unit
_FLUSH = 300_000  # words that a task gathers before it hands on their counts
_MEMO = 400_000  # tokens whose scores a worker remembers


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over the whole texts of docs; words are runs of letters and the marks after them, lower-cased."""

    def flush(counts: dict[str, Counter]):
        rows = {"lang": [], "word": [], "n": []}
        for name, tokens in counts.items():
            words: Counter = Counter()
            for token, n in tokens.items():
                if token.isalpha():
                    words[token] += n
                else:
                    for word in _LETTERS.findall(token):
                        words[word] += n
            rows["lang"] += [name] * len(words)
            rows["word"] += words.keys()
            rows["n"] += words.values()
        return pa.RecordBatch.from_arrays([pa.array(rows["lang"], pa.string()), pa.array(rows["word"], pa.string()), pa.array(rows["n"], pa.int64())], names=list(rows))

    def count(inputs):
        counts: dict[str, Counter] = {}
        for batch in batches(inputs, column=text):
            for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist()):
                counts.setdefault(name, Counter()).update(t.lower().split())
            if sum(map(len, counts.values())) > _FLUSH:
                yield flush(counts)
                counts = {}
        if counts:
            yield flush(counts)

    parts = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
    return parts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, size, gram, n): the character n-grams of every counted word, ^ and $ at its ends, n times each."""

    def count(inputs):
        for batch in inputs:
            langs = np.array(batch.column("lang").to_pylist(), object)
            ns = batch.column("n").to_numpy(zero_copy_only=False)
            marked = ["^" + w + "$" for w in batch.column("word").to_pylist()]
            for name in dict.fromkeys(langs):
                own = np.flatnonzero(langs == name)
                codes = np.frombuffer("".join([marked[i] for i in own]).encode("utf-32-le"), np.uint32).astype(np.int64)
                sizes = np.array([len(marked[i]) for i in own])
                stops = np.repeat(np.cumsum(sizes), sizes)
                weight = np.repeat(ns[own], sizes)
                for size in SIZES:  # up to three code points of 21 bits fit into one number
                    at = np.flatnonzero(np.arange(len(codes)) + size <= stops)
                    packed = np.zeros(len(at), np.int64)
                    for k in range(size):
                        packed = packed << 21 | codes[at + k]
                    found, which = np.unique(packed, return_inverse=True)
                    total = np.bincount(which, weights=weight[at]).astype(np.int64)
                    text = ["".join(chr(int(x) >> 21 * (size - 1 - k) & 0x1FFFFF) for k in range(size)) for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(text), pa.string()), pa.array([size] * len(text), pa.int32()), pa.array(text, pa.string()), pa.array(total)], names=["lang", "size", "gram", "n"])

    return words.mapInArrow(count, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, keys: list[str], totals: dict[str, int]) -> DataFrame:
    """(keys.., total, scores): a row per word or n-gram, with whole-number scores for all languages, by name."""
    own = [F.sum(F.when(F.col("lang") == name, F.col("n"))).alias(f"n{i}") for i, name in enumerate(sorted(totals))]
    scores = [F.round((F.log(F.coalesce(F.col(f"n{i}"), F.lit(0.5))) - math.log(totals[name])) * SCALE).cast("long") for i, name in enumerate(sorted(totals))]
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"), *own).select(*keys, "total", F.array(*scores).alias("scores"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 400_000) -> dict:
    """Log frequencies per language of all words and n-grams, in tables; nothing that was counted is left out.

    Each word and n-gram has the counts of all languages; a language that lacks it gets the log of half a count. `head` holds
    the most frequent words again, max_words at most, to be sent to every task: it decides where a word's scores are looked up,
    not which they are. Without labelled texts the model has no languages.
    """
    counts = stored(count_words(docs, text, lang), "words")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    model = {"langs": langs, "words": None, "grams": None, "head": ({}, np.zeros((0, len(langs)), np.int64))}
    if not langs:
        return model
    model["words"] = stored(_table(counts, ["word"], totals), "known")
    grams = stored(count_grams(counts), "grams")
    of_size = {size: {x: 1 for x in langs} for size in SIZES}
    for r in grams.groupBy("lang", "size").agg(F.sum("n")).collect():
        of_size[r[1]][r[0]] = r[2]
    sizes = [_table(grams.filter(F.col("size") == size), ["size", "gram"], of_size[size]) for size in SIZES]
    model["grams"] = stored(reduce(DataFrame.unionByName, sizes), "grams")
    least, upto = None, 0
    for total, rows in sorted(map(tuple, model["words"].groupBy("total").agg(F.count("*")).collect()), reverse=True):
        upto += rows
        if upto > max_words:
            break
        least = total
    if least is not None:
        head = model["words"].filter(F.col("total") >= least).select("word", "scores").toArrow().combine_chunks()
        rows = np.array(head.column("scores").to_pylist(), np.int64).reshape(-1, len(langs))
        model["head"] = ({w: i for i, w in enumerate(head.column("word").to_pylist())}, rows)
    return model


class Scorer(dict):
    """Token -> row of its summed scores and number of words; remembers at most _MEMO tokens.

    Words outside the head add nothing to the scores; `others` has those of each row that has any.
    """

    def __init__(self, head: tuple[dict[str, int], np.ndarray]):
        super().__init__()
        self.place, self.scores = head
        self.rows = np.zeros((1024, self.scores.shape[1] + 1), np.int64)
        self.others: dict[int, list[str]] = {}

    def __missing__(self, token: str) -> int:
        row = len(self)
        if row == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        own = self.rows[row]
        own[:] = 0
        for word in (token,) if token.isalpha() else _LETTERS.findall(token):
            at = self.place.get(word)
            if at is None:
                self.others.setdefault(row, []).append(word)
            else:
                own[:-1] += self.scores[at]
            own[-1] += 1
        self[token] = row
        return row


def word_scores(words: DataFrame, model: dict) -> DataFrame:
    """(word, scores) of distinct words: those of a known word, else the mean over its longest n-grams that are known."""
    n = len(model["langs"])
    found = stored(words.join(model["words"].select("word", "scores"), "word", "left"), "looked_up")
    unseen = found.filter("scores is null").select("word", F.concat(F.lit("^"), "word", F.lit("$")).alias("_m"))
    of_size = [F.when(F.length("_m") >= size, F.transform(F.sequence(F.lit(1), F.length("_m") - size + 1), lambda i, size=size: F.struct(F.lit(size).alias("size"), F.substring("_m", i, size).alias("gram")))) for size in SIZES]
    parts = unseen.select("word", F.explode(F.flatten(F.array_compact(F.array(*of_size)))).alias("g")).select("word", "g.size", "g.gram")
    sums = [F.sum(F.get("scores", F.lit(i))).alias(f"s{i}") for i in range(n)]
    per = parts.join(model["grams"], ["size", "gram"]).groupBy("word", "size").agg(F.count("*").alias("c"), *sums)
    means = F.array(*[F.expr(f"s{i} div c") for i in range(n)])
    best = per.groupBy("word").agg(F.max(F.struct("size", means.alias("scores"))).alias("b"))  # one row per word and size
    return found.filter("scores is not null").unionByName(best.select("word", "b.scores"))


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs (without the text) with lang_pred and score.

    A text's score for a language is the mean of its words': the log frequency of a known word (of half a count where only
    other languages have it), else the mean over its longest n-grams that the model has. score is the best language's share
    after a softmax over the mean times the number of words, 20 at most. Equal scores go to the first language by name. Null
    texts and texts without a letter are 'und' with score 0, and so are all if the model has no languages. Columns called like
    the new ones are replaced; repeated rows are judged one by one; an empty table gives no rows.

    Scores of the model's head are added up where a text is read. Its other words leave as rows (text, word, times); each
    different word is looked up once in the model's tables, and the sums come back to the texts by joins. Scores are whole
    numbers, so that sums don't depend on the order of rows.
    """
    own, langs = [c for c in docs.columns if c not in (text, "lang_pred", "score")], model["langs"]
    if not langs:
        return docs.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model["head"])

    def score(inputs):
        scorer = Scorer(sent.value)
        for batch in batches(inputs, column="_text"):
            if len(scorer) > _MEMO:
                scorer = Scorer(sent.value)
            rows = [[scorer[w] for w in t.lower().split()] if t else [] for t in batch.column("_text").to_pylist()]
            sizes = np.array([len(r) for r in rows])
            total = np.zeros((len(rows), len(langs) + 1), np.int64)
            full = np.flatnonzero(sizes)
            if len(full):
                flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
                total[full] = np.add.reduceat(scorer.rows[flat], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
            others = [Counter(w for i in r if i in scorer.others for w in scorer.others[i]) for r in rows]
            cells = [pa.array(total[:, :-1].tolist(), pa.list_(pa.int64())), pa.array(total[:, -1])]
            cells += [pa.array([list(o) for o in others], pa.list_(pa.string())), pa.array([list(o.values()) for o in others], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_own"), *cells], names=["_id", "_own", "_sums", "_n", "_words", "_times"])

    plain = docs.select(F.monotonically_increasing_id().alias("_id"), F.struct(*own).alias("_own"), F.col(text).alias("_text"))
    schema = T.StructType([*plain.schema.fields[:2], *T._parse_datatype_string("_sums array<long>, _n long, _words array<string>, _times array<long>").fields])
    base = stored(plain.mapInArrow(score, schema), "scored")  # the ids hold from here on
    rest = base.select("_id", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_id", F.col("w._words").alias("word"), F.col("w._times").alias("n"))
    known = stored(word_scores(rest.select("word").distinct(), model), "word_scores")
    more = rest.join(known, "word").groupBy("_id").agg(*[F.sum(F.get("scores", F.lit(i)) * F.col("n")).alias(f"_m{i}") for i in range(len(langs))])
    means = [(F.get("_sums", F.lit(i)) + F.coalesce(F.col(f"_m{i}"), F.lit(0))) / (F.col("_n") * F.lit(SCALE)) for i in range(len(langs))]
    judged = base.select("_id", "_own", "_sums", "_n").join(more, "_id", "left").select("_own", "_n", F.when(F.col("_n") > 0, F.array(*means)).alias("_mean"))
    judged = judged.withColumn("_best", F.array_max("_mean"))
    names = F.array(*[F.lit(x) for x in langs])
    spread = F.aggregate("_mean", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("_best")) * F.least(F.col("_n"), F.lit(20))))
    return judged.select(
        *[F.col("_own")[c].alias(c) for c in own],
        F.when(F.col("_n") > 0, F.get(names, (F.array_position("_mean", F.col("_best")) - 1).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_n") > 0, 1 / spread).otherwise(0.0).alias("score"),
    )


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key, written as text, leaves `part`; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))
