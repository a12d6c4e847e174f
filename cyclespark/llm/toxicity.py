"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, stored

_LETTERS = re.compile(r"[^\W\d_]+")

#: Hand-written lexicons, one voter each.
LEXICONS = {
    "en_insults": "idiot moron loser scum clown trash imbecile fool jerk bastard dumbass dimwit scumbag lowlife",
    "en_contempt": "worthless pathetic disgusting stupid useless filthy vile ugly hateful despicable repulsive",
    "en_threats": "kill hurt destroy strangle stab shoot",
    "en_profanity": "damn crap shit fuck fucking bitch asshole bollocks",
    "fr_insults": "idiot imbécile crétin abruti connard salaud ordure débile minable pourriture",
    "de_insults": "idiot trottel dummkopf abschaum versager arschloch schwachkopf widerlich wertlos erbärmlich",
    "es_insults": "idiota imbécil estúpido basura payaso asqueroso inútil cabrón gilipollas patético",
}
#: Pattern voters.
PATTERNS = {
    "second_person": r"\byou(?:'re| are| were)?\s+(?:\w+\s+){0,2}(?:idiots?|morons?|losers?|scum|trash|clowns?|stupid|pathetic|worthless|disgusting)\b",
    "this_insult": r"\b(?:this|that|what an?|such an?)\s+(?:idiot|moron|loser|scum|clown|trash)\b",
    "get_lost": r"\b(?:shut up|get lost|go to hell|drop dead)\b",
    "hate": r"\b(?:i|we|they)\s+(?:all\s+)?hate\s+(?:you|them|those)\b",
    "second_person_de": r"\b(?:du|ihr)\s+(?:\w+\s+)?(?:idiot|trottel|versager|abschaum)\w*",
    "second_person_fr": r"\b(?:espèce|bande)\s+d[e']\s*\w+",
    "second_person_es": r"\b(?:eres|sois)\s+(?:un[ao]?\s+)?(?:idiota|basura|payaso|estúpid)\w*",
}
STEMS, OFTEN = (4, 5, 6, 7), (2, 3)


def _beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def _stems(words: set[str]) -> list[str]:
    """Whole words, beginnings of longer ones (marked by *), and beginnings of several words (by their number, too)."""
    n = Counter(b for w in words for b in _beginnings(w))
    return [*words, *n, *(f"{b}{k}" for b, m in n.items() for k in OFTEN if m >= k)]


@dataclass
class Model:
    stems: dict[str, int] = field(default_factory=dict)  # induced stems and their feature numbers
    voters: int = 0  # the first so many features vote
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # the last one is the constant


def induce(sample: DataFrame, text: str, voters: int, features: int) -> list[tuple[str, int, int]]:
    """The stems of (text, toxic) that speak for toxicity, best first: (stem, toxic texts, clean texts)."""

    def count(inputs):
        seen: Counter = Counter()
        n = [0, 0]
        for batch in batches(inputs, column=text):
            for t, y in zip(batch.column(text).to_pylist(), batch.column("toxic").to_pylist()):
                n[y] += 1
                seen.update([(s, y) for s in _stems(set(_LETTERS.findall(t.lower())))] if t else [])
                if len(seen) > 1_500_000:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen | Counter({("", 0): n[0], ("", 1): n[1]}))

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["stem", "y", "n"])

    per = sample.mapInArrow(count, "stem string, y int, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    per = stored(per, "stems")
    size = {r[0]: (r[1], r[2]) for r in per.filter("stem = ''").collect()}.get("", (0, 0))
    if not all(size):
        return []
    odds = F.log((F.col("pos") + 0.5) / (size[0] + 1)) - F.log((F.col("neg") + 0.5) / (size[1] + 1))
    # three standard errors below the log odds: stems that a few toxic texts share by chance stay out
    sure = F.col("odds") - 3 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    told = per.filter("stem <> '' and pos >= 4").withColumn("odds", odds).filter(sure > 0.5)
    best = told.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "stem").limit(features)
    return [(r[0], r[1], r[2]) for r in best.select("stem", "pos", "neg").collect()]


def with_features(docs: DataFrame, text: str, stems: list[str], with_text: bool = False) -> DataFrame:
    """docs (without the text) with hits: the numbers of the lexicons, patterns and stems found in the whole text, in order."""
    own = [c for c in docs.columns if c != "hits" and (with_text or c != text)]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("hits", T.ArrayType(T.IntegerType()))])
    of_word: dict[str, list[int]] = {}
    for k, words in enumerate(LEXICONS.values()):
        for w in words.split():
            of_word.setdefault(w, []).append(k)
    base = len(LEXICONS) + len(PATTERNS)
    of_stem: dict[str, list[tuple[int, int]]] = {}
    for k, s in enumerate(stems):
        name, _, least = s.partition("*")
        of_stem.setdefault(name + "*" * ("*" in s), []).append((int(least or 1), base + k))
    sent = docs.sparkSession.sparkContext.broadcast((of_word, of_stem))

    def find(inputs):
        words_of, stems_of = sent.value
        patterns = [re.compile(p) for p in PATTERNS.values()]
        gates = [("you",), ("idiot", "moron", "loser", "scum", "clown", "trash"), ("shut", "get lost", "hell", "drop dead"), ("hate",), ("du ", "ihr "), ("espèce", "bande"), ("eres", "sois")]
        quiet: set[str] = set()
        for batch in batches(inputs, column=text):
            out = []
            for t in batch.column(text).to_pylist():
                hits: set[int] = set()
                n: Counter = Counter()
                low = (t or "").lower()
                for w in set(_LETTERS.findall(low)) - quiet:
                    own_hits = words_of.get(w, [])
                    more = [s for s in (w, *_beginnings(w)) if s in stems_of]
                    hits.update(own_hits)
                    n.update(more)
                    if not own_hits and not more:
                        quiet.add(w)
                hits.update(feature for s, m in n.items() for least, feature in stems_of[s] if m >= least)
                for k, (pattern, gate) in enumerate(zip(patterns, gates)):
                    if any(g in low for g in gate) and pattern.search(low):
                        hits.add(len(LEXICONS) + k)
                out.append(sorted(hits))
            if len(quiet) > 1_000_000:
                quiet = set()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*dict.fromkeys([*own, text])).mapInArrow(find, schema)


def label_model(votes: DataFrame, voters: int, rounds: int = 6) -> dict:
    """Accuracies and correlations of the voters, from all votes.

    votes: hits (features below `voters` vote), toxic (0, 1 or null: the human label, a voter of its own that abstains on most
    rows), n (rows with that pattern). A text is toxic with probability prior; a voter fires with probability fires[1] on toxic
    and fires[0] on clean texts. Expectation and maximisation take turns, each a pass over the distinct patterns, from which
    only sums come back. Then the correlations of pairs given the class are estimated; a voter's evidence counts
    1 / (1 + the sum of its positive correlations), so that groups of voters that repeat each other don't outvote the rest.
    """
    state = {"prior": 0.1, "fires": np.stack([np.full(voters, 0.002), np.full(voters, 0.05)]), "human": np.array([0.02, 0.9]), "share": np.ones(voters)}
    sc = votes.sparkSession.sparkContext

    def expected(pairs: bool):
        sent = sc.broadcast(state)

        def run(inputs):
            total = np.zeros((2, 3)), np.zeros((2, voters)), np.zeros((2, voters, voters)) if pairs else np.zeros((2, 0))
            for batch in inputs:
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                x, post = posterior(batch.column("hits").to_pylist(), batch.column("toxic").to_pylist(), sent.value)
                human = np.array([-1 if y is None else y for y in batch.column("toxic").to_pylist()])
                for c, p in enumerate((1 - post, post)):
                    w = p * n
                    total[0][c] += w.sum(), w[human >= 0].sum(), w[human == 1].sum()
                    total[1][c] += w @ x
                    if pairs:
                        total[2][c] += (x * w[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([[*total[0].ravel(), *total[1].ravel(), *total[2].ravel()]], pa.list_(pa.float64()))], names=["s"])

        got = np.sum([np.array(r[0]) for r in votes.mapInArrow(run, "s array<double>").toLocalIterator()], axis=0)
        return got[:6].reshape(2, 3), got[6 : 6 + 2 * voters].reshape(2, voters), got[6 + 2 * voters :].reshape(2, voters, voters) if pairs else None

    for k in range(rounds):
        size, fired, both = expected(k == rounds - 1)
        rows = np.maximum(size[:, :1], 1e-9)
        state = {
            "prior": float(np.clip(size[1, 0] / max(size[:, 0].sum(), 1e-9), 1e-4, 0.5)),
            "fires": np.clip((fired + [[0.01], [0.5]]) / (rows + [[20.0], [20.0]]), 1e-6, 0.999),
            "human": np.clip((size[:, 2] + [0.02, 0.98]) / (size[:, 1] + 1), 0.01, 0.99),
            "share": state["share"],
        }
        if both is not None:
            rate = both / rows[:, :, None]
            p = fired / rows
            spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
            tied = (rate - p[:, :, None] * p[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
            tied = np.clip((tied * size[:, :1, None]).sum(0) / max(size[:, 0].sum(), 1e-9), 0, 1)
            np.fill_diagonal(tied, 0)
            state["share"] = 1 / (1 + tied.sum(1))
            state["correlations"] = tied
    return state


def posterior(hits: list, human: list, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """The votes as a matrix, and each row's probability to be toxic."""
    voters = state["fires"].shape[1]
    x = np.zeros((len(hits), voters))
    for k, own in enumerate(hits):
        x[k, [h for h in own if h < voters]] = 1
    on, off = np.log(state["fires"]), np.log1p(-state["fires"])
    z = np.log(state["prior"] / (1 - state["prior"])) + (x * state["share"]) @ (on[1] - on[0]) + ((1 - x) * state["share"]) @ (off[1] - off[0])
    y = np.array([-1 if v is None else v for v in human])
    says = np.log(state["human"][1] / state["human"][0]), np.log((1 - state["human"][1]) / (1 - state["human"][0]))
    z = z + np.where(y == 1, says[0], np.where(y == 0, says[1], 0))
    return x, 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(hits: list, target: np.ndarray, features: int, steps: int = 300, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic regression on presence of features; the last weight is the constant."""
    x = np.zeros((len(hits), features + 1), np.float32)
    x[:, -1] = 1
    for k, own in enumerate(hits):
        x[k, own] = 1
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - target) / len(x) + ridge / len(x) * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", sample: int = 20_000, voters: int = 64, features: int = 600, threshold: float = 0.3, with_text: bool = False
) -> DataFrame:
    """docs (without the text, unless with_text) with score (0 to 1) and predicted (1 from `threshold` on).

    labels (key, toxic) are learnt from only for rows that `learn` (a condition on the key) allows. Stems are induced from the
    counts of all of them; at most `sample` labelled rows, those with the smallest hash of their key, serve to fit the
    classifier; the label model sees the votes on all of docs. Voters are the lexicons, the patterns and the best `voters` induced stems; the classifier's features
    are up to `features` stems besides. Inputs of a score are found in the text alone.

    Null and empty texts have no hits and get the constant's score. Without labels of both kinds no stem is induced and the
    label model rests on the lexicons and patterns. Conflicting labels of a key count as toxic; null labels are none. Repeated
    rows are scored one by one; an empty table gives no rows. Columns called like the new ones are replaced.
    """
    new = ["score", "predicted"]
    own = [c for c in docs.columns if c not in (*new, text, "hits")]
    known = labels.filter(learn & F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "labels")
    chosen = F.broadcast(known.orderBy(F.xxhash64("_key"), "_key").limit(sample))  # at most `sample` rows of two numbers
    induced = induce(docs.join(known, F.col(key) == F.col("_key")).select(text, "toxic"), text, voters, features)
    stems = [s for s, _, _ in induced]
    base = len(LEXICONS) + len(PATTERNS)
    n_voters, n_features = base + min(voters, len(stems)), base + len(stems)
    found = stored(with_features(docs.select(*own, text), text, stems), "votes")
    lean = found.select(F.col(key).alias("_k"), "hits", F.filter("hits", lambda h: h < n_voters).alias("_v"))
    labelled = lean.join(known, F.col("_k") == F.col("_key"), "left")
    patterns = stored(labelled.groupBy(F.col("_v").alias("hits"), "toxic").agg(F.count("*").alias("n")), "patterns")
    state = label_model(patterns, n_voters)
    rows = lean.join(chosen, F.col("_k") == F.col("_key")).select("_k", "hits", "toxic").orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = rows.collect() or found.select("hits", F.lit(None).cast("int").alias("toxic")).limit(sample).collect()
    hits = [r["hits"] for r in rows]
    _, target = posterior(hits, [r["toxic"] for r in rows], state)
    weights = fit_linear(hits, target, n_features) if rows else np.zeros(n_features + 1)
    array = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    z = F.aggregate("hits", F.lit(float(weights[-1])), lambda a, h: a + F.get(array, h))
    score = 1 / (1 + F.exp(-z))
    if with_text:  # found again rather than joined or stored with the texts
        own = [c for c in docs.columns if c not in (*new, "hits")]
        found = with_features(docs.select(*own), text, stems, with_text=True)
    return found.select(*own, score.alias("score")).select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
