"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, mixed, span_hashes, stored, utf8, word_spans
from .components import components

WORDS, DRAWS, PICKS, LIKE = 5, 12, 2, 0.8
_TOP = np.uint64(2**64 - 1)


def _names(data, at) -> list[str]:
    """A name of 128 bits for each text's sequence of words."""
    starts, ends, before = word_spans(data, at)
    lanes = [span_hashes(span_hashes(data, starts, ends, lane), before[:-1], before[1:], lane).tolist() for lane in (0, 1)]
    return [f"{a:016x}{b:016x}" for a, b in zip(*lanes)]


def _shingles(data, at, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, and the place of the first of each text (one place more than texts)."""
    starts, ends, before = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    sizes = np.maximum(np.diff(before) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(sizes)])
    runs = np.repeat(before[:-1] - first[:-1], sizes) + np.arange(first[-1])
    return span_hashes(words, runs, runs + k), first


def _labelled(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each shingle hash mixed with its occurrence number in its text, so that all of a text differ."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
    out = np.empty_like(shingles)
    out[order] = mixed(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def order_minhash(labelled: np.ndarray, first: np.ndarray, draws: int, picks: int) -> np.ndarray:
    """Signatures, one row per text: for each draw the `picks` smallest labelled k-mers under its hash, in text order, hashed."""
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), draws), np.uint64)
    if not len(full):
        return out
    heads, owner = first[:-1][full], np.repeat(np.arange(len(full)), sizes[full])
    for draw in range(draws):
        h = mixed(labelled ^ mixed(np.array([draw + 1], np.uint64)))
        picked = np.full((len(full), picks), len(labelled), np.int64)
        for k in range(picks):
            low = np.minimum.reduceat(h, heads)
            at = np.flatnonzero((h == low[owner]) & (h != _TOP))
            who, where = np.unique(owner[at], return_index=True)
            picked[who, k] = at[where]
            h[at[where]] = _TOP
        picked.sort(axis=1)
        sig = np.zeros(len(full), np.uint64)
        for k in range(picks):
            some = picked[:, k] < len(labelled)
            sig[some] = mixed(sig[some] * np.uint64(0xC2B2AE3D27D4EB4F) + labelled[picked[some, k]])
        out[full, draw] = sig
    return out


def sketch(docs: DataFrame, key: str, text: str, k: int = WORDS, draws: int = DRAWS, picks: int = PICKS) -> DataFrame:
    """(key, node, n, signatures): node names the text's word sequence by 128 bits, n counts its runs of k words."""

    def run(inputs):
        for batch in batches(inputs, column=text):
            data, at = utf8(batch.column(text))
            shingles, first = _shingles(data, at, k)
            sig = order_minhash(_labelled(shingles, first), first, draws, picks).view(np.int64)
            nodes, sizes = _names(data, at), np.diff(first)
            cells = pa.array([row.tolist() if n else [] for row, n in zip(sig, sizes)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(nodes, pa.string()), pa.array(sizes), cells], names=[key, "node", "n", "signatures"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, node string, n long, signatures array<long>")


def aligned(a: list, b: list, like: float = LIKE) -> float:
    """Order-keeping likeness of two k-mer sequences if it is `like` or more, else 0.

    Likeness: k-mers matched by the best alignment, over all of both less the matched. Common ends are matched at once; a bound
    from the common multiset ends hopeless cases; the rest is the longest common subsequence, computed on bits within the band
    that an alignment of that likeness cannot leave.
    """
    total, n = len(a) + len(b), min(len(a), len(b))
    if not n:
        return 0.0
    need = math.ceil(like * total / (1 + like) - 1e-9)
    if n < need:
        return 0.0
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    a, b, ends = a[p : len(a) - q], b[p : len(b) - q], p + q
    band = total - 2 * need
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    spare = {x: m.bit_count() for x, m in places.items()}
    most = ends
    for x in b:
        if spare.get(x):
            spare[x] -= 1
            most += 1
    if most < need:
        return 0.0
    full = (1 << len(a)) - 1
    window, v = (1 << 2 * band + 1) - 1, full
    for j, x in enumerate(b):
        m = places.get(x, 0)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            v = ((v + (v & m)) | (v & ~m)) & full
    same = ends + len(a) - v.bit_count()
    return same / (total - same) if same >= need else 0.0


def verified(pairs: DataFrame, texts: DataFrame, k: int = WORDS, like: float = LIKE) -> DataFrame:
    """(a, b, like, common) for pairs (a, b) of nodes; texts has a text per node.

    like is 0 below the bound; common counts the labelled k-mers that both have.
    """

    def run(inputs):
        for batch in inputs:
            for part in batches([batch], rows=200):
                sides, sets = [], []
                for c in ("text", "text_b"):
                    shingles, first = _shingles(*utf8(part.column(c)), k)
                    own = _labelled(shingles, first)
                    sides.append([shingles[i:j].tolist() for i, j in zip(first[:-1], first[1:])])
                    sets.append([own[i:j] for i, j in zip(first[:-1], first[1:])])
                out = [aligned(x, y, like) for x, y in zip(*sides)]
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out, pa.float64()), pa.array(common, pa.int64())], names=["a", "b", "like", "common"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), "text"), "a")
    return both.select("a", "b", "text", "text_b").mapInArrow(run, "a string, b string, like double, common long")


def lone_kmers(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, lone): how many of a text's labelled k-mers stand in no other of these texts; nodes without any are missing."""

    def run(inputs):
        for batch in batches(inputs):
            shingles, first = _shingles(*utf8(batch.column("text")), k)
            own = _labelled(shingles, first)
            ids = np.array([int(x[:16], 16) for x in batch.column("node").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(ids, np.diff(first)).view(np.int64))], names=["x", "id"])

    marks = texts.select("node", "text").mapInArrow(run, "x long, id long")
    lone = marks.groupBy("x").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("lone"))
    ids = texts.select("node", F.conv(F.substring("node", 1, 16), 16, -10).cast("long").alias("id"))
    return ids.join(lone, "id").select("node", "lone")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", like: float = LIKE, k: int = WORDS) -> DataFrame:
    """One row per row of docs: key, copy_of (smallest key with the same words), class_id (smallest key of its group), n_spanning_links.

    Two texts are linked if the order-keeping likeness of their runs of k words is `like` or more (see aligned); groups are
    the connected components. Texts with the same words are copies and take part once. Candidates share an Order MinHash
    signature. Within a bucket of equal signatures, everything is first compared with the bucket's most ordinary text (the one
    with the smallest share of k-mers that stand in no other candidate); what isn't linked to it is then compared with the
    members of the bucket outside its own group. Pairs that have too few k-mers in common with any text to be alike are ruled
    out by their numbers. So each pair in a bucket is compared, ruled out, or already in one group, and no bucket is capped.

    n_spanning_links counts a text's verified links among the pairs compared to span the groups, not all its near copies: pairs
    already in one group aren't compared. Null texts are empty; all blank texts are copies of each other,
    and texts under k words have only copies. Null keys get the class of their copies, null where those have none. An empty
    table gives no rows. Only key and text are read; other columns don't matter.
    """
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    drawn, named = _classes(plain, like, k)
    return drawn.select("_key", "node").join(named, "node").select(F.col("_key").alias(key), "copy_of", "class_id", "n_spanning_links")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", like: float = LIKE, k: int = WORDS) -> DataFrame:
    """The rows of docs that stand for their group: one row each, with the smallest key (null last), see near_duplicates."""
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    _, named = _classes(plain, like, k)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "node")).alias("b"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*[c for c in docs.columns if c != text]).alias("_row"))
    kept = _rows_of(rows, best.select("b.node", "b.copy_of"))
    return kept.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.{c}") for c in docs.columns])


def _classes(plain: DataFrame, like: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The sketches (_key, node, ..), and for each node root, copy_of, class_id and n_spanning_links."""
    drawn = stored(sketch(plain, "_key", "text", k), "sketch")
    nodes = stored(drawn.groupBy("node").agg(F.min("_key").alias("copy_of"), F.first("n").alias("n"), F.first("signatures").alias("signatures")), "nodes")
    buckets = nodes.filter("n > 0").select("node", "n", F.posexplode("signatures").alias("draw", "sig"))
    shared = buckets.groupBy("draw", "sig").agg(F.count("*").alias("c")).filter("c > 1").select("draw", "sig")
    members = stored(buckets.join(shared, ["draw", "sig"]), "members")
    texts = stored(_texts_of(plain, nodes.join(members.select("node").distinct(), "node")), "texts")
    lone = stored(lone_kmers(texts, k), "lone")
    members = members.join(lone, "node", "left").na.fill(0, ["lone"]).filter(F.col("lone") <= (1 - like) * F.col("n") + 1e-9)
    members = stored(members.select("draw", "sig", "node", "n", "lone"), "members")
    centres = members.groupBy("draw", "sig").agg(F.min(F.struct(F.col("lone") / F.col("n"), "node")).alias("c"))
    centres = centres.select("draw", "sig", F.col("c.node").alias("a"))
    star = stored(members.join(centres, ["draw", "sig"]), "star")
    pairs = star.filter("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    checked = stored(verified(stored(pairs, "pairs"), texts, k, like), "checked")
    links = checked.filter("like > 0").select("a", "b")

    known = checked.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "like", "common")
    rows = star.join(known, (F.least("a", "node") == F.col("_a")) & (F.greatest("a", "node") == F.col("_b")), "left")
    group = stored(components(links), "groups").withColumnRenamed("node", "_n")
    rows = rows.join(group, F.col("node") == F.col("_n"), "left").select(
        "draw", "sig", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("like", F.lit(1.0)).alias("like"),
        F.coalesce("common", "n").alias("common"), (F.col("n") - F.coalesce("common", "n") - F.when(F.col("common").isNull(), 0).otherwise(F.col("lone"))).alias("rest"),
    )
    rows = stored(rows.join(nodes.select("node", "signatures"), "node"), "rows")
    x = rows.filter("like = 0").select("draw", "sig", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "root", "common", "rest", "signatures")])
    y = rows.select("draw", "sig", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "root", "common", "rest", "signatures")])
    # A pair that meets in several buckets is judged in the first of them only.
    first = F.array_position(F.zip_with("x_signatures", "y_signatures", lambda a, b: a == b), True) - 1 == F.col("draw")
    most = F.least("x_common", "y_common") + F.least("x_rest", "y_rest")
    possible = most * (1 + like) >= like * (F.col("x_n") + F.col("y_n")) - 1e-9
    more = x.join(y, ["draw", "sig"]).filter("x_root <> y_root").filter(possible).filter(first)
    more = more.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    extra = verified(stored(more, "pairs"), texts, k, like).filter("like > 0").select("a", "b")
    linked = stored(links.union(extra), "links")

    roots = components(linked)
    degree = linked.select(F.col("a").alias("node")).union(linked.select("b")).groupBy("node").agg(F.count("*").alias("n_spanning_links"))
    named = nodes.select("node", "copy_of").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    return drawn, stored(named.join(smallest, "root").select("node", "root", "copy_of", "class_id", F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links")), "classes")


def _rows_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of rows (_key, _text, ..) one for each of nodes (node, copy_of)."""

    def run(inputs):
        for batch in batches(inputs, column="_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_names(*utf8(batch.column("_text"))), pa.string())], names=[*batch.schema.names, "node"])

    schema = T.StructType([*rows.schema.fields, T.StructField("node", T.StringType())])
    wanted = nodes.select(F.col("node").alias("_n"), "copy_of")
    found = rows.mapInArrow(run, schema).join(wanted, (F.col("node") == F.col("_n")) & F.col("_key").eqNullSafe(F.col("copy_of")))
    return found.drop("_n", "copy_of").dropDuplicates(["node"])


def _texts_of(plain: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for nodes (node, copy_of), each text once."""
    return _rows_of(plain.select("_key", F.col("text").alias("_text")), nodes).select("node", F.col("_text").alias("text"))
