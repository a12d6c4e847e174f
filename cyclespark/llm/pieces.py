"""SentencePiece encoding and decoding as a max-plus scan.

A segmentation is a path over pieces. Its score adds the pieces' scores (unigram models), or is 0 if each two neighbours stay
apart under the model's merges and minus infinity if not (BPE models: the one path of score 0 is what merging gives). The state
at a place is the piece that ends at it or reaches over it. Giant texts are cut into chunks; each chunk yields the matrix of
best scores from the states at its start to those at its end; matrices are combined by max-plus products, which are
associative; with the best states at all cuts known, each chunk is traced back on its own.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, stored

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CUT = re.compile(f"[^{SPACE}]{SPACE}")
#: Units that a worker remembers in each of two generations, and their longest length; pairs of pieces that it remembers.
_MEMO, _LONG, _PAIRS = 100_000, 40, 200_000


class Pieces:
    """The vocabulary of a model file, and paths over it."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        self.prefix, self.merges = spec.add_dummy_prefix, model.trainer_spec.model_type == pb.TrainerSpec.BPE
        kinds = pb.ModelProto.SentencePiece
        self.text = [p.piece for p in model.pieces]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.is_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.pieces = np.array(["" if i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.text)], object)
        self.odd = np.array([i in self.is_byte for i in range(len(self.text))])
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.score = {p: model.pieces[i].score for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.poor = min(self.score.values()) - 10  # of a character that no piece has
        #: No piece goes on with a space after another character: texts fall into units at such places.
        self.units = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self._apart: dict[tuple[str, str], bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self.stable = {p for p in self.id if not self.merges or len(p) == 1 or self.merged(p) == [p]}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether both pieces can be neighbours."""
        if not self.merges:
            return True
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            found = self._apart[left, right] = self.merged(left + right) == [left, right]
        return found

    def piece(self, text: str) -> bool:
        """Whether a text can be a piece of a path: a character, or a piece that merging its characters reaches."""
        return len(text) == 1 or text in self.stable

    def weight(self, piece: str) -> float:
        return 0.0 if self.merges else self.score.get(piece, self.poor)

    def cuts_before(self, text: str, at: int) -> bool:
        """Whether every path has a cut at that place."""
        return self.units and 0 < at < len(text) and text[at] == SPACE and text[at - 1] != SPACE

    def forward(self, text: str, begin: int, last: str, stop: int) -> tuple[list, list]:
        """For each place from begin to stop: best score (None: no path) and start of the last piece, after piece `last`.

        `last` ends at begin. Under merges at most one piece can end a path at a place, so the first found is taken.
        """
        score, start, before = [None] * (stop - begin + 1), [0] * (stop - begin + 1), [""] * (stop - begin + 1)
        score[0], start[0], before[0] = 0.0, begin - len(last), last
        known, apart, merges, units, longest = self.stable, self._apart, self.merges, self.units, self.longest
        for x in range(begin + 1, stop + 1):
            best = None
            for s in range(x - longest if x - longest > begin else begin, x):
                came = score[s - begin]
                if came is None:
                    continue
                piece = text[s:x]
                if piece not in known and x - s > 1:
                    continue
                left = before[s - begin]
                if merges and left and not (units and piece[0] == SPACE and left[-1] != SPACE):
                    free = apart.get((left, piece))
                    if not (self.apart(left, piece) if free is None else free):
                        continue
                if not merges:
                    came += self.score.get(piece, self.poor)
                if best is None or came > best:
                    best, score[x - begin], start[x - begin], before[x - begin] = came, came, s, piece
                    if merges:
                        break
        return score, start

    def back(self, text: str, start: list, begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(text[start[end - begin] : end])
            end = start[end - begin]
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            found = self.id.get(p)
            if found is not None:
                out.append(found)
            else:
                out += [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]
        return out

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a unit. Units met again while a generation fills up pass into the next; the others are forgotten."""
        found = self._memo.get(text)
        if found is None:
            found = self._older.get(text)
            if found is None:
                found = tuple(self.ids_of(self.back(text, self.forward(text, 0, "", len(text))[1], 0, len(text))))
            if len(text) <= _LONG:
                if len(self._memo) >= _MEMO:
                    self._older, self._memo = self._memo, {}
                self._memo[text] = found
        return found

    def escaped(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        text = self.escaped(text)
        known = self._memo.get
        for u in _UNIT.findall(text) if self.units else [text]:
            out += known(u) or self.unit(u)
        return out

    def decode(self, ids: np.ndarray) -> str:
        out, at = [], 0
        odd = np.flatnonzero(self.odd[ids])
        for run in np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1) if len(odd) else []:
            out += self.pieces[ids[at : run[0]]].tolist()
            out.append(bytes(self.is_byte[i] for i in ids[run].tolist()).decode(errors="replace"))
            at = run[-1] + 1
        text = "".join(out + self.pieces[ids[at:]].tolist())
        return text[1:] if self.prefix and text.startswith(" ") else text

    # Chunks. A chunk is text[begin:stop] of an escaped text, given with up to `longest` characters on either side.

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces (start, end), relative to `at`, that end there or reach over it."""
        if at == 0:
            return [(0, 0)]
        if at >= len(text) or self.cuts_before(text, at):
            return [(0, 0)]  # nothing reaches over, and what came before doesn't matter
        n = self.longest
        found = [(s - at, e - at) for s in range(max(0, at - n), at) for e in range(at, min(len(text), s + n) + 1) if self.piece(text[s:e])]
        return [(s, e) for s, e in found if not any(self.cuts_before(text, at + k) for k in range(s + 1, e))]

    def _ways(self, text: str, begin: int, stop: int, state: tuple[int, int]):
        return begin + state[1], text[begin + state[0] : begin + state[1]]

    def cuts(self, text: str, begin: int, stop: int) -> tuple[int, int] | None:
        """The first and the last place within begin..stop that every path cuts, if there are any."""
        found = [m.end() - 1 for m in _CUT.finditer(text, max(begin, 0), stop + 1)] if self.units else []
        found = [x for x in found if begin < x < stop]
        return (found[0], found[-1]) if found else None

    def interior(self, text: str) -> float:
        """Best score of a text that starts and ends at cuts."""
        return 0.0 if self.merges else sum(self.forward(u, 0, "", len(u))[0][-1] for u in _UNIT.findall(text))

    def matrix(self, text: str, begin: int, stop: int) -> np.ndarray:
        """Best scores from each state at begin to each at stop; minus infinity where no path leads.

        Paths meet at cuts: from the first to the last one the matrix is a single score.
        """
        cuts = self.cuts(text, begin, stop)
        if cuts:
            left = self._matrix(text[: cuts[0]], begin, cuts[0])
            right = self._matrix(text[cuts[1] :], 0, stop - cuts[1])
            return combined(left + self.interior(text[cuts[0] : cuts[1]]), right)
        return self._matrix(text, begin, stop)

    def _matrix(self, text: str, begin: int, stop: int) -> np.ndarray:
        ins, outs = self.states(text, begin), self.states(text, stop)
        m = np.full((len(ins), len(outs)), -np.inf)
        for i, state in enumerate(ins):
            at, last = self._ways(text, begin, stop, state)
            if at > stop or (at == stop and outs != [(0, 0)]):  # the piece reaches over the whole chunk, or to its end
                for j, (s, e) in enumerate(outs):
                    if stop + e == at and stop + s == begin + state[0]:
                        m[i, j] = 0.0
                continue
            score, start = self.forward(text, at, last, stop)
            for j, (s, e) in enumerate(outs):
                if stop + s < at or score[stop + s - at] is None:
                    continue
                came = score[stop + s - at]
                if (s, e) == (0, 0):
                    m[i, j] = came
                else:
                    before = last if stop + s == at else text[start[stop + s - at] : stop + s]
                    piece = text[stop + s : stop + e]
                    if not before or self.cuts_before(text, stop + s) or self.apart(before, piece):
                        m[i, j] = came + self.weight(piece)
        return m

    def trace(self, text: str, begin: int, stop: int, first: int, last: int) -> list[int]:
        """Ids of the pieces that start in the chunk, between the given states at its start and end."""
        cuts = self.cuts(text, begin, stop)
        if not cuts:
            return self._trace(text, begin, stop, first, last)
        out = self._trace(text[: cuts[0]], begin, cuts[0], first, 0)
        for u in _UNIT.findall(text[cuts[0] : cuts[1]]):
            out += self.unit(u)
        return out + self._trace(text[cuts[1] :], 0, stop - cuts[1], 0, last)

    def _trace(self, text: str, begin: int, stop: int, first: int, last: int) -> list[int]:
        state, out = self.states(text, begin)[first], self.states(text, stop)[last]
        at, before = self._ways(text, begin, stop, state)
        if at >= stop and out != (0, 0):
            return [] if stop + out[0] < begin or at > stop or stop + out[0] == begin + state[0] else self.ids_of([text[stop + out[0] : stop + out[1]]])
        start = self.forward(text, at, before, stop)[1]
        if out == (0, 0):
            return self.ids_of(self.back(text, start, at, stop))
        return self.ids_of([*self.back(text, start, at, stop + out[0]), text[stop + out[0] : stop + out[1]]])


_LOADED: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """The vocabulary of a file, read once in a worker; tasks that follow find the units it remembers."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut, outer ends included, on the best path: scans from both sides meet at each cut."""
    ahead = [np.zeros((1, matrices[0].shape[0]))]
    for m in matrices:
        ahead.append(combined(ahead[-1], m))
    behind = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        behind.append(combined(m, behind[-1]))
    return [int((a[0] + b[:, 0]).argmax()) for a, b in zip(ahead, reversed(behind))]


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", giant: int = 50_000, chunk: int = 16_384) -> DataFrame:
    """docs with ids: the model's ids of each whole text.

    Texts of up to `giant` code points are a single chunk. Longer ones are cut into chunks of `chunk`, whose matrices and traces
    are computed wherever Spark puts them; one task per text passes a vector over its matrices in order, one row per chunk. Giant texts that are equal are
    encoded once. Null and empty texts have no ids. Columns called like the new one are replaced; repeated rows are kept; an
    empty table gives no rows.
    """
    own = [c for c in docs.columns if c != "ids"]
    fields = [docs.schema[c] for c in own]
    ids = T.ArrayType(T.IntegerType())

    def encode(inputs):
        model = loaded(model_file)
        for batch in batches(inputs, column=text):
            out = [model.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(out, pa.list_(pa.int32()))], names=[*own, "ids"])

    def matrices(inputs):
        model = loaded(model_file)
        for batch in inputs:
            out = []
            for part, begin, stop in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "stop"))):
                m = model.matrix(part, begin, stop)
                out.append((m.shape[0], m.shape[1], m.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("k"), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))]], names=["name", "k", "n", "m", "scores"])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        found = best_states([np.array(s).reshape(n, m) for n, m, s in zip(group["n"], group["m"], group["scores"])])
        return pd.DataFrame({"name": group["name"], "k": group["k"], "first": found[:-1], "last": found[1:]})

    def traces(inputs):
        model = loaded(model_file)
        for batch in inputs:
            out = [model.trace(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "stop", "first", "last")))]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("k"), pa.array(out, pa.list_(pa.int32()))], names=["name", "k", "ids"])

    length = F.coalesce(F.length(text), F.lit(0))
    small = docs.filter(length <= giant).select(*own).mapInArrow(encode, T.StructType([*fields, T.StructField("ids", ids)]))
    large = docs.filter(length > giant).select(*own)
    model = loaded(model_file)
    margin = model.longest
    whole = F.concat(F.lit(SPACE if model.prefix else ""), F.translate("t", " ", SPACE))
    texts = large.select(F.sha2(text, 256).alias("name"), F.col(text).alias("t")).dropDuplicates(["name"]).select("name", whole.alias("t"))
    cuts = texts.select("name", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int"))).alias("k"))
    start = F.greatest(F.col("k") * chunk - margin, F.lit(0))
    parts = cuts.select(
        "name", "k", F.expr(f"substring(t, greatest(k * {chunk} - {margin}, 0) + 1, {chunk} + least(k * {chunk}, {margin}) + {margin})").alias("part"), (F.col("k") * chunk - start).alias("begin")
    ).withColumn("stop", F.least(F.col("begin") + chunk, F.length("part")))
    parts = stored(parts.repartition("name", "k"), "chunks")
    made = parts.mapInArrow(matrices, "name string, k int, n int, m int, scores array<double>")
    chosen = made.groupBy("name").applyInPandas(choose, "name string, k int, first int, last int")
    traced = parts.join(chosen, ["name", "k"]).mapInArrow(traces, "name string, k int, ids array<int>")
    joined = traced.groupBy("name").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    rows = large.select(F.struct(*own).alias("own"), F.sha2(text, 256).alias("name"))  # apart from columns of the same names
    found = rows.join(joined, "name").select(*[F.col("own")[c].alias(c) for c in own], "ids")
    return small.union(found)


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the texts that the ids stand for; null ids give null, none give the empty text. Bytes that aren't UTF-8 are replaced."""
    own = [c for c in df.columns if c != into]

    def decode(inputs):
        model = loaded(model_file)
        for batch in (b.slice(k, 64) for b in inputs for k in range(0, b.num_rows, 64)):  # few texts at a time
            column = batch.column(ids)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            out = [model.decode(flat[lo:hi]) if valid else None for lo, hi, valid in zip(at, at[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(out, pa.string())], names=[*own, into])

    return df.select(*own).mapInArrow(decode, T.StructType([*[df.schema[c] for c in own], T.StructField(into, T.StringType())]))
