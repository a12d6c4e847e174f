"""Licence scan: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, utf8, word_spans
from .license_rules import PHRASES, Rule, rules

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of words after A-Z are lower-cased: digits, a-z, and all from 0x80.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_IN, _OUT = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"

SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("detections", T.ArrayType(T.StringType())),
    ]
)


def kept_detections(text: bytes, ordered: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Detections of one lower-cased text; one that lies within a kept one's interval is suppressed.

    Rules come in order of priority; among detections of the same priority the longer comes first, then the earlier.
    """
    found = []
    for rule in ordered:
        if all(g in text for g in rule.gates):
            found += [(rule.priority, m.start() - m.end(), m.start(), rule.label, rule) for m in rule.pattern.finditer(text) if m.end() > m.start()]
    kept: list[tuple[int, int, Rule]] = []
    for _, minus, start, _, rule in sorted(found, key=lambda x: x[:4]):
        if not any(a <= start and start - minus <= b for a, b, _ in kept):
            kept.append((start, start - minus, rule))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with the licence labels of each whole text.

    Texts are lower-cased (A-Z). Base phrases are counted wherever their words stand one after the other; labels adds those
    of the signature rules that survive suppression; score is 1 minus the product of the weights' complements. detections
    lists kind:label@byte-byte of each kept detection. A text reaches a rule's regex only if it holds all its gate words, and
    the rules at all only if the batch's bytes hold a gate word there.

    Null and empty texts have no words, no labels and score 0; first_word and last_word are null without a base phrase.
    Columns called like the new ones are replaced; repeated rows are scanned one by one; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c != text and c not in SCHEMA.names]
    schema = T.StructType([docs.schema[c] for c in own] + SCHEMA.fields)

    def scan(inputs):
        ordered = rules()
        first_gates = sorted({min(r.gates, key=lambda g: (g != b"licen", -len(g))) for r in ordered})
        phrases = [(label, words[0].encode(), words[-1].encode(), re.compile(b"(?<!" + _IN + b")" + (_OUT + b"+").join(w.encode() for w in words) + b"(?!" + _IN + b")")) for words, label in PHRASES]
        for batch in batches(inputs):
            data, at = utf8(batch.column(text))
            low = data.tobytes().translate(_LOWER)
            starts, _, before = word_spans(np.frombuffer(low, np.uint8), at, _WORD)
            n, ends = len(at) - 1, at[1:]
            hit = set()
            for gate in (*first_gates, *(p[1] for p in phrases)):
                k = low.find(gate)
                while k >= 0:
                    doc = int(np.searchsorted(ends, k, "right"))
                    hit.add(doc)
                    k = low.find(gate, int(ends[doc]))
            out = {"n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "detections": [[] for _ in range(n)]}
            for doc in hit:
                own_text = low[at[doc] : at[doc + 1]]
                places, base = [], set()
                for label, head, tail, pattern in phrases:
                    if head in own_text and tail in own_text:
                        found = [m.start() for m in pattern.finditer(own_text)]
                        places += found
                        base |= {label} if found else set()
                kept = kept_detections(own_text, ordered)
                if places:
                    words = np.searchsorted(starts, np.array(places) + at[doc]) - before[doc]
                    out["n_base"][doc], out["first_word"][doc], out["last_word"][doc] = len(places), int(words.min()), int(words.max())
                out["base_labels"][doc] = ",".join(sorted(base))
                out["labels"][doc] = ",".join(sorted(base | {r.label for _, _, r in kept}))
                rest = 0.5 ** len(base)
                for _, _, r in kept:
                    rest *= 1 - r.weight
                out["score"][doc] = 1 - rest
                out["detections"][doc] = [f"{r.kind}:{r.label}@{a}-{b}" for a, b, r in kept]
            columns = [batch.column(c) for c in own] + [pa.array(np.diff(before))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
            columns += [pa.array(out[c], k) for c, k in zip(SCHEMA.names[1:], kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *SCHEMA.names])

    return docs.select(*own, text).mapInArrow(scan, schema)
