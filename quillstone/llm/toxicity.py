"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document has the features of its distinct lower-cased words (twice, if it repeats a
word): the word itself and its first 4 to 8 letters. One weight vector w is shared by all ordered
thresholds b1 <= b2 <= ...: P(grade >= k) = sigmoid(x.w - b_k). The output is the
expected severity, the sum of these probabilities.

Grades. The labels only say toxic or not. A clean row is grade 0; a toxic row is
grade 1, 2 or 3 by terciles of how many telling words it has, where a word tells if its
smoothed odds among the labelled rows are high. Grades so follow from labelled rows
alone, and thresholds stay ordered by construction (b_k are sums of positive steps).
Weights are held at 0 or more: a feature can only speak for toxicity, so that long clean
documents gather no evidence against a few telling words.

The model is fitted on at most `sample` labelled rows (smallest hash of doc_id) and
keeps at most `features` features, so what is shipped is bounded. Scoring reads
whole texts.

Defined results: null, empty and blank texts have no features and get the score of
the thresholds alone; without toxic labels every document scores 0; rows with null
labels are not learnt from (a null text counts as empty); a doc_id with different labels
counts as toxic; repeated rows score alike; rows with a null doc_id are scored, and kept
by `reject`; texts of any length are read whole; features of equal strength are kept in the
order of their letters; an empty table gives an empty one. Only doc_id and text, doc_id and
toxic are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import give_back, labelled, pieces

WORD = re.compile(r"\w+")
#: Labelled rows that the model may learn from; features that it may keep.
SAMPLE, FEATURES = 8_000, 20_000
#: P(grade >= 1) from which a document is called toxic.
LEAST = 0.35
#: Words whose scores a task remembers.
MEMO = 200_000
SCHEMA = "doc_id long, severity double, p_toxic double, grade int"


def parts(word: str) -> list[str]:
    """The features of one word."""
    return [word, *("^" + word[:n] for n in range(4, 9) if len(word) > n)]


def types(text: str | None) -> list[str]:
    """The distinct words of a text, sorted; those that it repeats are there twice."""
    count = Counter(WORD.findall((text or "").lower()))
    return sorted([*count, *(w for w, n in count.items() if n > 1)])


def grades(docs: list[list], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of labelled rows; see the module."""
    out = np.zeros(len(docs), dtype=np.int64)
    if not toxic.any():
        return out
    with_, without = Counter(), Counter()
    for words, bad in zip(docs, toxic.tolist(), strict=True):
        (with_ if bad else without).update(set(words))
    n, m = int(toxic.sum()), int((~toxic).sum())
    telling = {w for w, c in with_.items() if c > 1 and (c + 0.5) / (n + 1) > 20 * (without[w] + 0.5) / (m + 1)}
    count = np.array([sum(w in telling for w in words) for words in docs])
    low, high = np.quantile(count[toxic], [1 / 3, 2 / 3])
    out[toxic] = 1 + (count[toxic] > low) + (count[toxic] > high)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bounds: np.ndarray

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(p, 0.0) for p in parts(word))

    def at_least(self, total: np.ndarray) -> np.ndarray:
        """P(grade >= k) for the summed weights of documents; a row each."""
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.bounds[None, :], -40, 40)))


def fit(
    rows: list, *, features: int = FEATURES, least: float = 3.0, epochs: int = 200, rate: float = 0.05, decay: float = 0.1
) -> Model:
    """Penalised maximum likelihood of the grades of rows (text, target), by full-batch Adam.

    least: how many times commoner in toxic rows a feature must be than by chance.
    """
    toxic = np.array([bool(r.target) for r in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        return Model({}, np.full(3, -40.0 if len(rows) and toxic.all() else 40.0))
    # Documents as numbers of words, so that each word is held once.
    number: dict[str, int] = {}
    docs = [[number.setdefault(w, len(number)) for w in types(r.text)] for r in rows]
    grade = grades(docs, toxic)
    base = toxic.mean()
    words = list(number)
    in_toxic, in_all = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for own, bad in zip(docs, toxic.tolist(), strict=True):
        once = list(set(own))
        in_all[once] += 1
        in_toxic[once] += bad
    with_, all_ = Counter(), Counter()
    for w, c, t in zip(words, in_all.tolist(), in_toxic.tolist(), strict=True):
        for p in parts(w):
            all_[p] += c
            if t:
                with_[p] += t
    # Only features that are clearly commoner in toxic rows are kept: weights of common
    # words are noise that would add up over long documents. The ties go by the letters.
    strength = {}
    for f, c in with_.items():
        expected = base * all_[f]
        if c > 1 and c >= least * expected and (c - expected) / (expected + 0.5) ** 0.5 >= 3:
            strength[f] = (c - expected) / (expected + 0.5) ** 0.5
    names = sorted(strength, key=lambda f: (-strength[f], f))[:features]
    place = {f: i for i, f in enumerate(names)}
    of_word = [[place[p] for p in parts(w) if p in place] for w in words]
    # A document holds a feature as often as it has words with it, so that words add up.
    indptr, index = [0], []
    for own in docs:
        for w in own:
            index += of_word[w]
        indptr.append(len(index))
    row = np.repeat(np.arange(len(docs)), np.diff(indptr))
    index = np.array(index, dtype=np.int64)
    thresholds = int(grade.max())
    above = (grade[:, None] > np.arange(thresholds)[None, :]).astype(float)
    w, steps = np.zeros(len(names)), np.array([np.log((1 - base) / base), *([0.0] * (thresholds - 1))])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    for epoch in range(1, epochs + 1):
        gw, gs, _ = gradient(w, steps, row, index, above, decay)
        for i, (x, g) in enumerate(((w, gw), (steps, gs))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        np.maximum(w, 0, out=w)
    bounds = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
    keep = np.abs(w) > 1e-3
    return Model({f: float(x) for f, x, k in zip(names, w, keep, strict=True) if k}, bounds)


def gradient(w: np.ndarray, steps: np.ndarray, row: np.ndarray, index: np.ndarray, above: np.ndarray, decay: float):
    """Gradients of the penalised mean loss by the weights and by the steps between thresholds; and the loss.

    row and index: the documents and features of all entries; above: whether a grade is over each threshold.
    """
    n = len(above)
    total = np.bincount(row, w[index], n)
    bounds = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
    p = 1 / (1 + np.exp(-np.clip(total[:, None] - bounds, -40, 40)))
    loss = -(above * np.log(p) + (1 - above) * np.log1p(-p)).sum() / n + decay / n * (w * w).sum() / 2
    error = (p - above) / n
    gw = np.bincount(index, error.sum(axis=1)[row], len(w)) + decay / n * w
    later = error[:, ::-1].cumsum(axis=1)[:, ::-1].sum(axis=0)
    return gw, -later * np.concatenate(([1.0], np.exp(steps[1:]))), loss


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **how) -> Model:
    return fit(labelled(docs, labels, "toxic", sample, fold=False), **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade): expected severity, P(grade >= 1), likeliest grade by thresholds."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        model = held.value
        for piece in pieces(batches):
            totals = []
            for text in piece.column(1).to_pylist():
                words = types(text)
                if len(known) > MEMO:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = model.word(w)
                totals.append(sum(map(known.__getitem__, words)))
            p = model.at_least(np.array(totals))
            columns = [piece.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "p_toxic", "grade"])
        known.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, labels: DataFrame, *, least: float = LEAST, **how) -> DataFrame:
    """docs without those whose P(grade >= 1) is `least` or more; rows with a null doc_id are kept."""
    bad = score(docs, train(docs, labels, **how)).filter(F.col("p_toxic") >= least).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
