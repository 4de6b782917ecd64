"""Quality classifier: supervised subword embeddings, trained by numpy gradient descent.

Every word has a vector: the mean of the learned hashed vectors of the word itself and
of its character n-grams (3 to 5 letters, within < and >). Every pair of neighbouring
words adds the hashed vector of the pair, which counts for PAIR words, and one that all
pairs of equal words share, so that repetition can be seen. A document is the mean of
these vectors; a softmax over the two classes follows.

The output is linear in the document's vector, so for scoring each bucket stands for one
number. Whole texts are read, in training too; words of any length have all their
n-grams. All n-grams of a few megabytes of text are hashed at once.

The model is fitted on at most `sample` labelled rows (smallest hash of doc_id) outside
the held-out fifth; its size is fixed by `buckets` and `size`. The rows are sorted, so the
model doesn't depend on how the tables are laid out.

Defined results: null, empty and blank texts have a zero vector and get the score of the
bias; without labels of both classes the share of the class seen is the score; a doc_id
with different labels has the greater one; repeated rows score alike; rows with a null
doc_id are scored and not held out; an empty table gives an empty one. Only doc_id and
text, doc_id and quality are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import held_out, labelled, pieces

SAMPLE = 4_000
BUCKETS, SIZE = 1 << 17, 8
#: Letters whose n-grams are hashed at once, and bytes of text of which they are cut.
LETTERS, BYTES = 250_000, 2_000_000
GRAMS = (3, 4, 5)
#: What a pair of neighbouring words counts for, a word being 1.
PAIR = 0.5
STEP, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    """Buckets of hashes; buckets is a power of two."""
    h = (h + np.uint64(salt)) * MIX
    h ^= h >> np.uint64(29)
    return (h * MIX >> np.uint64(65 - int(buckets).bit_length())).astype(np.int64)


def hashed(words: list[str], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(hashes of words, for each size the buckets of n-grams and the letters that they begin at, the word of each letter, the number of n-grams of each word)."""
    text = "<" + "><".join(words) + ">"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(c)) - first[own]
    left = size[own] - inside
    with np.errstate(over="ignore"):
        power = np.full(int(size.max()), STEP, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        word = np.add.reduceat(c * power[inside], first)
        grams, h = [], c
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * STEP + c[n - 1 :] if len(h) > 1 else h[:0]
            if n in GRAMS:
                at = np.flatnonzero(left[: len(h)] >= n)
                grams.append((_bucket(h[at], n, buckets), at))
    count = 1 + sum(np.maximum(0, size - n + 1) for n in GRAMS)
    return word, grams, own, count


def parts(texts: list[list[str]], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, bucket, weight) of all features of texts, given by their words; the weights of a text add up to 1."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    mark = _bucket(np.zeros(1, np.uint64), 0, buckets)
    at = 0
    while at < len(texts):
        stop, letters = at, 0
        while stop < len(texts) and (stop == at or letters < LETTERS):
            letters += sum(map(len, texts[stop])) + 2 * len(texts[stop])
            stop += 1
        words = [w for x in texts[at:stop] for w in x]
        if words:
            text = np.repeat(np.arange(at, stop), sizes[at:stop])
            word, grams, own, count = hashed(words, buckets)
            pair = np.flatnonzero(text[1:] == text[:-1])
            same = pair[word[pair] == word[pair + 1]]
            total = sizes + PAIR * (sizes - 1) + np.bincount(text[same], minlength=len(texts))
            each = 1 / (count * total[text])
            yield text, _bucket(word, 1, buckets), each
            text_of, each_of = text[own], each[own]
            for bucket, place in grams:
                yield text_of[place], bucket, each_of[place]
            with np.errstate(over="ignore"):
                both = _bucket(word[pair] * STEP + word[pair + 1], 2, buckets)
            yield text[pair], both, PAIR / total[text[pair]]
            yield text[same], np.repeat(mark, len(same)), 1 / total[text[same]]
        at = stop


@dataclass
class Model:
    """One number for each bucket (its vector by the difference of the two classes) and the bias."""

    value: np.ndarray
    bias: float


def logits(texts: list[str | None], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    if model.value.any():
        for text, bucket, weight in parts([(t or "").split() for t in texts], len(model.value)):
            out += np.bincount(text, weight * model.value[bucket], len(texts))
    return out


def fit(rows: list, *, buckets: int = BUCKETS, size: int = SIZE, epochs: int = 8, rate: float = 0.02, batch: int = 64, seed: int = 5) -> Model:
    """Stochastic gradient descent (Adagrad) of the softmax loss over rows (text, target)."""
    y = np.array([int(r.target) for r in rows])
    if not len(y) or y.min() == y.max():
        share = min(max((y.mean() if len(y) else 0.5), 1e-3), 1 - 1e-3)
        return Model(np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    docs = []
    for r in rows:
        weight = np.zeros(buckets, dtype=np.float32)
        for _, bucket, w in parts([(r.text or "").split()], buckets):
            weight += np.bincount(bucket, w, buckets).astype(np.float32)
        own = np.flatnonzero(weight).astype(np.int32)
        docs.append((own, weight[own]))
    v = rng.uniform(-1 / size, 1 / size, (buckets, size))
    u, bias = np.zeros((size, 2)), np.log(np.bincount(y, minlength=2) / len(y))
    seen_v, seen_u, seen_b = np.full(buckets, 1e-6), np.full_like(u, 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            gv, gu, gb, own, _ = gradient([docs[i] for i in part], y[part], v, u, bias)
            seen_v[own] += (gv**2).mean(axis=1)
            v[own] -= 5 * rate * gv / np.sqrt(seen_v[own])[:, None]
            seen_u += gu**2
            u -= 5 * rate * gu / np.sqrt(seen_u)
            seen_b += gb**2
            bias -= rate * gb / np.sqrt(seen_b)
    return Model(v @ (u[:, 1] - u[:, 0]), float(bias[1] - bias[0]))


def gradient(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, v: np.ndarray, u: np.ndarray, bias: np.ndarray):
    """Gradients of the summed softmax loss by the vectors, the classes and the bias; which vectors; and the loss."""
    index, weight = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    row = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    x = np.stack([np.bincount(row, weight * v[index, k], len(docs)) for k in range(v.shape[1])], axis=1)
    z = x @ u + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(len(docs)), y]).sum()
    p[np.arange(len(docs)), y] -= 1
    gx = p @ u.T
    own, place = np.unique(index, return_inverse=True)
    gv = np.stack([np.bincount(place, weight * gx[row, k], len(own)) for k in range(v.shape[1])], axis=1)
    return gv, x.T @ p, p.sum(axis=0), own, loss


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **how) -> Model:
    return fit(labelled(docs, labels, "quality", sample, fold=True), **how)


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 if score >= least, else 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for piece in pieces(batches, most=BYTES):
            p = 1 / (1 + np.exp(-np.clip(logits(piece.column(2).to_pylist(), model), -40, 40)))
            columns = [piece.column(0), piece.column(1), pa.array(p), pa.array((p >= least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
