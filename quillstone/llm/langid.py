"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier (logistic
regression) over hashed character n-grams says how sure it is that the bit is 1. The
codeword with the least loss wins, each bit's logistic loss weighted by how well its
classifier tells the bit on the training rows. A small lead over the second codeword
flags the text as ambiguous.

Up to five languages get all 2^(n-1) - 1 splits as bits; more get random balanced
bits from a fixed seed, of which the draw with the widest least distance is taken.
The n-grams are pairs and triples of lower-cased letters, all else counting as blank;
a text is the square roots of the shares of its hashed n-grams. The model is fitted
on at most `sample` rows outside the held-out fifth; it reads text and lang only.

Defined results: null texts and texts without a letter give `und` with score 0; with
no labelled rows every text does; one known language is given to every text with
letters, with score 1; rows with a null doc_id are scored and not held out; of codewords of
equal loss the first language by name is taken; repeated rows score alike; texts of any
length are read whole; an empty table gives an empty one. Only doc_id, text and lang are
read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import held_out, pieces

SAMPLE, BUCKETS = 2_500, 1 << 13
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a blank."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of the hashed n-grams, or None for a text without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letters()[points]
    if not (c != 32).any():
        return None
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    found = np.bincount(pair >> shift, minlength=buckets)
    return found + np.bincount((triple ^ (triple >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift, minlength=buckets)


def vector(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    found = counts(text, buckets)
    return None if found is None else np.sqrt(found / found.sum())


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of -1 and 1: the codeword of each language."""
    if n <= 5:
        splits = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=float).T.reshape(n, -1)
    rng, best, widest = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = np.where(np.argsort(rng.random((n, bits)), axis=0) < n // 2, 1.0, -1.0)
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if apart > widest:
            best, widest = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[int, float, bool]:
        """(language, score, ambiguous) of a text's vector."""
        margin = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = (self.trust * np.log1p(np.exp(-self.code * margin))).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return best, float(p[best]), bool(p[best] - second < 0.2)


def fit(rows: list[tuple[str, str]], *, buckets: int = BUCKETS, steps: int = 250, rate: float = 0.3, decay: float = 1e-5, seed: int = 9) -> Model:
    """Fit on (text, language). Each text is also shown as two short snippets, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    languages = sorted({lang for _, lang in rows})
    for text, lang in rows:
        shown = [text]
        for size in (60, 160):
            if len(text) > 2 * size:
                at = int(rng.integers(len(text) - size))
                shown.append(text[at : at + size])
        for t in shown:
            if (v := vector(t, buckets)) is not None:
                x.append(v.astype(np.float32))
                y.append(languages.index(lang))
    languages = [lang for i, lang in enumerate(languages) if i in set(y)]
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 0)), np.zeros((buckets, 0)), np.zeros(0), np.zeros(0))
    place = {old: new for new, old in enumerate(sorted(set(y)))}
    code = codewords(len(languages))
    x, target = np.array(x), code[[place[i] for i in y]]
    w, b = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1])
    # Rows of a rare language weigh as much together as those of a common one.
    share = 1 / np.bincount([place[i] for i in y])[[place[i] for i in y]] / len(languages)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = x @ w + b
        slope = (-target / (1 + np.exp(np.clip(target * margin, -30, 30))) * share[:, None]).astype(np.float32)
        g = x.T @ slope + np.float32(decay) * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * slope.sum(axis=0)
    right = (share[:, None] * (np.sign(x @ w + b) == target)).sum(axis=0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.1)
    return Model(languages, code, w.astype(float), b, trust / trust.mean())


def train(docs: DataFrame, *, sample: int = SAMPLE, **how) -> Model:
    """Learn from at most `sample` rows with a language, outside the held-out fifth, of smallest hash of doc_id."""
    rows = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    pick = rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    own = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").join(F.broadcast(pick), "doc_id")
    return fit(sorted((r.text, r.lang) for r in own.collect()), **how)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for piece in pieces(batches):
            out = []
            for text in piece.column(2).to_pylist():
                x = vector(text, len(model.weights)) if model.languages else None
                if x is None:
                    out.append((UNKNOWN, 0.0, True))
                else:
                    best, score, unsure = model.decode(x)
                    out.append((model.languages[best], score, unsure))
            lang, score, unsure = zip(*out, strict=True) if out else ((), (), ())
            columns = [piece.column(0), piece.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
