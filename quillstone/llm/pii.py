"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns, each found in
time linear in the text. The random field adds spans that the patterns miss, such as
telephone numbers without a country code.

The field works on clusters: words with a digit or an at sign and what lies between
those at most `LONGEST` words apart. A segment is up to LONGEST words; its features
look at the whole span (digits, separators, lengths of the groups, checksums, the
words before and after). Dynamic programming over (end, type) jointly chooses the
boundaries and types of the segments of a cluster; training maximises the conditional
likelihood by the same recursion over all segmentations. Words outside clusters can't
be in an entity, so cutting the text there changes nothing.

It is trained on at most `sample` documents (smallest hash of doc_id), whose base
spans are the labels, each also in the other spellings of `VARIANTS`, and on numbers
that are no personal data; of these, on at most `most` clusters of at most `widest` words
(all of a text is searched, whatever its clusters are). An added span overlaps no base span.

Defined results: null counts as empty; empty texts have no spans; n_email, n_ip,
n_card and n_phone count all spans, base and added, and `base` holds the base ones alone,
from which op5_pii counts; repeated rows give equal rows; rows
with a null doc_id give rows with a null doc_id and are not learnt from; texts, clusters and numbers of
any length are read whole; of segmentations of equal score the first found (by start, then
kind) is taken; an empty table gives an empty one. Only doc_id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
SAMPLE, LONGEST = 1_500, 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the four patterns, sorted."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, 0, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if not TRIGGER.search(text):
        return found
    for m in NUMBERS.finditer(text):
        if "." in m.group():
            # A chain of numbers matches by fours from its start.
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in four):
                    found.append((at, 1, at + size))
                at += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = only_digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def clusters(text: str) -> Iterator[list[tuple[int, int]]]:
    """Words (start, end) around triggers; neighbouring clusters are more than LONGEST words apart."""
    now: list[tuple[int, int]] = []
    end = 0
    while m := TRIGGER.search(text, end):
        at = m.start()
        while at > end and not text[at - 1].isspace():
            at -= 1
        word = WORD.match(text, at)
        between = []
        if now:
            for w in WORD.finditer(text, end, at):
                between.append(w.span())
                if len(between) > LONGEST:
                    break
            if len(between) > LONGEST:
                yield now
                now, between = [], []
        now += between
        now.append(word.span())
        end = word.end()
    if now:
        yield now


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends that belongs to the sentence."""
    while end > start and text[end - 1] in ",.;:!?\"'>]}":
        end -= 1
    while start < end and text[start] in "\"'<[{,;:":
        start += 1
    return start, end


def features(text: str, start: int, end: int, words: int) -> list[str]:
    """Whole-span features."""
    span = text[start:end]
    digits = only_digits(span)
    groups = re.findall(r"[0-9]+", span)[:8]
    letters = any(c.isalpha() for c in span)
    shape = re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", span))[:24]
    left = text[max(0, start - 24) : start].split()
    out = [f"words={words}", f"digits={min(len(digits), 20)}", f"groups={'-'.join(str(min(len(g), 9)) for g in groups)}", f"shape={shape}"]
    out += [f"letters={letters}", f"at={span.count('@')}", f"first={span[:1] if not span[:1].isalnum() else 'w'}", f"left={left[-1].lower()[:12] if left else ''}"]
    if 12 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and span.count(".") == 3:
        out.append(f"octets={all(int(g) <= 255 for g in groups)}")
    if "@" in span:
        out.append(f"host={bool(DOMAIN.fullmatch(span.rpartition('@')[2]))}")
    return out


class Field:
    """Weights by feature (a row of one number for each type) and by neighbouring types."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.next = np.zeros((OTHER + 1, OTHER + 1))

    def segments(self, text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
        """Features of the candidate segments (first, stop) of a cluster. Of what lies beyond a sentence's end, only single words."""
        spans = ((i, j) for i in range(len(words)) for j in range(i + 1, min(i + LONGEST, len(words)) + 1))
        return {(i, j): f for i, j in spans if (f := self.segment(text, words, i, j)) is not None}

    def segment(self, text: str, words: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
        """Features of a candidate segment; None if it is none."""
        s, e = trimmed(text, words[i][0], words[j - 1][1])
        if s < e and (j == i + 1 or TRIGGER.search(text, words[i][0], words[i][1]) and TRIGGER.search(text, words[j - 1][0], words[j - 1][1])):
            return features(text, s, e, j - i)
        return None

    def scores(self, segments: dict) -> dict[tuple[int, int], np.ndarray]:
        get, none = self.weights.get, np.zeros(OTHER + 1)
        out = {}
        for (i, j), names in segments.items():
            score = sum((get(f, none) for f in names), none)
            if j > i + 1:
                score = np.where(np.arange(OTHER + 1) == OTHER, -np.inf, score)  # other words stand alone
            out[i, j] = score
        return out

    def best(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first, stop, type) of the entities of the best segmentation."""
        n = len(words)
        top, came = np.full((n + 1, OTHER + 1), -np.inf), np.zeros((n + 1, OTHER + 1, 2), dtype=np.int64)
        top[0, OTHER] = 0
        for j in range(1, n + 1):
            # Only the segments that end here are held, so a cluster may be of any length.
            ends = {(i, j): f for i in range(max(0, j - LONGEST), j) if (f := self.segment(text, words, i, j)) is not None}
            scores = self.scores(ends)
            for i in range(max(0, j - LONGEST), j):
                score = scores.get((i, j), None if j > i + 1 else np.where(np.arange(OTHER + 1) == OTHER, 0.0, -np.inf))
                if score is None:
                    continue
                through = top[i][:, None] + self.next
                before = through.argmax(axis=0)
                total = through[before, np.arange(OTHER + 1)] + score
                for k in np.flatnonzero(total > top[j]).tolist():
                    top[j, k] = total[k]
                    came[j, k] = (i, int(before[k]))
        out, j, k = [], n, int(top[n].argmax())
        while j:
            i, before = came[j, k].tolist()
            if k != OTHER:
                out.append((i, j, k))
            j, k = i, before
        return out[::-1]

    def learn(self, text: str, words: list[tuple[int, int]], truth: list[tuple[int, int, int]], rate: float, seen: dict) -> None:
        """A step of Adagrad on the conditional likelihood of the true segmentation."""
        n, segments = len(words), self.segments(text, words)
        scores = self.scores(segments)
        for i in range(n):
            scores.setdefault((i, i + 1), np.where(np.arange(OTHER + 1) == OTHER, 0.0, -np.inf))
        ahead, behind = np.full((n + 1, OTHER + 1), -np.inf), np.full((n + 1, OTHER + 1), -np.inf)
        ahead[0, OTHER] = 0
        for j in range(1, n + 1):
            parts = [np.logaddexp.reduce(ahead[i][:, None] + self.next, axis=0) + scores[i, j] for i in range(max(0, j - LONGEST), j) if (i, j) in scores]
            ahead[j] = np.logaddexp.reduce(parts, axis=0)
        behind[n] = 0
        for i in range(n - 1, -1, -1):
            parts = [np.logaddexp.reduce(self.next + (scores[i, j] + behind[j])[None, :], axis=1) for j in range(i + 1, min(n, i + LONGEST) + 1) if (i, j) in scores]
            behind[i] = np.logaddexp.reduce(parts, axis=0)
        whole = np.logaddexp.reduce(ahead[n])
        true = {(i, j): k for i, j, k in truth}
        covered = {x for i, j, _ in truth for x in range(i, j)}
        true |= {(x, x + 1): OTHER for x in range(n) if x not in covered}
        turn = np.zeros_like(self.next)
        for (i, j), score in scores.items():
            p = np.exp(ahead[i][:, None] + self.next + (score + behind[j])[None, :] - whole)
            turn -= p
            slope = -p.sum(axis=0)
            if (i, j) in true:
                slope[true[i, j]] += 1
            if (i, j) in segments and np.abs(slope).max() > 1e-4:
                for f in segments[i, j]:
                    old = self.weights.get(f, 0.0)
                    g = slope - 0.002 * old
                    seen[f] = seen.get(f, 1e-6) + g * g
                    self.weights[f] = old + rate * g / np.sqrt(seen[f])
        kinds = [OTHER] + [true[x] for x in sorted(true)]
        for a, b in zip(kinds, kinds[1:], strict=False):
            turn[a, b] += 1
        self.next += 0.02 * turn


#: Other spellings of a base span that are taught as the same kind, by kind.
VARIANTS = {
    "card": [lambda d: " ".join(d[i : i + 4] for i in range(0, len(d), 4)), lambda d: "-".join(d[i : i + 4] for i in range(0, len(d), 4))],
    "phone": [lambda d: f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", lambda d: f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"],
}
#: Numbers that are no personal data: forms of d for a drawn digit string.
PLAIN = [
    lambda d: f"20{d[:2]}-0{d[2]}-1{d[3]}", lambda d: f"{d[:2]}.{d[2]}.{d[3]}", lambda d: d[:4], lambda d: f"{d[:3]},{d[3:6]}.{d[6:8]}", lambda d: d[:11],
    lambda d: f"{d[:2]}:{d[2:4]}", lambda d: f"v{d[0]}.{d[1]}.{d[2]}", lambda d: f"{d[:3]}-{d[3:6]}", lambda d: d[:7], lambda d: f"id={d}", lambda d: f"({d[:4]})", lambda d: f"{d[:4]} {d[4:8]}", lambda d: d[:10],
]


def lessons(texts: list[str], seed: int = 17) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """(text, words, true entities) of the clusters of texts, and of the other spellings."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        spans = base(text)
        furthest = list(accumulate((e for _, _, e in spans), max))
        for words in clusters(text):
            truth, last = [], 0
            starts, ends = [a for a, _ in words], [b for _, b in words]
            for s, k, e in spans[bisect_right(furthest, words[0][0]) : bisect_left(spans, (words[-1][1],))]:
                inside = range(bisect_right(ends, s), bisect_left(starts, e))
                if inside and trimmed(text, words[inside[0]][0], words[inside[-1]][1]) == (s, e) and inside[0] >= last and len(inside) <= LONGEST:
                    truth.append((inside[0], inside[-1] + 1, k))
                    last = inside[-1] + 1
            out.append((text, words, truth))
        for s, k, e in spans:
            digits = only_digits(text[s:e])
            around = (text[max(0, s - 40) : s].rpartition(" ")[0], text[e : e + 40].partition(" ")[2])
            for spell in VARIANTS.get(KINDS[k], []) if len(digits) >= 10 else []:
                new = spell(digits)
                other = f"{around[0]} {new} {around[1]}"
                at = len(around[0]) + 1
                for words in clusters(other):
                    inside = [x for x, (a, b) in enumerate(words) if a < at + len(new) and b > at]
                    if inside and not base(other[at : at + len(new)]) or KINDS[k] == "card" and inside:
                        out.append((other, words, [(inside[0], inside[-1] + 1, k)]))
        plain = "".join(map(str, rng.integers(0, 10, 14)))
        new = PLAIN[int(rng.integers(len(PLAIN)))](plain)
        start = text[:60].rpartition(" ")[0]
        other = f"{start} {new} of"
        if not base(other):
            out += [(other, words, []) for words in clusters(other)]
    return out


def fit(texts: list[str], *, epochs: int = 6, rate: float = 0.3, most: int = 1_500, widest: int = 400, seed: int = 17) -> Field:
    """Fit on the base spans of texts; at most `most` clusters of at most `widest` words are learnt from."""
    field, seen = Field(), {}
    known = [x for x in lessons(texts, seed) if len(x[1]) <= widest]
    rng = np.random.default_rng(seed)
    known = [known[i] for i in rng.permutation(len(known))[:most]]
    for epoch in range(epochs):
        for i in rng.permutation(len(known)).tolist():
            field.learn(*known[i], rate / (1 + epoch), seen)
    return field


def train(docs: DataFrame, *, sample: int = SAMPLE, **how) -> Field:
    # Ids first: with the texts, every partition would send as many texts to the driver.
    able = docs.filter(F.col("text").isNotNull() & F.col("text").rlike("[0-9@]"))
    pick = able.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = sorted(able.select("doc_id", "text").join(F.broadcast(pick), "doc_id").collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], **how)


def spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, base and added spans), each (start, kind, end)."""
    own = base(text)
    added = []
    if TRIGGER.search(text):
        starts, furthest = [s for s, _, _ in own], list(accumulate((e for _, _, e in own), max))
        for words in clusters(text):
            if all((k := bisect_right(starts, a)) and b <= furthest[k - 1] + 1 for a, b in words):
                continue
            for i, j, k in field.best(text, words):
                s, e = trimmed(text, words[i][0], words[j - 1][1])
                at = bisect_left(starts, e)
                if not (at and s < furthest[at - 1]):
                    added.append((s, k, e))
    return own, sorted(own + added)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for piece in pieces(batches):
            counts, hashes, texts, bases = [[] for _ in KINDS], [], [], []
            for text in piece.column(1).to_pylist():
                own, every = spans(text or "", field)
                for k in range(OTHER):
                    counts[k].append(sum(x[1] == k for x in every))
                bases.append(shown(own))
                hashes.append(sha256(bases[-1].encode()).hexdigest())
                texts.append(shown(every))
            columns = [piece.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (hashes, texts, bases))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
