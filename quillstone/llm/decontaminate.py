"""Benchmark decontamination: CGK embedding, bit sampling over item-sized windows, exact check.

A document is contaminated by an item if some passage of it is within
floor(max_edits * n) word edits of the item's n words (lower-cased, split at white
space). Passages may start at any word.

1. Of n words around a match at least n - k are words of the item, each at most as
   often as in it. Only windows of n words that hold as many words of the items of
   this size, and then as many if repeats beyond any item's are left out, are looked
   at. This loses nothing.
2. The CGK random walk turns a window into a string of 3 n symbols: at step j it
   writes the symbol it stands on and moves on by a random bit of (j, symbol), so
   edit distance becomes Hamming distance, mostly of the same order.
3. Bit sampling: each of `repeats` independent walks is read at `bits` sampled steps;
   window and item are candidates if all of these agree in some walk. The repeats
   bring the recall of near matches to its target; an exact copy agrees in all.
4. Each candidate is confirmed by the exact edit distance of the item to the best
   passage around the window.

Items reach the executors in blocks of about `block` words, so what is shipped and held is
bounded; more words mean more passes over the documents. A worker builds the index of a
block once. The walks' random bits are hashes of (walk, step, symbol), whatever the items.

Defined results: null, empty and blank texts and items match nothing; items of fewer
than 1 / max_edits words are matched word for word; repeated items each give rows;
rows with a null doc_id are searched and give null ids, and a null item_id gives -1; of
passages with equally few edits the first is taken; texts and items of any length are
read whole; an empty table on either side gives none. Only doc_id and text, item_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pieces

#: Words of the items searched for in one pass over the documents; words of windows held at once; bytes of remembered bits.
BLOCK, AT_ONCE, REMEMBERED = 2_000_000, 2_000_000, 1 << 25
#: Bytes of text searched at once.
BYTES = 8_000_000
SCHEMA = "doc_id long, item_id long, edits int, first_word int, last_word int"


def ends(item: list, text: list, *, anchored: bool = False) -> list[int]:
    """Edit distance of item to the nearest passage that ends before each place 1, 2, ... of text.

    Myers' bit vectors. With anchored, the passage starts where the text does.
    """
    bits: dict = defaultdict(int)
    for i, x in enumerate(item):
        bits[x] |= 1 << i
    get, mask, top = bits.get, (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, edits, found = mask, 0, len(item), []
    for y in text:
        same = get(y, 0)
        x = (((same & up) + up) ^ up) | same
        more, less = down | ~(x | up), up & x
        if more & top:
            edits += 1
        elif less & top:
            edits -= 1
        more, less = more << 1 | anchored, less << 1
        x = same | down
        up, down = (less | ~(x | more)) & mask, more & x & mask
        found.append(edits)
    return found


def nearest(item: list, text: list) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of text nearest to item; end is exclusive."""
    found = ends(item, text)
    edits = min(found, default=len(item))
    if edits >= len(item):
        return len(item), 0, 0
    end = found.index(edits) + 1
    back = ends(item[::-1], text[end - 1 :: -1], anchored=True)
    return edits, end - back.index(edits) - 1, end


class Index:
    """The sampled CGK walks of the items of one block."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float, repeats: int, bits: int, seed: int):
        self.words: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            if found := text.lower().split():
                self.items.append((item_id, [self.words.setdefault(w, len(self.words)) for w in found]))
        self.max_edits, self.repeats, self.bits = max_edits, repeats, bits
        other, pad = len(self.words), len(self.words) + 1
        rng = np.random.default_rng(seed)
        self.symbols = rng.integers(0, 2**63, pad + 1, dtype=np.uint64)
        self.bits_of = lru_cache(max(8, REMEMBERED // (8 * (pad + 1))))(self.drawn)
        self.mix = rng.integers(1, 2**62, bits, dtype=np.int64) | 1
        self.other, self.pad = other, pad
        self.sizes = {}
        by_size = defaultdict(list)
        for at, (_, x) in enumerate(self.items):
            by_size[len(x)].append(at)
        for n, members in sorted(by_size.items()):
            pick = np.random.default_rng((seed, n))
            read = [np.sort(pick.choice(3 * n, min(bits, 3 * n), replace=False)) for _ in range(repeats)]
            rows = np.array([self.items[m][1] for m in members]).ravel()
            starts = np.arange(len(members)) * n
            tables = []
            for t in range(repeats):
                keys = self.keys(rows, starts, n, t, read[t])
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.array(members)[order]))
            most = np.zeros(other + 1, dtype=np.int32)
            for m in members:
                word, times = np.unique(self.items[m][1], return_counts=True)
                most[word] = np.maximum(most[word], times)
            self.sizes[n] = (int(max_edits * n), read, tables, most)

    def drawn(self, t: int, block: int) -> np.ndarray:
        """For each symbol the 64 random bits of steps 64 * block and on of walk t."""
        with np.errstate(over="ignore"):
            x = self.symbols + np.uint64(t * 1_000_003 + block + 1) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def bit(self, t: int, j: int, symbol: np.ndarray) -> np.ndarray:
        return (self.bits_of(t, j // 64)[symbol] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)

    def keys(self, words: np.ndarray, starts: np.ndarray, n: int, t: int, read: np.ndarray) -> np.ndarray:
        """The sampled symbols of walk t over words[start:start + n] of each start, as one number."""
        words = np.concatenate((words, np.full(1, self.pad, dtype=words.dtype)))
        at, end = starts.copy(), starts + n
        key = np.zeros(len(starts), dtype=np.int64)
        sampled = {int(j): i for i, j in enumerate(read)}
        with np.errstate(over="ignore"):
            for j in range(int(read[-1]) + 1):
                symbol = np.where(at < end, words[np.minimum(at, len(words) - 1)], self.pad)
                if j in sampled:
                    key = (key ^ (symbol + 1)) * self.mix[sampled[j]]
                    key ^= key >> 31
                at = np.minimum(at + self.bit(t, j, symbol), end)
        return key

    @staticmethod
    def windows(ids: np.ndarray, n: int, k: int, most: np.ndarray) -> np.ndarray:
        """Starts of the windows of n words that could be within k edits of an item, given how often each word may count."""
        known = np.concatenate(([0], np.cumsum((most > 0)[ids], dtype=np.int32)))
        starts = np.flatnonzero(known[n:] - known[:-n] >= n - k)
        kept = []
        step = max(1, AT_ONCE // n)
        for at in range(0, len(starts), step):
            part = starts[at : at + step]
            words = np.sort(ids[part[:, None] + np.arange(n)], axis=1)
            # Of sorted words, one counts unless the word stands `most` places before it too.
            times = most[words]
            before = np.arange(n) - times
            again = np.take_along_axis(words, np.maximum(before, 0), axis=1) == words
            counts = (times > 0) & ~(again & (before >= 0))
            kept.append(part[counts.sum(axis=1) >= n - k])
        return np.concatenate(kept) if kept else starts

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item_id, edits, first and last word) of all matches."""
        get, other = self.words.get, self.other
        split = [t.lower().split() if t else [] for t in texts]
        size = sum(map(len, split))
        if not size or not self.items:
            return []
        # The texts one after the other, each followed by words that are in no item.
        gap = max(self.sizes)
        lengths = np.array([len(x) + gap for x in split])
        offset = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.full(int(offset[-1]), other, dtype=np.int32)
        for i, x in enumerate(split):
            ids[offset[i] : offset[i] + len(x)] = [get(w, other) for w in x]
        pairs = set()
        for n, (k, read, tables, most) in self.sizes.items():
            starts = self.windows(ids, n, k, most)
            if not len(starts):
                continue
            for t in range(self.repeats):
                keys = self.keys(ids, starts, n, t, read[t])
                there, members = tables[t]
                first, stop = np.searchsorted(there, keys, "left"), np.searchsorted(there, keys, "right")
                for i in np.flatnonzero(stop > first).tolist():
                    pairs.update((int(m), int(starts[i])) for m in members[first[i] : stop[i]])
        # Candidates whose surroundings overlap are checked as one stretch of text.
        stretches: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for m, start in sorted(pairs):
            n = len(self.items[m][1])
            k = int(self.max_edits * n)
            text = int(np.searchsorted(offset, start, "right")) - 1
            low = max(int(offset[text]), start - 2 * k)
            high = min(int(offset[text]) + len(split[text]), start + n + 2 * k)
            own = stretches[text, m]
            if own and low <= own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            elif low < high:
                own.append([low, high])
        best = []
        for (text, m), own in sorted(stretches.items()):
            item_id, item = self.items[m]
            shift = int(offset[text])
            found = [(x[0], x[1] + low - shift, x[2] + low - shift - 1) for low, high in own for x in [nearest(item, ids[low:high].tolist())]]
            edits, first, last = min(found, default=(len(item), 0, -1))
            if edits <= int(self.max_edits * len(item)) and last >= first:
                best.append((text, item_id, edits, first, last))
        return best


_built: list = []


def built(items: list[tuple[int, str]], *how) -> Index:
    """The index of a block, kept by a worker for its later tasks; a broadcast value is the same object in all of them."""
    if not _built or _built[0] is not items or _built[1] != how:
        _built[:] = [items, how, Index(items, *how)]
    return _built[2]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    max_edits: float = 0.2,
    repeats: int = 16,
    bits: int = 3,
    seed: int = 11,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, edits, first_word, last_word): the best passage for each document and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.size(F.split(F.btrim("text"), r"\s+")))).first()[0] or 0
    blocks = -(-words // block)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        held = spark.sparkContext.broadcast(sorted((r.item_id if r.item_id is not None else -1, r.text) for r in own.collect()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = built(held.value, max_edits, repeats, bits, seed)
            for piece in pieces(batches, 1024, BYTES):
                ids = piece.column(0).to_pylist()
                if rows := index.search(piece.column(1).to_pylist()):
                    columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows], strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    names = ["doc_id", "item_id", "edits", "first_word", "last_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        part = docs.mapInArrow(run, SCHEMA)
        found = part if blocks == 1 else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones; rows with a null doc_id are kept."""
    bad = matches(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
