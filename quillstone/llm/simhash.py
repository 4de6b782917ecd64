"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into five exact segments (13, 13, 13, 13 and 12 bits).
Of at most four differing bits one segment is free (pigeonhole); the other bits
give two halves of 23 bits, of which one has at most two errors. A half is decoded
by the perfect binary Golay code [23, 12, 7] to the indices of the codewords near
it: one index where the nearest codeword is within two bits, else the six codewords
within four bits. Two halves at most two bits apart always share an index (their
midpoint's codeword is within four bits of both). So two linked fingerprints share
at least one of the keys (segment, its value, half, codeword index), and no link
is lost.

Defined results: null, empty or blank text has fingerprint zero, and such documents
link with each other like any others. Copies share a fingerprint and are compared
once. Rows with a null doc_id get a fingerprint and the component of their equals.
Texts of any length are read whole; a bit with as many ones as zeros is 0; an empty table
gives an empty one. Only doc_id and text are read, so other columns may have any names.

Limit: there are some 335 million keys, so beyond some 10^9 distinct fingerprints a key
has so many members that they are dealt in several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import components, cut, pieces

SEGMENTS = (13, 13, 13, 13, 12)
#: Members of one exact segment value from which its keys are split into blocks.
HEAVY = 50_000
GOLAY = 0xC75  # generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text; see the module for blank texts."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = np.array([digest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where they are in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            fps = np.array([fingerprint(t, words, seed) for t in piece.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the 23-bit polynomials x by the generator."""
    x = x.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY << (bit - 11))
    return x


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: six error patterns, how many of them count; and the syndromes of 12 high bits."""
    patterns = np.zeros((2048, 6), dtype=np.uint32)
    count = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        sets = list(combinations(range(23), weight))
        value = np.array([sum(1 << i for i in s) for s in sets], dtype=np.uint32)
        for v, s in zip(value.tolist(), _syndrome(value).tolist(), strict=True):
            # Patterns of weight four count only where the nearest codeword is three bits off.
            if weight < 4 or int(patterns[s, 0]).bit_count() == 3:
                patterns[s, count[s]] = v
                count[s] += 1
    return patterns, count, _syndrome(np.arange(4096, dtype=np.uint32) << np.uint32(11))


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit values: (rows, indices) of the Golay codewords near each of them."""
    patterns, count, high = _cosets()
    x = x.astype(np.uint32)
    syndrome = high[x >> np.uint32(11)] ^ (x & np.uint32(2047))
    index = (x[:, None] ^ patterns[syndrome]) >> np.uint32(11)
    real = np.arange(6)[None, :] < count[syndrome][:, None]
    return np.nonzero(real)[0], index[real].astype(np.int64)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment with its value, key) of unsigned fingerprints; linked ones share a key."""
    rows, coarse, found = [], [], []
    low = 0
    for i, bits in enumerate(SEGMENTS):
        value = (fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        rest = (fp & np.uint64((1 << low) - 1)) | ((fp >> np.uint64(low + bits)) << np.uint64(low))
        exact = (i << 13) + value.astype(np.int64)
        for half in range(2):
            row, index = codewords((rest >> np.uint64(23 * half)) & np.uint64((1 << 23) - 1))
            rows.append(row)
            coarse.append(exact[row])
            found.append((exact[row] * 2 + half) * 4096 + index)
        low += bits
    return np.concatenate(rows), np.concatenate(coarse), np.concatenate(found)


def _tree(fp: np.ndarray, errors: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members of one key."""
    left, edges, queue = np.arange(len(fp)), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= errors
        if near.any():
            new = left[near].tolist()
            edges += [(at, x) for x in new]
            queue += new
            left = left[~near]
    return edges


def _linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (sorted by it): pairs in short runs, a spanning forest in long ones."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    a, b = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    short = np.flatnonzero((sizes > 1) & (sizes <= 6))
    if len(short):
        for step in range(1, 6):
            left = np.concatenate([starts[short] + i for i in range(6 - step)])
            left = left[left + step < len(key)]
            left = left[(run[left] == run[left + step]) & (sizes[run[left]] <= 6)]
            left = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= errors]
            a.append(node[left])
            b.append(node[left + step])
    for i in np.flatnonzero(sizes > 6).tolist():
        part = slice(starts[i], starts[i] + sizes[i])
        if edges := _tree(fp[part], errors):
            at = np.array(edges) + starts[i]
            a.append(node[at[:, 0]])
            b.append(node[at[:, 1]])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, errors: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links that join all nodes at most `errors` bits apart, from (fp, node) rows with distinct fp."""
    spark = distinct.sparkSession
    low, coarse = 0, []
    for i, bits in enumerate(SEGMENTS):
        coarse.append(F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1) + (i << 13))
        low += bits
    # At most 5 x 8,192 values exist, so what is collected and shipped here is bounded.
    crowded = distinct.select(F.explode(F.array(*coarse)).alias("c")).groupBy("c").count().filter(F.col("count") > heavy)
    blocks = spark.sparkContext.broadcast({r["c"]: -(-r["count"] // heavy) for r in crowded.collect()})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 8192):
            fp = piece.column(0).to_numpy().view(np.uint64)
            node = piece.column(1).to_numpy()
            row, exact, key = keys(fp)
            pair = np.zeros(len(key), dtype=np.int64)
            if blocks.value:
                parts = np.zeros(5 << 13, dtype=np.int64)
                parts[list(blocks.value)] = list(blocks.value.values())
                n = np.maximum(1, parts[exact])
                # Pairs of blocks: a member goes to one for each block, so any two meet.
                other = np.concatenate([np.arange(x) for x in n.tolist()]) if len(n) else n
                row, key, n = np.repeat(row, n), np.repeat(key, n), np.repeat(n, n)
                own = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                pair = np.minimum(own, other) * 100_000 + np.maximum(own, other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(pair), pa.array(fp.view(np.int64)[row]), pa.array(node[row])],
                names=["key", "pair", "fp", "node"],
            )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, dtype=np.int64)] * 3
        for batch in _with_end(batches):
            if batch is not None:
                key = batch.column(0).to_numpy() * 1_000_003 + batch.column(1).to_numpy()
                new = [key, batch.column(2).to_numpy(), batch.column(3).to_numpy()]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                if not len(kept[0]):
                    continue
                before = np.flatnonzero(kept[0] != kept[0][-1])
                done = int(before[-1]) + 1 if len(before) else 0  # the last key may go on
            else:
                done = len(kept[0])
            if done:
                a, b = _linked(kept[0][:done], kept[1][:done].view(np.uint64), kept[2][:done], errors)
                kept = [x[done:] for x in kept]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = distinct.select("fp", "node").mapInArrow(emit, "key long, pair long, fp long, node long")
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(match, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def groups(docs: DataFrame, *, words: int = 4, seed: int = 42, errors: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    fps = cut(fingerprints(docs, words, seed))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(distinct.filter(F.col("node").isNotNull()), errors, heavy))
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs without all but the document with the smallest doc_id of each group.

    Rows with a null doc_id are kept; they can't be told apart.
    """
    gone = groups(docs, **how).filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
