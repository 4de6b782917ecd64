"""SentencePiece encoding and decoding by suffix-array matching and relaxation.

Text is put as the piece model puts it: white space U+0020 becomes U+2581 and one is
put in front. No piece holds U+2581 behind another character, nor a line break (where the
vocabulary has none), so text falls into segments (a run of U+2581, or a line break, and
what follows it) that are encoded and decoded on their own; each distinct segment of a
batch is worked out once, and what was common before is remembered, within bounds.

The new segments of a batch are joined to one text with separators. Its suffixes are
sorted by as many characters as the longest piece has (a suffix array to that depth);
two binary searches for each piece give the range of its occurrences. Every
occurrence is an edge from its start to its end. Edges are sorted by their end and
relaxed, place after place in all segments at once: an edge is taken if its piece may
follow the piece that ends where it starts. Two pieces may follow each other if
merging their joined letters by the model's order gives just these two; the merged
form of a text is the only path all of whose neighbours may follow each other. So the
result is the model's own (tests compare with its library). A character that no piece
holds is written by its UTF-8 bytes. Segments that begin with several U+2581 have
merges of equal rank, for which paths don't decide; these few are merged in the model's order.

Decoding joins pieces and bytes, and turns U+2581 to spaces. A text that holds U+2581
itself decodes with spaces there; `exact` is false for it.

Defined results: null text gives null pieces and null text; empty text no pieces;
repeated rows are encoded alike; rows with a null doc_id are encoded too; texts of any
length are encoded whole; of equal ranks the leftmost merge comes first; an empty table
gives an empty one; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import give_back, pieces

SPACE = "▁"
#: Vocabulary file; its path is a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that a worker remembers (twice), their letters, pairs of pieces, and letters of new segments that are matched at once.
MEMO, MEMO_LETTERS, PAIRS, AT_ONCE = 250_000, 4_000_000, 1_000_000, 100_000
#: Rows and bytes of text that are encoded together.
ROWS, BYTES = 1_024, 1_000_000


class Pieces:
    """The pieces of a model and how to encode with them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.text))]
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.text) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.special = {i for i, s in enumerate(special) if s}
        plain = [i for i, s in enumerate(special) if not s and i not in self.bytes_of]
        self.id = {self.text[i]: i for i in plain}
        self.rank = {self.text[i]: (-model.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.id))
        letters = sorted(set(chain.from_iterable(self.id)))
        # Letters by number, from 1; whatever no piece holds is the last number.
        self.code = np.full(0x110000, len(letters) + 1, dtype=np.uint16)
        self.code[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        ids = np.array(sorted(self.id.values()))
        codes = [self.code[np.array(list(map(ord, self.text[i])))] for i in ids]
        low, high = np.zeros((len(ids), self.longest), ">u2"), np.full((len(ids), self.longest), 0xFFFF, ">u2")
        for row, c in enumerate(codes):
            low[row, : len(c)] = high[row, : len(c)] = c
        self.ids, self.lengths = ids, np.array([len(c) for c in codes])
        kind = f"S{2 * self.longest}"
        self.low, self.high = low.view(kind).ravel(), high.view(kind).ravel()
        self.top = max(self.bytes_of, default=-1)
        #: Pairs of pieces, first * size + second: whether the second may follow.
        self.pairs, self.answers = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.fresh: dict[int, bool] = {}
        #: Pieces of segments by key, as 32-bit numbers, and of older ones, some of which come back.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = 0
        #: What segments decode to, where that is something else than the segment with spaces.
        self.odd: dict[str, str] = {}
        self.breaks = not any("\n" in p for p in self.id)
        self.segment = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if self.breaks else f"{SPACE}+[^{SPACE}]*")
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.whole = np.zeros(len(self.text), dtype=bool)
        self.whole[[i for p, i in self.id.items() if len(p) == 1 or self.last_merge(p) is not None]] = True

    def merged(self, text: str) -> list[str]:
        """text merged by rank, the leftmost first; the definition of the encoding."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in self.rank:
                heapq.heappush(heap, (self.rank[both][0], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two went into another merge
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def written(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece is merged from at last; None if merging its letters never gives it."""
        if piece not in self.halves:
            parts, before = list(piece), None
            while len(parts) > 1:
                before = parts
                best = min(((*self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), key=lambda x: (x[0], x[2]), default=None)
                if best is None:
                    break
                i = best[2]
                parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]
            self.halves[piece] = (before[0], before[1]) if len(parts) == 1 and before else None
        return self.halves[piece]

    def follow(self, a: str, b: str) -> bool:
        """Whether merging the letters of a + b gives a and b.

        Merges are undone from the last to the first. Between the parts that meet at
        the border no merge may come before the one that used up either of them; of
        merges of one rank the leftmost comes first.
        """
        rank = self.rank
        if len(a) > 1 and self.last_merge(a) is None or len(b) > 1 and self.last_merge(b) is None:
            return False
        limit, of_b = float("inf"), False
        while True:
            across = rank.get(a + b)
            if across is not None and (across[0] < limit or across[0] == limit and of_b):
                return False
            of_a_rank = rank[a][0] if len(a) > 1 else -1.0
            of_b_rank = rank[b][0] if len(b) > 1 else -1.0
            if len(a) > 1 and (len(b) == 1 or of_a_rank > of_b_rank):
                limit, of_b, a = of_a_rank, False, self.last_merge(a)[1]
            elif len(b) > 1:
                limit, of_b, b = of_b_rank, True, self.last_merge(b)[0]
            else:
                return True

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """For numbers first * size + second, sorted: may the second piece follow the first?"""
        size, fresh, text = len(self.text), self.fresh, self.text
        if not len(self.pairs):
            at, held = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
        else:
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            held = self.pairs[at] == pairs
        out = np.zeros(len(pairs), dtype=bool)
        out[held] = self.answers[at[held]]
        for i in np.flatnonzero(~held).tolist():
            pair = int(pairs[i])
            if (yes := fresh.get(pair)) is None:
                yes = fresh[pair] = self.follow(text[pair // size], text[pair % size])
            out[i] = yes
        return out

    def settle(self) -> None:
        """Put the pairs that were asked for anew to the others."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.answers = self.pairs[:0], self.answers[:0]
        pairs = np.concatenate((self.pairs, np.fromiter(self.fresh, dtype=np.int64, count=len(self.fresh))))
        answers = np.concatenate((self.answers, np.fromiter(self.fresh.values(), dtype=bool, count=len(self.fresh))))
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.answers, self.fresh = pairs[order], answers[order], {}

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece in the text, sorted by end."""
        depth = self.longest
        padded = np.concatenate((codes, np.zeros(depth, dtype=np.uint16))).astype(">u2")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(codes)])
        # Suffixes as eight bytes a column: a stable sort from the last column on.
        words = suffixes.view(">u8").reshape(len(codes), -1).astype(np.uint64) if depth % 4 == 0 else None
        suffixes = suffixes.view(f"S{2 * depth}").ravel()
        order = np.lexsort(words.T[::-1]) if words is not None else np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        first = np.searchsorted(suffixes, self.low, "left")
        count = np.searchsorted(suffixes, self.high, "right") - first
        # The places of all ranges, one after the other.
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]
        start = order[place]
        end = start + self.lengths[which]
        by_end = np.argsort(end, kind="stable")
        return start[by_end], end[by_end], self.ids[which[by_end]]

    def relax(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets) of distinct segments that have no merges of equal rank; a letter x that no piece holds is -1 - x."""
        joined = "\x00".join(segments) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.code[points]
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        base = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        codes[base + lengths] = int(self.code[0x10FFFF]) + 1  # a separator is in no piece
        strange = codes >= int(self.code[0x10FFFF])
        # Where a letter that no piece holds stands, a path ends and another begins.
        last = np.full(len(codes) + 1, -1, dtype=np.int64)  # piece that ends at a place; -1: a path begins, -2: none yet
        last[1:][~strange] = -2
        origin = np.maximum.accumulate(np.where(np.concatenate(([True], strange)), np.arange(len(codes) + 1), 0))
        start, end, piece = self.edges(codes)
        came = np.zeros(len(codes) + 1, dtype=np.int64)
        level = end - origin[end]
        by_level = np.argsort(level, kind="stable")
        stops = np.searchsorted(level[by_level], np.arange(1, level.max() + 2 if len(level) else 1))
        size, done = len(self.text), 0
        for stop in stops.tolist():
            part = by_level[done:stop]
            done = stop
            if not len(part):
                continue
            before = last[start[part]]
            part, before = part[before != -2], before[before != -2]
            # A piece that its own letters don't merge to is never used.
            fits = (before == -1) & self.whole[piece[part]]
            others = before != -1
            pairs, back = np.unique(before[others] * size + piece[part[others]], return_inverse=True)
            fits[others] = self.may_follow(pairs)[back]
            part = part[fits]
            last[end[part]] = piece[part]
            came[end[part]] = start[part]
        self.settle()
        # Back from the ends, a piece of every segment at a time.
        at, live = base + lengths, np.flatnonzero(lengths > 0)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            here = at[live]
            odd = strange[here - 1]
            steps.append((live, np.where(odd, -1 - points[here - 1].astype(np.int64), last[here])))
            at[live] = np.where(odd, here - 1, came[here])
            live = live[at[live] > base[live]]
        count = np.zeros(len(segments), dtype=np.int64)
        for live, _ in steps:
            count[live] += 1
        offsets = np.concatenate(([0], np.cumsum(count)))
        flat = np.zeros(int(offsets[-1]), dtype=np.int64)
        for k, (live, piece) in enumerate(steps):
            flat[offsets[live + 1] - 1 - k] = piece
        return flat, offsets

    def keys(self, text: str) -> list[str]:
        """The segments of a text: those with one U+2581 in front without it, others as they are."""
        if self.breaks and not (SPACE in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " "):
            return text.replace("\n", " \n").split(" ")
        found = self.segment.findall(SPACE + text.replace(" ", SPACE))
        return [x[1:] if x[0] == SPACE and x[1:2] != SPACE else x for x in found]

    def learn(self, keys: list[str]) -> None:
        """Encode and decode the segments of keys and remember them."""
        at = 0
        while at < len(keys):
            size, stop = 0, at
            while stop < len(keys) and size < AT_ONCE:
                size += len(keys[stop]) + 2
                stop += 1
            plain, part = [], keys[at:stop]
            for key in part:
                # A line break is pieces of its own; what follows it has no U+2581.
                plain.append("" if key[:1] == SPACE else key[1:] if self.breaks and key[:1] == "\n" else SPACE + key)
            flat, offsets = self.relax(plain)
            held, bounds = flat.astype(np.int32).tobytes(), (4 * offsets).tolist()
            line_break = np.array(self.written(["\n"]), dtype=np.int32).tobytes()
            strange = set(np.searchsorted(offsets, np.flatnonzero(flat < 0), "right").tolist())
            same = not strange and "".join(map(self.text.__getitem__, flat.tolist())) == "".join(plain)
            for i, (key, s) in enumerate(zip(part, plain, strict=True)):
                ids = held[bounds[i] : bounds[i + 1]]
                if i + 1 in strange:
                    ids = np.array([y for x in flat[offsets[i] : offsets[i + 1]].tolist() for y in ([x] if x >= 0 else self.written([chr(-1 - x)]))], dtype=np.int32).tobytes()
                if key[:1] == SPACE:
                    ids = np.array(self.written(self.merged(key)), dtype=np.int32).tobytes()
                elif not s or s is not key and s[0] != SPACE:
                    ids = line_break + ids
                self.known[key] = ids
                if not same or key[:1] == SPACE:
                    want = self.spaced(key)
                    if (got := self.joined(np.frombuffer(ids, dtype=np.int32).tolist())) != want:
                        self.odd[key] = got
            self.letters += size
            at = stop

    def spaced(self, key: str) -> str:
        """The segment of a key with spaces."""
        return (key if key[:1] == SPACE or self.breaks and key[:1] == "\n" else SPACE + key).replace(SPACE, " ")

    def coded(self, texts: list[str | None]) -> list[tuple[bytes, str] | None]:
        """(pieces as 32-bit numbers, the text they decode to) of each text."""
        split = [self.keys(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(split))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > MEMO or self.letters > MEMO_LETTERS:
            self.known, self.older, self.letters, self.odd, new = {}, {} if self.odd else self.known, 0, {}, wanted
        # What was known before the last clearing is taken over, so that common segments stay.
        for key in (back := new.intersection(self.older)):
            self.known[key] = self.older[key]
            self.letters += len(key)
        self.learn(sorted(new.difference(back)))
        found: list[tuple[bytes, str] | None] = []
        for t, keys in zip(texts, split, strict=True):
            if t is None:
                found.append(None)
            elif SPACE in t or self.odd and not self.odd.keys().isdisjoint(keys):
                parts = (self.odd[k] if k in self.odd else self.spaced(k) for k in keys)
                found.append((b"".join(map(self.known.__getitem__, keys)), "".join(parts)[1:]))
            else:
                # Every segment decodes to itself, so the text does.
                found.append((b"".join(map(self.known.__getitem__, keys)), t))
        return found

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return [x and np.frombuffer(x[0], dtype=np.int32).tolist() for x in self.coded(texts)]

    def joined(self, ids: list[int]) -> str:
        """What pieces stand for, the leading space too."""
        text, special, bytes_of = self.text, self.special, self.bytes_of
        if min(ids, default=10**9) > self.top:
            found = "".join(map(text.__getitem__, ids))
        else:
            found = b"".join(bytes([bytes_of[i]]) if i in bytes_of else b"" if i in special else text[i].encode() for i in ids).decode("utf-8", "replace")
        return found.replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        found = self.joined(ids)
        return found[1:] if found.startswith(" ") else found


@cache
def load(path: str) -> Pieces:
    """The pieces of a file, kept by a worker process for its later tasks."""
    return Pieces(path)


def lists(ids: list[bytes | None]) -> pa.Array:
    """Rows of pieces as an Arrow array, by way of one flat array."""
    sizes = np.fromiter((len(x) // 4 if x else 0 for x in ids), dtype=np.int32, count=len(ids))
    offsets = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)))
    flat = np.frombuffer(b"".join(x for x in ids if x), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, decoded, exact): pieces, the text they decode to, and whether it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for piece in pieces(batches, ROWS, BYTES):
            texts = piece.column(1).to_pylist()
            found = own.coded(texts)
            ids, decoded = [x and x[0] for x in found], [x and x[1] for x in found]
            exact = [None if t is None else t == d for t, d in zip(texts, decoded, strict=True)]
            columns = [piece.column(0), lists(ids), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "exact"])
        own.older = {}  # a worker outlives its task, and what it holds then is of use to few
        give_back()

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string, exact boolean")
