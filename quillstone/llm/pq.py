"""Embedding near-dedup by product quantisation.

Unit vectors are put into inverted lists by the nearest of `lists` coarse centroids;
the residual is cut into `parts` subspaces, each coded by the nearest of 256 centroids.
Coarse and residual centroids are fitted on a bounded sample (`sample` vectors of
smallest hash); every vector is indexed.

Search. A query probes every list c with |x - c|^2 <= |x - own centroid|^2 + slack. A
vector y with cosine 0.98 lies within 0.2 of x in a direction that has nothing to do
with the centroids, which moves that difference by a few hundredths; slack covers
many times that. In a list, distances come from tables of the query's residual
against the codes (asymmetric). A vector whose code is off by e can be within 0.2
only if its coded distance is at most 0.2 + e, so the table look-up loses nothing;
what it lets through is confirmed by exact cosine in double precision.

A pair counts for both ends once, whichever of them probed the other's list. A list
with more than `block` vectors is cut into blocks; pairs of blocks are tasks of their
own, so a crowded list is spread, and a task gives counts and a spanning forest of its
links, never all pairs. Equal vectors of a label are compared once and counted as many.

Defined results: null, zero and non-finite vectors, those with a null component or of
another length than most, and those with a null label link with nothing; so their
component is their own id. Rows that repeat a vec_id count as vectors of their own; those
with a null vec_id link with nothing and give a null component. Vectors as near to two
centroids are in the list of the first. An empty table gives an empty one. Only the id,
vector and label columns are read, whatever other columns are called.

Limit: the sample places at most 4,096 lists, so beyond some millions of vectors a label the
lists grow with their number, and blocks of a list are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import components, cut, pieces

#: Vectors that centroids are fitted on; vectors of a list that a task compares with as many.
SAMPLE, BLOCK = 20_000, 2_048


def means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centroids of the rows of x (fewer rows: the rows)."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centre**2).sum(1) - 2 * p @ centre.T, axis=1) for p in np.array_split(x, len(x) // 4096 + 1)])


class Index:
    """Coarse centroids and the codebooks of the residual's parts."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, seed: int):
        self.coarse = means(x, lists, seed)
        residual = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [means(residual[:, a:b], 256, seed + 1 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, how far each code is off)."""
        codes = np.stack([nearest(residual[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)], axis=1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(axis=1))

    def looked_up(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distance of each query residual to each code, by tables."""
        out = np.zeros((len(query), len(codes)))
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            q = query[:, a:b]
            out += np.maximum((q**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * q @ book.T, 0)[:, codes[:, i]]
        return out

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """|x - c|^2 less that of the nearest, for each row and list."""
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        return d - d.min(axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A few links with the same components as the links a-b among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def vectors_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def compare(index: Index, members: pa.Table, queries: pa.Table, the_list: int, least: float, slack: float):
    """(counts by node, links) between queries and the members of a list."""
    y, x = vectors_of(members["x"].combine_chunks()), vectors_of(queries["x"].combine_chunks())
    centre = index.coarse[the_list]
    codes, off = index.code(y - centre)
    mine, theirs = queries["node"].to_numpy(), members["node"].to_numpy()
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    a, b = [], []
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        near = index.looked_up(part - centre, codes) <= (reach + off[None, :]) ** 2
        i, j = np.nonzero(near & (mine[at : at + 256, None] != theirs[None, :]))
        for k in range(0, len(i), 200_000):
            p, q = i[k : k + 200_000], j[k : k + 200_000]
            same = np.einsum("ij,ij->i", part[p], y[q]) >= least
            a.append(p[same] + at)
            b.append(q[same])
    a, b = (np.concatenate(v) if v else np.empty(0, dtype=int) for v in (a, b))
    # The other end counts the pair itself if it probes the list that the query is in.
    own = nearest(x, index.coarse)
    back = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), 100_000):
        q = b[at : at + 100_000]
        uniq, where = np.unique(q, return_inverse=True)
        back[at : at + 100_000] = index.gaps(y[uniq])[where, own[a[at : at + 100_000]]] <= slack
    times_a, times_b = members["times"].to_numpy()[b], queries["times"].to_numpy()[a]
    nodes = np.concatenate((mine[a], theirs[b[~back]]))
    times = np.concatenate((times_a, times_b[~back]))
    every, place = np.unique(np.concatenate((mine[a], theirs[b])), return_inverse=True)
    tip, root = forest(place[: len(a)], place[len(a) :], len(every))
    return nodes, times, every[tip], every[root]


def links(vectors: DataFrame, *, least: float = 0.98, lists: int | None = None, parts: int = 8, slack: float = 0.08, sample: int = SAMPLE, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(a, b, n): n is null for a link a-b; else a has n links more. From (node, label, x, times), x of unit length."""
    spark = vectors.sparkSession
    kind = "a long, b long, n long"
    n = vectors.count()
    rows = vectors.select("node", "x").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    if not rows:
        return spark.createDataFrame([], kind)
    # As many lists as keep them at some hundred vectors, within what the sample can place.
    lists = lists or int(min(4096, len(rows) // 4 + 1, 2 ** np.ceil(np.log2(max(16, n / 400)))))
    held = spark.sparkContext.broadcast(Index(np.array([r.x for r in rows], dtype=float), lists, parts, seed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in pieces(batches, 512):
            gaps = index.gaps(vectors_of(batch.column(2)))
            row, the_list = np.nonzero(gaps <= slack)
            own = gaps.argmin(axis=1)[row] == the_list
            columns = [batch.column(i).take(pa.array(row)) for i in range(4)] + [pa.array(the_list.astype(np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "x", "times", "list", "own"])

    dealt = cut(vectors.select("node", "label", "x", "times").mapInArrow(assign, "node long, label long, x array<double>, times long, list int, own boolean"))
    size = dealt.groupBy("label", "list").agg(F.count(F.lit(1)).alias("all"), F.count_if("own").alias("members"))
    size = size.filter("members > 0").select("label", "list", F.ceil(F.col("all") / block).cast("int").alias("qn"), F.ceil(F.col("members") / block).cast("int").alias("mn"))
    dealt = dealt.join(size, ["label", "list"])
    q = dealt.withColumn("qb", F.pmod(F.xxhash64("node"), "qn").cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mn") - 1))).withColumn("role", F.lit(0))
    m = dealt.filter("own").withColumn("mb", F.pmod(F.xxhash64("node", F.lit(7)), "mn").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).withColumn("role", F.lit(1))
    columns = ["label", "list", "qb", "mb", "role", "node", "times", "x"]

    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def group(table: pa.Table) -> pa.Table:
        queries, members = (table.filter(pc.equal(table["role"], r)) for r in (0, 1))
        if not queries.num_rows or not members.num_rows:
            return names.empty_table()
        nodes, times, tip, root = compare(held.value, members, queries, table["list"][0].as_py(), least, slack)
        every, place = np.unique(nodes, return_inverse=True)
        total = np.bincount(place, times, len(every)).astype(np.int64)
        counts = [pa.array(every, pa.int64()), pa.nulls(len(every), pa.int64()), pa.array(total, pa.int64())]
        joined = [pa.array(tip, pa.int64()), pa.array(root, pa.int64()), pa.nulls(len(tip), pa.int64())]
        return pa.concat_tables([pa.table(counts, schema=names), pa.table(joined, schema=names)])

    both = q.select(columns).unionByName(m.select(columns))
    return both.groupBy("label", "list", "qb", "mb").applyInArrow(group, kind)


def groups(embeddings: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = embeddings.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # A vector of huge numbers is scaled down first, so that its length is finite.
    most = F.array_max(F.transform("x", F.abs))
    rows = rows.withColumn("fit", F.coalesce(F.col("label").isNotNull() & ~bad & (most > 0), F.lit(False)))
    for size in (most, norm):  # bound in a list of one, to be worked out once for a vector
        divided = F.get(F.transform(F.array(size), lambda n: F.transform("x", lambda v: v / n)), F.lit(0))
        rows = rows.withColumn("x", F.when(F.col("fit"), divided))
    lengths = rows.filter("fit").groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.withColumn("fit", F.col("fit") & (F.size("x") == (lengths[0]["dim"] if lengths else -1)))
    whole = rows.filter("fit and id is not null").groupBy("label", "x").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("times"))
    whole = cut(whole)
    found = cut(links(whole, **how))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = components(found.filter("n is null").select("a", "b"))
    named = whole.join(counts, "node", "left").join(named, "node", "left").select(
        "label", "x", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "node").alias("component")
    )
    out = rows.join(named, ["label", "x"], "left")
    own = F.col("fit") & F.col("component").isNotNull()
    component = F.when(own, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("vec_id"), F.when(own, F.col("n")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
