"""Embedding near-duplicates: coarse inverted lists with residual product codes, table-lookup distances over sufficient probes, exact cosine last."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bound_batches, written
from .components import components

#: The index is fitted on at most so many distinct vectors, those of least hash; every vector is indexed.
FIT_SAMPLE = 8192
SUBSPACES = 8
CODES = 64
#: Vectors for each inverted list, and the most lists.
PER_LIST = 800
MOST_LISTS = 1024
#: Probes reach at least so many standard deviations of what an offset between near vectors has towards another list.
DEVIATIONS = 3.0
#: Vectors of each list that are compared with all others, to see how far probes must reach for the links that there are; and
#: the margin on top.
TRIALS, MARGIN = 8, 1.15
#: So many links of the compared vectors say how long links are; with fewer, they count as long as they may be.
SEEN = 200
#: Queries of a block that are compared at once.
BLOCK = 512
#: One side of a block is at most so many times as long and so many bytes; larger lists are split in blocks that all meet. The
#: longer the sides, the fewer copies travel.
SIDE = 32
SIDE_BYTES = 8 << 20


@dataclass
class Index:
    """Coarse centroids, and a codebook of residuals for each subspace."""

    coarse: np.ndarray
    books: np.ndarray

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, subspaces, width) of vectors, padded with zeros."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector and squared distances to all centroids."""
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1), 0)
        return d.argmin(1), d

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance of each vector from what its codes stand for."""
        r = self.split(x - self.coarse[lists])
        codes = np.stack([((r[:, m, None] - b[None]) ** 2).sum(2).argmin(1) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)
        back = np.stack([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((r - back) ** 2).sum((1, 2)))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def fit(sample: np.ndarray, n: int) -> Index:
    """An index for ``n`` unit vectors from a sample of them."""
    lists = int(np.clip(n // PER_LIST, 1, min(MOST_LISTS, max(1, len(sample) // 4))))
    coarse = _kmeans(sample, lists)
    dims = sample.shape[1]
    width = -(-dims // SUBSPACES)
    blank = Index(coarse, np.zeros((SUBSPACES, 1, width)))
    near, _ = blank.nearest(sample)
    r = blank.split(sample - coarse[near])
    books = [_kmeans(r[:, m], CODES, rounds=8) for m in range(SUBSPACES)]
    most = max(map(len, books))
    return Index(coarse, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _stored(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length that were stored as bytes, which travel without their numbers being read."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _beyond(index: Index, d: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How far each vector (squared distances ``d`` to all centroids) is on its own centroid's side of the plane between that
    and each other one; 0 for its own."""
    square = (index.coarse**2).sum(1)
    gap = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * index.coarse @ index.coarse.T, 0))[own]
    ahead = d - d[np.arange(len(d)), own][:, None]
    return np.divide(ahead, 2 * gap, out=np.zeros_like(d), where=gap > 1e-9)


def _extent(index: Index, lists: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lists that these entries are in: their numbers, and for each the least distance of its entries to the plane
    towards every centroid, then the greatest distance to its own; rounded outwards to single precision."""
    some = np.unique(lists)
    depth, radius = _beyond(index, d, lists), np.sqrt(d[np.arange(len(d)), lists])
    rows = np.stack([np.append(depth[lists == c].min(0) - 1e-6, radius[lists == c].max() + 1e-6) for c in some])
    return some, rows.astype(np.float32)


def _needed(index: Index, d: np.ndarray, own: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """How far each vector (squared distances ``d``, list ``own``) must reach to ask each list, by the lists' real ``extent``.

    A vector of list c is at least extent[c, own] beyond the plane to the asker's own centroid, and the asker is some way
    before it: no closer than both together. Nor is it farther from c than the asker is, less the distance between them.
    So within the full distance of a link a list that needs more holds no partner.
    """
    need = np.maximum(_beyond(index, d, own) + extent[:, :-1].T[own], np.sqrt(d) - extent[:, -1][None])
    need[np.arange(len(d)), own] = 0
    return need


def _usual_reach(index: Index, sample: np.ndarray, full: float) -> np.ndarray:
    """For each list how far a link's offset goes towards another list if it is like the list's residuals: in many dimensions
    only a small part of it does. Lists with few sampled vectors or residuals in few dimensions come out at the full distance."""
    lists, _ = index.nearest(sample)
    out = np.full(len(index.coarse), full)
    for c in np.unique(lists):
        r = sample[lists == c] - index.coarse[c]
        gram = r.T @ r
        if (square := (gram**2).sum()) > 0:
            out[c] = min(full, full * DEVIATIONS / np.sqrt(np.trace(gram) ** 2 / square))
    return out


def _reach(index: Index, sample: np.ndarray, trial: list[tuple[int, float, int]], full: float) -> np.ndarray:
    """For each list how far its vectors reach. ``trial`` has (list, need, links) of the links of the compared vectors and, under
    the number of lists, how long the longest of them is and how many there are."""
    longest = max([need * MARGIN for c, need, times in trial if c == len(index.coarse) and times >= SEEN], default=full)
    out = _usual_reach(index, sample, min(full, longest))
    for c, need, _ in trial:
        if c < len(out):
            out[c] = min(full, max(out[c], need * MARGIN))
    return out


def _probes(index: Index, d: np.ndarray, own: np.ndarray, reach: np.ndarray, extent: np.ndarray) -> list[np.ndarray]:
    """For each vector the lists that need at most its own list's ``reach``, from its own number on."""
    ok = _needed(index, d, own, extent) <= reach[own][:, None] + 1e-5
    ok &= np.arange(len(index.coarse))[None] >= own[:, None]
    return [np.flatnonzero(o).astype(np.int32) for o in ok]


def _match(index: Index, c: int, codes: np.ndarray, error: np.ndarray, x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) pairs of cosine of at least ``least`` in list ``c``. A table of distances from each query's residual to
    each code gives the distance to what the codes stand for; as an entry is at most its ``error`` from there, none that is
    near enough is passed over. What is left is compared exactly."""
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-4  # more than single precision can be off
    r = index.split(q - index.coarse[c])
    total = np.zeros((len(q), len(x)), np.float32)
    part = np.empty_like(total)
    for m, book in enumerate(index.books):
        table = np.maximum((r[:, m] ** 2).sum(1)[:, None] - 2 * r[:, m] @ book.T + (book**2).sum(1), 0).astype(np.float32)
        total += np.take(table, codes[:, m], axis=1, out=part, mode="clip")
    a, b = np.nonzero(total <= ((reach + error) ** 2).astype(np.float32)[None])
    if len(a) * 50 > total.size:  # many are left: one product of matrices is cheaper than one pair after another
        keep = (q @ x.T)[a, b] >= least
    else:
        keep = np.einsum("ij,ij->i", q[a], x[b]) >= least
    return a[keep], b[keep]


def near_vectors(vectors: DataFrame, least: float = 0.9, vec: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of at least ``least`` in double precision. Equal vectors are one entry with its number of rows
    and least vec_id, by partial aggregation. Each entry is in the inverted list of its nearest centroid, by its residual
    codes, and asks the lists within reach by the real extent of their entries: as far as offsets like the residuals of its
    list go, if links are at most as long as those of a sample of every list, compared with all vectors, and as these links are
    found to need, both with a margin; at most the full distance, which passes over none. In a list the codes' distance less the entry's own error decides, so none is
    passed over there. Recall is measured, in the tests and the README. Of two lists only the vectors of the one with the
    lower number ask the other, and what they find counts for both sides. Each length of vectors has its own index. Lists are
    dealt in blocks, so a crowded list is many groups. Links are counted, and only a spanning set of each block is kept for
    the components.
    Vectors link with ones of their own length. Those that are null, empty, zero, or hold null or non-finite components link
    with nothing; they are rows with no link and their own component. Repeated rows stay.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    kept = "array<float>" if dict(vectors.dtypes)[vec] == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col(vec).cast(kept).alias("v")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    rows = rows.select("vec_id", F.when(F.col("ok"), F.col("v")).alias("v"))
    key = F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))  # -0.0 is 0.0
    rows = written(rows.withColumn("v", key.cast(kept)).withColumn("entry", F.sha2(F.array_join("v", ","), 256)), "vectors")
    entries = rows.where("v IS NOT NULL").groupBy("entry").agg(F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    entries = written(entries.withColumn("node", F.xxhash64("entry")), "vectors-entries")
    sizes = entries.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dims").collect()
    found = None
    for dims, total in sizes:
        of_length = _links(entries.where(F.size("v") == dims), total, least)
        found = of_length if found is None else found.unionByName(of_length)
    if found is None:
        found = spark.createDataFrame([], "u long, v long, c long")
    counts = found.groupBy("u").agg(F.sum("c").alias("c")).withColumnRenamed("u", "node")
    member = components(found.select("u", "v").where("u <> v").distinct()).withColumnRenamed("component", "root")
    named = entries.join(counts, "node", "left").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    done = named.join(least_id, "root").select("entry", (F.coalesce("c", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.where("v IS NOT NULL").join(done, "entry").select("vec_id", "n_links", "component_id").unionByName(alone)


def _links(usable: DataFrame, total: int, least: float) -> DataFrame:
    """(u, v, c) of ``total`` entries (entry, v, n, node) of one length: nodes that links connect, and the linked rows of u."""
    spark = usable.sparkSession
    sample = usable.orderBy(F.xxhash64("node", F.lit(3)), "entry").limit(FIT_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    some = _unit(_vectors(sample))
    index = spark.sparkContext.broadcast(fit(some, total))
    lists_of, lengths = index.value.coarse.shape
    farthest = float(np.sqrt(max(0.0, 2 - 2 * least)))
    own, _ = index.value.nearest(some)
    trials = spark.sparkContext.broadcast(some[np.concatenate([np.flatnonzero(own == c)[:TRIALS] for c in range(lists_of)])])
    kind = "<f4" if dict(usable.dtypes)["v"] == "array<float>" else "<f8"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            raw = _vectors(batch.column(2))
            x = _unit(raw)
            lists, _ = ix.nearest(x)
            codes, error = ix.code(x, lists)
            kept = pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["node", "n", "x", "list", "codes", "error"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, whole = index.value, np.full((lists_of, lists_of + 1), np.inf, np.float32)
        for batch in batches:
            lists, d = ix.nearest(_unit(_stored(batch.column(0), kind)))
            some, rows = _extent(ix, lists, d)
            rows[:, -1] *= -1  # minima all
            whole[some] = np.minimum(whole[some], rows)
        some = np.flatnonzero(np.isfinite(whole).all(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([whole[c].tobytes() for c in some], pa.binary())], names=["list", "extent"])

    def least_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(r), np.float32).reshape(len(r), -1).min(0).tobytes() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["list", "extent"])

    placed = written(usable.select("node", "n", "v").mapInArrow(place, "node long, n long, x binary, list int, codes binary, error double"), "vectors-placed")
    widest = placed.select("x").mapInArrow(widen, "list int, extent binary").groupBy("list").agg(F.collect_list("extent").alias("extents"))
    extent = np.full((lists_of, lists_of + 1), np.inf, np.float32)  # an empty list is never asked
    extent[:, -1] = -np.inf
    for row in widest.mapInArrow(least_of, "list int, extent binary").collect():  # a row for each list
        extent[row["list"]] = np.frombuffer(row["extent"], np.float32)
        extent[row["list"], -1] *= -1
    extents = spark.sparkContext.broadcast(extent)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, asking = index.value, trials.value
        home, d = ix.nearest(asking)
        need = _needed(ix, d, home, extents.value)
        most, times = np.full(lists_of + 1, -1.0), np.zeros(lists_of + 1, np.int64)  # the last for the lengths of all links
        for batch in batches:
            cosine = _unit(_stored(batch.column(0), kind)) @ asking.T
            a, b = np.nonzero(cosine >= least)
            np.maximum.at(most, home[b], need[b, batch.column(1).to_numpy()[a]])
            lengths_of = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[a, b]))
            lengths_of = lengths_of[lengths_of > 1e-4]  # not with itself
            most[-1], times[-1] = max(most[-1], lengths_of.max(initial=-1.0)), times[-1] + len(lengths_of)
        found = np.flatnonzero(most > 0)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(most[found]), pa.array(times[found])], names=["list", "need", "times"])

    trial = placed.select("x", "list").mapInArrow(tried, "list int, need double, times long").groupBy("list").agg(F.max("need").alias("need"), F.sum("times").alias("times")).collect()
    reaches = spark.sparkContext.broadcast(_reach(index.value, some, [(r["list"], r["need"], r["times"]) for r in trial], farthest))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, d = index.value.nearest(_unit(_stored(batch.column(2), kind)))
            asked = _probes(index.value, d, own, reaches.value, extents.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.list_(pa.int32()))], names=["node", "n", "x", "list", "probes"])

    asked = placed.select("node", "n", "x", "list").mapInArrow(ask, "node long, n long, x binary, list int, probes array<int>")
    asked = asked.select("node", "n", "x", F.explode("probes").alias("at"), "list").select("node", "n", "x", "at", (F.col("list") == F.col("at")).alias("home"))
    side = max(BLOCK, min(SIDE * BLOCK, SIDE_BYTES // (8 * lengths)))
    held = placed.groupBy("list").agg(F.ceil(F.count("*") / side).cast("int").alias("parts")).withColumnRenamed("list", "at")
    asks = asked.groupBy("at").agg(F.count("*").alias("asks"), F.count_if(~F.col("home")).alias("away"))
    # A list of one part compares its own entries as they are; of more parts, they travel as askers too. At most MOST_LISTS rows.
    many = F.greatest(F.ceil(F.when(F.col("parts") == 1, F.col("away")).otherwise(F.col("asks")) / side), F.lit(1)).cast("int")
    plan = F.broadcast(held.join(asks, "at").select("at", "parts", many.alias("askers")))
    part = F.pmod(F.hash("node", F.lit(11)), F.col("parts"))
    asker = F.pmod(F.hash("node", F.lit(13)), F.col("askers"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("error", "double"))]
    entry_rows = placed.withColumnRenamed("list", "at").join(plan, "at").withColumn("part", part).withColumn("asker", F.explode(F.expr("sequence(0, askers - 1)"))).select("at", "part", "asker", F.struct("node", "x", "n", ((F.col("parts") == 1) & (F.col("asker") == 0)).alias("home"), "codes", "error").alias("e"))
    query_rows = asked.join(plan, "at").where("NOT home OR parts > 1").withColumn("asker", asker).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("at", "part", "asker", F.struct("node", "x", "n", "home", *nothing).alias("e"))
    blocks = entry_rows.unionByName(query_rows).groupBy("at", "part", "asker").agg(F.collect_list("e").alias("es")).select("at", "es")

    block = BLOCK

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for r in range(batch.num_rows):
                es = batch.column(1).slice(r, 1).flatten()
                is_entry = np.array(es.field("codes").is_valid())
                e, q = np.flatnonzero(is_entry), np.flatnonzero(~is_entry)
                home = es.field("home").to_numpy(zero_copy_only=False).astype(bool)
                q = np.concatenate([e[home[e]], q])  # entries that ask in their own list
                if not len(e) or not len(q):
                    continue
                node, n, x = es.field("node").to_numpy(), es.field("n").to_numpy(), _unit(_stored(es.field("x"), kind))
                codes = np.frombuffer(b"".join(es.field("codes").take(pa.array(e)).to_pylist()), np.uint8).reshape(len(e), -1)
                error = es.field("error").take(pa.array(e)).to_numpy(zero_copy_only=False)
                for lo in range(0, len(q), block):
                    some_q = q[lo : lo + block]
                    a, b = _match(ix, batch.column(0)[r].as_py(), codes, error, x[e], x[some_q], least)
                    other = node[some_q][a] != node[e][b]
                    a, b = a[other], b[other]
                    away = ~home[some_q][a]  # in their own list both ask
                    linked = np.bincount(a, n[e][b], len(some_q)).astype(np.int64)
                    asked_by = np.bincount(b[away], n[some_q][a[away]], len(e)).astype(np.int64)
                    low, top = node[some_q].copy(), node[e].copy()
                    while True:  # the least node that the block's links reach
                        before = (low.copy(), top.copy())
                        np.minimum.at(low, a, top[b])
                        np.minimum.at(top, b, low[a])
                        if (before[0] == low).all() and (before[1] == top).all():
                            break
                    u = np.concatenate([node[some_q], node[e]])
                    v = np.concatenate([low, top])
                    count = np.concatenate([linked, asked_by])
                    some = (u != v) | (count > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(v[some]), pa.array(count[some])], names=["u", "v", "c"])

    return written(blocks.mapInArrow(search, "u long, v long, c long"), "vectors-links")


def report(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; edge cases as in ``near_vectors``. A null vec_id is kept if its component has no other."""
    return near_vectors(vectors, least).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same report in DuckDB, by comparing all pairs.
ORACLE = """
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
    SELECT * FROM rows WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS u, b.r AS v FROM usable a JOIN usable b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(r, n) AS (
    SELECT r, r FROM rows UNION SELECT reach.r, v FROM reach JOIN links ON u = n
)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = rows.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN (SELECT reach.r, min(x.vec_id) AS component_id FROM reach JOIN rows x ON x.r = n GROUP BY 1) USING (r)
"""
