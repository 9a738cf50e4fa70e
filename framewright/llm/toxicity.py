"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bound_batches, unused
from ._text import Recent, once, pieces, text_slices, word_starts

#: Hashed features: a word, its first four and its first five letters; a run of punctuation.
DIMS = 1 << 17
#: Labelled rows for fitting: at most so many for each value of the last category, those with the least hash of doc_id.
SAMPLE_PER_CLASS = 4000
FOLDS = 3
#: Features of sampled rows that are summed at once.
PART = 1 << 19


def word_features(piece: bytes) -> tuple[int, ...]:
    """Feature ids of a piece."""
    w = piece.decode().strip().lower()
    if not any(c.isalpha() for c in w):
        return () if not w or w.isdigit() else (zlib.crc32(f"p:{w[:4]}".encode()) % DIMS,)
    names = {f"w:{w}", f"4:{w[:4]}" if len(w) >= 4 else "", f"5:{w[:5]}" if len(w) >= 5 else ""} - {""}
    return tuple(zlib.crc32(n.encode()) % DIMS for n in sorted(names))


@dataclass
class Chain:
    """The fitted chain: for each category a bias, feature weights and weights of the earlier probabilities."""

    categories: list[str]
    bias: list[float] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """From the mean feature score of each document (rows) and category (columns)."""
        p = np.zeros_like(means)
        for k in range(len(self.categories)):
            z = self.bias[k] + means[:, k] + p[:, :k] @ self.links[k]
            p[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p


class _Rows:
    """Sparse rows: feature ids and values in one array each."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]):
        size = np.array([len(i) for i in ids], np.int64)
        self.n, self.row = len(ids), np.repeat(np.arange(len(ids), dtype=np.int32), size)
        self.ids = np.concatenate(ids).astype(np.int32, copy=False) if ids else np.zeros(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32, copy=False) if values else np.zeros(0, np.float32)

    def pick(self, chosen: np.ndarray) -> _Rows:
        at = np.full(self.n, -1, np.int32)
        at[np.flatnonzero(chosen)] = np.arange(chosen.sum())
        keep = chosen[self.row]
        out = _Rows([], [])
        out.n, out.row, out.ids, out.values = int(chosen.sum()), at[self.row[keep]], self.ids[keep], self.values[keep]
        return out

    def _sum(self, to: np.ndarray, size: int, of) -> np.ndarray:
        """Sums of ``of(part)`` by ``to``, part by part, so that what stands between is small."""
        out = np.zeros(size)
        for lo in range(0, len(to), PART):
            part = slice(lo, lo + PART)
            out += np.bincount(to[part], of(part), size)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sum(self.row, self.n, lambda part: self.values[part] * w[self.ids[part]])

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sum(self.ids, DIMS, lambda part: self.values[part] * g[self.row[part]])

    def having(self, y: np.ndarray) -> np.ndarray:
        """For each feature the sum of ``y`` over the rows that have it."""
        return self._sum(self.ids, DIMS, lambda part: y[self.row[part]])


def _telling(x: _Rows, y: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Which features are in clearly more rows of one class than of the other: two shares that differ by ``least`` standard errors."""
    pos, neg = x.having(y), x.having(1 - y)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    share = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= least) & (pos + neg >= 3)


def _fit(x: _Rows, earlier: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression on telling features by full gradients with a step size for each weight; both classes weigh the same."""
    keep = _telling(x, y)[x.ids]
    told = _Rows([], [])
    told.n, told.row, told.ids, told.values = x.n, x.row[keep], x.ids[keep], x.values[keep] * SCALE
    x = told
    w, link, bias = np.zeros(DIMS), np.zeros(earlier.shape[1]), 0.0
    hw, hl, hb = np.full(DIMS, 1e-12), np.full(len(link), 1e-12), 1e-12
    share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for _ in range(rounds):
        z = np.clip(bias + x.dot(w) + earlier @ link, -40, 40)
        g = (1 / (1 + np.exp(-z)) - y) * cost
        gw, gl, gb = x.back(g) + decay * w, earlier.T @ g, g.sum()
        hw, hl, hb = hw + gw**2, hl + gl**2, hb + gb**2
        w -= rate * gw / np.sqrt(hw)
        link -= rate * gl / np.sqrt(hl)
        bias -= rate * gb / np.sqrt(hb)
    return bias, w * SCALE, link


#: The model sees percentages of a document's words.
SCALE = 100.0


def _apply(x: _Rows, earlier: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model[0] + x.dot(model[1]) + earlier @ model[2], -40, 40)))


def fit_chain(x: _Rows, labels: np.ndarray, categories: list[str], folds: int = FOLDS, weight: np.ndarray | None = None) -> Chain:
    """One model for each category in order; the next ones learn from out-of-fold probabilities, and so does the threshold.

    A category with one value only predicts that value's share. ``weight`` is how many labelled rows each row stands for (one
    if None); the threshold counts with it.
    """
    chain, earlier = Chain(categories), np.zeros((x.n, 0))
    fold = np.arange(x.n) % folds
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        if x.n < 2 * folds or y.min() == y.max():
            share = y.mean() if len(y) else 0.0
            model = (float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(DIMS), np.zeros(k))
            unseen = np.full(x.n, share)
        else:
            unseen = np.zeros(x.n)
            for f in range(folds):
                out = fold == f
                model = _fit(x.pick(~out), earlier[~out], y[~out])
                unseen[out] = _apply(x.pick(out), earlier[out], model)
            model = _fit(x, earlier, y)
        chain.bias.append(float(model[0])), chain.weights.append(model[1]), chain.links.append(model[2])
        earlier = np.column_stack([earlier, unseen])
    if x.n:
        chain.threshold = _threshold(earlier[:, -1], labels[:, -1], np.ones(x.n) if weight is None else weight)
    return chain


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where out-of-fold F1 of rows that count by ``weight`` is best; in the middle of its range of equal results. 1.01 (never)
    if no row is positive."""
    if not y.any():
        return 1.01
    order = np.argsort(-p, kind="stable")
    hits, score = np.cumsum((weight * y)[order]), p[order]
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][score[:-1] == score[1:]] = -1
    best = int(np.argmax(f1))
    below = score[best + 1] if best + 1 < len(score) else 0.0
    return float((score[best] + below) / 2)


def _sparse(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the feature ids and shares of each row's text, worked out on the executors."""
    src = df.select(*keep, F.col("text").cast("string").alias(unused("text", *keep)))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = once(("features", DIMS), lambda: Recent(80_000))
        for batch in batches:
            ids: list = [None] * batch.num_rows
            shares: list = [None] * batch.num_rows
            for first, end, raw, offsets in text_slices(batch.column(batch.num_columns - 1)):
                starts = word_starts(raw, offsets)
                coded = pieces(raw, starts)
                known = memo.fill(coded.dictionary.to_pylist(), lambda keys: [word_features(k) for k in keys])
                spelt = np.array([any(c.isalpha() for c in k.decode()) for k in coded.dictionary.to_pylist()], bool)
                codes, cuts = coded.indices.to_numpy(), np.searchsorted(starts, offsets)
                for r in range(end - first):
                    words = [known[c] for c in codes[cuts[r] : cuts[r + 1]].tolist()]
                    n = int(spelt[codes[cuts[r] : cuts[r + 1]]].sum())
                    i, c = np.unique(np.fromiter((f for w in words for f in w), np.int64), return_counts=True)
                    ids[first + r], shares[first + r] = i.astype(np.int32), (c / max(n, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=schema.names)

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE_PER_CLASS) -> Chain:
    """Fit the chain on a bounded sample: for each value of the last category the ``sample`` labelled rows of least doc_id hash.

    ``labels`` has doc_id and a 0/1 column for each category; rows with a null there are left out. Copies of a text with the
    same labels count once. For the threshold a sampled row stands for as many rows of its value as the whole table has for
    each one taken, so the threshold does not move with the size of ``labels``.
    """
    bound_batches(docs.sparkSession)
    last = categories[-1]
    clean = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).where(" AND ".join(f"`{c}` IN (0, 1)" for c in categories) + " AND doc_id IS NOT NULL")
    mixed = F.xxhash64("doc_id", F.lit(5))
    held = {r[last]: r["count"] for r in clean.groupBy(last).count().collect()}
    picked = clean.where(F.col(last) == 1).orderBy(mixed, "doc_id").limit(sample).unionByName(clean.where(F.col(last) == 0).orderBy(mixed, "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 x sample rows
    got = _sparse(rows.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", *categories]).drop("copy"), ["doc_id", *categories]).toArrow().sort_by("doc_id")
    x = _Rows([v.values.to_numpy() for v in got["ids"]], [v.values.to_numpy() for v in got["shares"]])
    y = np.column_stack([got[c].to_numpy() for c in categories]) if len(got) else np.zeros((0, len(categories)), int)
    del got
    pa.default_memory_pool().release_unused()
    mix = np.random.default_rng(7).permutation(x.n)  # folds do not follow the order of ids
    back = np.argsort(mix).astype(np.int32)
    x.row = back[x.row]
    y = y[mix]
    stands_for = np.where(y[:, -1] == 1, *(max(1.0, held.get(value, 0) / sample) for value in (1, 0)))
    return fit_chain(x, y, categories, weight=stands_for)


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with ``p_<category>`` (double) and ``toxic`` (boolean) for each row.

    Whole texts are scored: a category's score is the mean of its words' weights, each worked out once per distinct word, so
    it does not depend on length. Texts that are null or have no word are not toxic. Columns of these names, in any case, are
    replaced; repeated rows stay; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    taken = {n.lower() for n in (*names, "toxic")}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(unused("text", *keep)))
    schema = T.StructType([*src.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast((chain, np.column_stack([*chain.weights, np.zeros(DIMS)]).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        k = len(model.categories)
        memo = Recent(80_000)

        def weigh(keys: list[bytes]) -> list[tuple[float, ...]]:
            found = [word_features(key) for key in keys]
            size = np.array([len(f) for f in found])
            out = np.zeros((len(keys), k + 1))
            flat = np.fromiter((i for f in found for i in f), np.int64)
            np.add.at(out, np.repeat(np.arange(len(keys)), size), table[flat])
            out[:, k] = [any(c.isalpha() for c in key.decode()) for key in keys]
            return list(map(tuple, out.tolist()))

        for batch in batches:
            total = np.zeros((batch.num_rows, k + 1))
            for first, end, raw, offsets in text_slices(batch.column(batch.num_columns - 1)):
                starts = word_starts(raw, offsets)
                if len(starts):
                    coded = pieces(raw, starts)
                    each = np.array(memo.fill(coded.dictionary.to_pylist(), weigh))
                    codes, cuts = coded.indices.to_numpy(), np.searchsorted(starts, offsets)
                    for c in range(k + 1):
                        run_sum = np.concatenate(([0.0], np.cumsum(each[codes, c])))
                        total[first:end, c] = np.diff(run_sum[cuts])
            p = model.probabilities(total[:, :k] / np.maximum(total[:, k:], 1))
            words = total[:, k]
            toxic = (p[:, -1] >= model.threshold) & (words > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(p[:, c]) for c in range(k)], pa.array(toxic)], names=schema.names)

    return src.mapInArrow(run, schema)


def label_categories(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The driver's labels as a chain: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"]
