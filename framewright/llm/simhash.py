"""SimHash near-duplicates: pigeonhole blocks of 64-bit fingerprints, joined on equal blocks and verified by Hamming distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bound_batches, unused, written
from .components import components

#: Fingerprints of a block that one group holds; larger blocks are split in parts that meet in pairs. The larger a part, the
#: fewer copies of a hot block's rows travel.
PART = 1024


def fingerprint_bits(words: list[bytes], width: int) -> int:
    """The SimHash of ``words``: a bit is set if over half of the shingles' XXH64 (seed 42) have it; no words give zero."""
    import xxhash

    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = np.array(hashes[lo : lo + 65536], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 5, out: str = "fp") -> DataFrame:
    """``df`` without its text, with ``out`` (long): the fingerprint of ``width``-word shingles.

    Words are runs of non-ASCII-white-space after A-Z are lower-cased; fewer words than ``width`` are one shingle; null and
    blank texts have fingerprint zero. Every row gives one row; a column named ``out`` is replaced.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in (text.lower(), out.lower())]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused("text", *keep)))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_binary()).fill_null(b"")
            found = [fingerprint_bits(t.as_py().lower().split(), width) for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def block_plan(n: int, distance: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): the fewest keys for which chance pairs stay below about one for each fingerprint.

    With ``distance + a`` blocks, close pairs agree in at least ``a`` of them: every choice finds the same links.
    """
    for agree in range(1, 5):
        blocks = distance + agree
        keys = len(list(itertools.combinations(range(blocks), agree)))
        if keys * n / 2 / 2 ** (64 * agree / blocks) <= 0.25:
            return blocks, agree
    return distance + 4, 4


def _block_keys(fp: Column, blocks: int, agree: int) -> Column:
    """All keys of a fingerprint, each of ``agree`` blocks and which ones they are."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).cast("short").alias("k"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (value, least value of its part) of the parts that pairs within ``distance`` connect."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(len(values))).tolist()]


def fingerprint_links(distinct: DataFrame, distance: int = 3, part: int = PART) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp``: links that connect just what pairs within ``distance`` bits connect.

    Fingerprints that share a block key form a group. A group of over ``part`` rows is dealt to parts by hash, and each pair
    of parts is a group of its own, so no task holds a large block; in each, all pairs are verified and a spanning set of
    links is returned, so that a dense block does not emit the square of its size.
    """
    blocks, agree = block_plan(distinct.count(), distance)
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"), blocks, agree)).alias("key")).select("fp", "key.k", "key.bits")
    shared = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.hash("fp", F.lit(7)), F.col("p"))
    dealt = keyed.join(shared, ["k", "bits"]).withColumn("p", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, p - 1)")))
    groups = dealt.groupBy("k", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            flat = lists.flatten().to_numpy()
            u, v = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                values = np.sort(flat[a:b])
                for i, j in _forest(values.view(np.uint64), distance):
                    u.append(values[i]), v.append(values[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return groups.select("fps").mapInArrow(run, "u long, v long").distinct()


def near_duplicate_classes(docs: DataFrame, width: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text): component_id is the least doc_id reachable by links.

    Rows of equal fingerprint are one node with its least doc_id, found by partial aggregation, so a group of copies is
    never gathered. A null doc_id takes part in links but does not name a component of others; alone it has a null one.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), width=width), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    member = components(fingerprint_links(nodes.select("fp"), distance))
    named = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "component").select("fp", "component_id", "n")
    # Rows that are alone keep their own id; the rest, however many copies there are, get theirs from a join that can be split.
    return prints.join(linked.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row; edge cases as in ``near_duplicate_classes``."""
    rows = near_duplicate_classes(docs, width, distance)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: wider fingerprints, whose blocks are drawn so that a similar pair shares one with high chance,
# find candidates; their shingle sets are compared exactly.

#: Bits of a wide fingerprint, as four mixes of each shingle's hash.
WIDE = 256
#: Candidates may differ in this share of bits beyond the expected one: five standard deviations of a long text's, over
#: three of the shortest sets at 0.8 (four of five shingles, 48 bits expected).
CANDIDATE_SLACK = 0.12
#: The chance that a pair at the stated similarity shares no block.
MISSED = 0.03
#: Sets and their bytes in one part of a group of candidates; parts of larger groups meet in pairs.
VERIFY_ROWS = 512
VERIFY_BYTES = 6 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct ``width``-word shingles as sorted XXH64 (seed 42); fewer words are one shingle, no words none."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """A 256-bit SimHash of a shingle set: four mixed copies of each hash; an empty set gives zeros."""
    if not len(shingles):
        return bytes(WIDE // 8)
    total = np.zeros(WIDE, np.int64)
    for lo in range(0, len(shingles), 255 * 32):
        h = shingles[lo : lo + 255 * 32, None] + _MIX[None, :]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for at in range(0, len(bits), 255):
            total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def _node(shingles: np.ndarray) -> int:
    """What names a shingle set: equal sets are one node."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 64) - (1 << 63)


def bit_share(similarity: float) -> float:
    """The share of bits in which shingle sets of this Jaccard similarity and equal size are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def missed_share(similarity: float, width: int, many: int) -> float:
    """The chance that a pair at ``similarity`` shares none of ``many`` blocks of ``width`` bits, over what its distance may be."""
    p, d = bit_share(similarity), np.arange(WIDE + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, WIDE + 1)))))
    weight = np.exp(logs[WIDE] - logs[d] - logs[WIDE - d] + d * np.log(p) + (WIDE - d) * np.log1p(-p))
    return float((weight * (1 - (1 - d / WIDE) ** width) ** many).sum())


def drawn_blocks(n: int, similarity: float, missed: float = MISSED) -> list[np.ndarray]:
    """Blocks (bit positions) for ``n`` fingerprints: wide enough that chance pairs stay in proportion to ``n``, and so many
    that a pair at ``similarity`` shares none with a chance of at most ``missed``; closer pairs are missed far less often."""
    width = int(min(30, max(16, np.ceil(np.log2(max(n, 2))) + 1)))
    many = 8
    while missed_share(similarity, width, many) > missed:
        many += 8
    rng, out = np.random.default_rng(64), []
    while len(out) < many:
        order = rng.permutation(WIDE)
        out += [np.sort(order[i : i + width]) for i in range(0, WIDE - width + 1, width)]
    return out[:many]


def _near_lists(bounds: np.ndarray, nodes: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each list: all near pairs of short lists, a spanning set of long ones."""
    size, u, v = np.diff(bounds), [], []
    for n in range(2, 9):
        at = bounds[:-1][size == n]
        for i, j in itertools.combinations(range(n), 2):
            near = np.bitwise_count(prints[at + i] ^ prints[at + j]).sum(axis=1) <= most
            u.append(nodes[at[near] + i]), v.append(nodes[at[near] + j])
    for k in np.flatnonzero(size > 8).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        label = np.arange(b - a)
        near = np.zeros((b - a, b - a), bool)
        for lo in range(0, b - a, 64):
            near[lo : lo + 64] = np.bitwise_count(prints[a + lo : min(a + lo + 64, b), None] ^ prints[None, a:b]).sum(axis=2) <= most
        while True:
            new = np.where(near, label[None, :], b - a).min(axis=1)
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(b - a))
        u.append(nodes[a + moved]), v.append(nodes[a + label[moved]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(u), join(v)


def verified_links(nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between sets whose Jaccard similarity is at least ``similarity``, compared exactly; only
    pairs of fingerprints within ``most`` bits are. A pair that other links connect already is not compared again."""
    size = np.array([len(x) for x in sets], np.int64)
    label, u, v = np.arange(len(sets)), [], []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(label[rest] != label[i]) & (np.minimum(size[rest], size[i]) + 1e-9 >= similarity * np.maximum(size[rest], size[i]))]
        rest = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1) <= most]
        for lo in range(0, len(rest), 64):
            some = rest[lo : lo + 64]
            some = some[label[some] != label[i]]
            if not len(some) or not size[i]:
                continue
            flat = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(size[some])[:-1])))
            for j in some[both + 1e-9 >= similarity * (size[i] + size[some] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    u.append(nodes[i]), v.append(nodes[j])
    return np.array(u, np.int64), np.array(v, np.int64)


def text_key(text: Column) -> Column:
    """What tells the texts of one doc_id apart; null and empty texts are both blank."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.coalesce(F.octet_length(text), F.lit(0)))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, part: int = PART) -> DataFrame:
    """(doc_id, text_key, node, component, keep_id) of each row of ``docs``: groups of exact and near copies.

    Texts link when the Jaccard similarity of their sets of ``width``-word shingles is at least ``similarity``. ``node``
    stands for a set (a 64-bit hash of it). Wide fingerprints only find candidates: pairs that share a drawn block and
    differ in somewhat more bits than is expected at ``similarity`` make groups of candidates; in each, the sets themselves
    are compared, and the links that hold give ``component``. No fingerprint has a bound on the bits in which sets at 0.8
    differ, so blocks are drawn: a pair at ``similarity`` is missed with a chance of MISSED, closer ones far less often.
    ``keep_id`` is the least doc_id of a component. Blank texts are copies of each other; a null doc_id names no component;
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    most = int(WIDE * (bit_share(similarity) + CANDIDATE_SLACK))
    src = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            fps, names = [], []
            for t in column:
                shingles = shingle_set(t.as_py().lower().split(), width)
                fps.append(wide_fingerprint(shingles)), names.append(_node(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(names, pa.int64())], names=["doc_id", "text_key", "fp", "node"])

    prints = written(src.mapInArrow(run, "doc_id long, text_key long, fp binary, node long"), "copies")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("one")
    nodes = written(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id"), one), "copies-nodes")
    blocks = drawn_blocks(nodes.count(), similarity)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1).astype(np.float64)
            keys = np.column_stack([(bits[:, b] @ (2.0 ** np.arange(len(b)))).astype(np.int64) | (k << 32) for k, b in enumerate(blocks)])
            for lo in range(0, len(keys), 500):
                some = keys[lo : lo + 500]
                yield pa.RecordBatch.from_arrays([pa.array(some.ravel()), pa.array(np.repeat(batch.column(0).to_numpy()[lo : lo + 500], some.shape[1]))], names=["key", "node"])

    keyed = nodes.select("node", "fp").mapInArrow(key, "key long, node long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(shared, "key").withColumn("p", F.ceil(F.col("n") / part).cast("int")).withColumn("own", F.pmod(F.hash("node", F.lit(7)), F.col("p")))
    dealt = dealt.join(nodes.select("node", "fp"), "node").withColumn("other", F.explode(F.expr("sequence(0, p - 1)")))
    groups = dealt.groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(F.struct("node", "fp")).alias("list"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            flat = lists.flatten()
            names = flat.field("node").to_numpy()
            fps = np.frombuffer(b"".join(flat.field("fp").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            u, v = _near_lists(bounds, names, fps, most)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    candidates = components(groups.select("list").mapInArrow(link, "u long, v long").distinct()).withColumnRenamed("component", "candidates")
    asked = nodes.join(candidates, "node").select(F.col("one.doc_id").alias("at_id"), F.col("one.text_key").alias("at_key"), "node", "candidates")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            sets = [shingle_set(t.as_py().lower().split(), width) for t in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([wide_fingerprint(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "candidates", "fp", "shingles"])

    found = src.join(asked, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    spelt = found.select("node", "candidates", "text").mapInArrow(spell, "node long, candidates long, fp binary, shingles binary")
    spelt = written(spelt.dropDuplicates(["node"]), "copies-sets")
    sizes = spelt.groupBy("candidates").agg(F.greatest(F.ceil(F.count("*") / VERIFY_ROWS), F.ceil(F.sum(F.length("shingles")) / VERIFY_BYTES)).cast("int").alias("p"))
    split = spelt.join(sizes, "candidates").withColumn("own", F.pmod(F.hash("node", F.lit(9)), F.col("p"))).withColumn("other", F.explode(F.expr("sequence(0, p - 1)")))
    meet = split.groupBy("candidates", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(F.struct("node", "fp", "shingles")).alias("list"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                flat = batch.column(0).slice(r, 1).flatten()
                fps = np.frombuffer(b"".join(flat.field("fp").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
                sets = [np.frombuffer(x, np.uint64) for x in flat.field("shingles").to_pylist()]
                u, v = verified_links(flat.field("node").to_numpy(), fps, sets, most, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    member = components(meet.select("list").mapInArrow(verify, "u long, v long")).withColumnRenamed("node", "linked")
    named = nodes.join(member, F.col("node") == F.col("linked"), "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("keep_id"))
    return prints.join(named.join(least, "component").select("node", "component", "keep_id"), "node").select("doc_id", "text_key", "node", "component", "keep_id")


def drop_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: the one of least doc_id, then least text hash.

    All columns of ``docs`` come back, extra ones too. A row is its doc_id and its text: of two texts with one doc_id that are
    no copies both stay, and of repeated rows one. Rows without a doc_id cannot be named and stay; of blank texts one stays;
    an empty table gives no rows.
    """
    names = docs.columns
    key, at_id, at_key = (unused(n, *names) for n in ("text_key", "kept_id", "kept_key"))
    marked = near_copies(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), width, similarity)
    own = marked.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = own.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("x"))
    keep = written(first.select(F.col("x.doc_id").alias(at_id), F.col("x.text_key").alias(at_key), F.col("x.n").alias("n")), "copies-kept")
    rows = docs.where("doc_id IS NOT NULL").withColumn(key, text_key(F.col("text")))
    match = (F.col("doc_id") == F.col(f"`{at_id}`")) & (F.col(f"`{key}`") == F.col(f"`{at_key}`"))
    once_each = rows.join(keep.where("n = 1"), match, "left_semi")
    again = rows.join(keep.where("n > 1"), match, "left_semi").dropDuplicates(["doc_id", key])
    every = [F.col(f"`{n}`") for n in names]
    return once_each.select(*every).unionByName(again.select(*every)).unionByName(docs.where("doc_id IS NULL"))
