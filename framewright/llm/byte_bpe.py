"""Byte-level BPE: encoding by DuckDB recursive queries over token positions in each partition, decoding by ordered aggregation."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bound_batches
from ._text import Recent, once, pattern_starts, pieces, text_slices

#: Token-position rows that one recursive query may make; pieces are dealt to queries by this.
QUERY_ROWS = 1_000_000
#: Longer pieces (bytes) take one merge after another on a heap: a query would make a row for each position in each round.
LONG_PIECE = 1000

#: A pair of ids as one key.
PAIR = 1 << 31

#: Each round joins the positions of unfinished words to the merge table and contracts each word's leftmost pair of least rank.
ENCODE_SQL = f"""
WITH RECURSIVE rounds(round, word, pos, token) AS (
    SELECT 0, word, pos, token FROM seed
    UNION ALL
    (WITH beside AS (
        SELECT round, word, pos, token, token * {PAIR} + lead(token) OVER w AS pair, lag(pos) OVER w AS left_pos
        FROM rounds WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT beside.*, rank FROM beside LEFT JOIN merges USING (pair)
    ), best AS (
        SELECT word, min(rank * 1048576 + pos) AS least FROM ranked WHERE rank IS NOT NULL GROUP BY word
    )
    SELECT round + 1, word, pos, CASE WHEN pos = least & 1048575 THEN rank ELSE token END
    FROM ranked JOIN best USING (word)
    WHERE left_pos IS DISTINCT FROM least & 1048575)
)
SELECT round, word, pos, token FROM rounds
"""

#: The bytes of each document's ids, in order; the column's data are the documents' bytes one after another.
DECODE_SQL = "SELECT i, bytes FROM ids JOIN vocabulary USING (token) ORDER BY i"
#: Ids that one decoding query takes.
DECODE_IDS = 500_000


class ByteBpe:
    """One vocabulary in one single-threaded DuckDB connection of a Python worker."""

    def __init__(self, path: str, limit: int = 120_000):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})
        if max(self.ranks.values()) >= 1 << 31:
            raise ValueError("ranks must fit 31 bits")
        merges = pa.table({"pair": np.array(left, np.int64) * PAIR + np.array(right, np.int64), "rank": np.array(rank, np.int64)})  # noqa: F841
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int64()), "bytes": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary")
        self.memo = Recent(limit)

    def _query(self, words: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        seed = pa.table(
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), size)),
                "pos": pa.array((np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)),
                "token": pa.array(self.byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)),
            }
        )
        self.db.register("seed", seed)
        got = self.db.sql(ENCODE_SQL).to_arrow_table()
        self.db.unregister("seed")
        turn, word, pos, token = (got[c].to_numpy() for c in ("round", "word", "pos", "token"))
        last = np.zeros(len(words), turn.dtype)
        np.maximum.at(last, word, turn)
        done = turn == last[word]  # a word's last round has its ids
        word, pos, token = word[done], pos[done], token[done]
        order = np.lexsort((pos, word))
        cuts = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        ids = token[order].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _heap(self, word: bytes) -> list[int]:
        """The same merges on one long piece: least rank first, the leftmost of equal ones."""
        import heapq

        n = len(word)
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        span = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.ranks.get(span[i] + span[j])) is not None:
                heapq.heappush(heap, (r, i, token[i], token[j]))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            span[i] += span[j]
            token[i], token[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for t in token if t >= 0]

    def _work(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        ids: list = [None] * len(words)
        batch, rows = [], 0

        def flush() -> None:
            nonlocal batch, rows
            if batch:
                for i, got in zip(batch, self._query([words[i] for i in batch]), strict=True):
                    ids[i] = got
            batch, rows = [], 0

        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                ids[i] = [r]
            elif len(w) > LONG_PIECE:
                ids[i] = self._heap(w)
            else:
                batch.append(i)
                rows += len(w) * (len(w) + 1) // 2
                if rows > QUERY_ROWS:
                    flush()
        flush()
        return [(len(i), ",".join(map(str, i)).encode(), np.array(i, np.int32).tobytes()) for i in ids]

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids, one after another in ``ids``, by ordered aggregation. An unknown id fails."""
        length, parts = [], []
        for lo in range(0, len(ids), DECODE_IDS):
            some = np.ascontiguousarray(ids[lo : lo + DECODE_IDS].astype(np.int64))
            self.db.register("ids", pa.table({"i": np.arange(len(some), dtype=np.int32), "token": some}))
            got = self.db.sql(DECODE_SQL).to_arrow_table()["bytes"]
            self.db.unregister("ids")
            if len(got) != len(some):
                raise ValueError("an id is not in the vocabulary")
            for chunk in got.chunks:
                _, offsets, data = chunk.cast(pa.large_binary()).buffers()
                bounds = np.frombuffer(offsets, np.int64, len(chunk) + 1 + chunk.offset)[chunk.offset :]
                length.append(np.diff(bounds))
                parts.append(memoryview(data)[int(bounds[0]) : int(bounds[-1])] if len(chunk) else b"")
        whole = b"".join(parts)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(length)) if length else np.zeros(0, np.int64)))
        cuts = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def of(self, keys: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        return self.memo.fill(keys, self._work)


def _texts(bpe: ByteBpe, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, bytes, bytes]]]]:
    """(row, its pieces) of a column of texts."""
    for first, end, raw, offsets in text_slices(column):
        starts = pattern_starts(raw, offsets)
        coded = pieces(raw, starts)
        known = bpe.of(coded.dictionary.to_pylist())
        codes = coded.indices.to_pylist()
        cuts = np.searchsorted(starts, offsets).tolist()
        for k in range(end - first):
            yield first + k, [known[c] for c in codes[cuts[k] : cuts[k + 1]]]


def encode(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` array<int> and ``n_tokens`` long, as the rank library encodes the whole text without special tokens.

    A null or empty text has no ids. Texts are split by the pattern that goes with the rank files; in each partition the
    distinct pieces are merged by recursive queries. Columns named ids or n_tokens are replaced; repeated rows stay.
    """
    bound_batches(df.sparkSession)
    src = df.select(*[c for c in df.columns if c.lower() not in ("ids", "n_tokens")])
    at = src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("bytes", ranks_path), lambda: ByteBpe(ranks_path))
        for batch in batches:
            ids, n = [], []
            for _, parts in _texts(bpe, batch.column(at)):
                n.append(sum([p[0] for p in parts]))
                ids.append(b"".join([p[2] for p in parts]))
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n, dtype=np.int64))).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n, pa.int64())], names=[*batch.schema.names, "ids", "n_tokens"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` binary: the bytes of its ids. Null ids give null, none give empty bytes; an unknown id fails."""
    bound_batches(df.sparkSession)
    src = df.select(*[c for c in df.columns if c.lower() != "decoded"])
    at = src.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("bytes", ranks_path), lambda: ByteBpe(ranks_path))
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is not in the vocabulary")
            sizes = np.array(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            out = bpe.decode_many(flat.to_numpy(zero_copy_only=False), sizes)
            known = lists.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d if k else None for k, d in zip(known, out, strict=True)], pa.binary())], names=[*batch.schema.names, "decoded"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(df: DataFrame, ranks_path: str, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each row's ``text``: digests of the ids and of what they decode to.

    Each document's own ids are decoded, slice by slice, not what its pieces were. Null is empty; repeated rows stay.
    """
    bound_batches(df.sparkSession)
    src = df.select(*keep, F.col("text").cast("string").alias("text of " + "_".join(keep)))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("bytes", ranks_path), lambda: ByteBpe(ranks_path))
        for batch in batches:
            n, digests, decoded, flat, first, held = [], [], [], [], 0, 0

            def flush() -> None:
                nonlocal flat, first, held
                out = bpe.decode_many(np.frombuffer(b"".join(flat), np.int32), np.array(n[first:], np.int64))
                decoded.extend(hashlib.sha256(d).hexdigest() for d in out)
                flat, first, held = [], len(n), 0

            for _, parts in _texts(bpe, batch.column(batch.num_columns - 1)):
                n.append(sum([p[0] for p in parts]))
                digests.append(hashlib.sha256(b",".join([p[1] for p in parts])).hexdigest())
                flat.append(b"".join([p[2] for p in parts]))
                held += n[-1]
                if held >= DECODE_IDS:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
