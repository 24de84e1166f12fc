"""Codes of vectors: one entry of a codebook per part, found with Drake and Hamerly's bounds.

Vectors are whole numbers, cut into PARTS equal parts. The entries of each part's codebook
start as the parts of the first vectors by id. A round assigns each part to its nearest entry
and moves the entries to the floor of their parts' mean; a last pass assigns once more.

With each part a row keeps its entry, the b entries that were next, in the order of lower
bounds on their distance, and one outer bound on all others. When entries have moved, each
bound shrinks by the way of its entry, the outer bound by the longest way. The distance to
the own entry is computed exactly; only the listed entries whose bound does not exceed it
are verified, in whole numbers, ties to the lower index. Only where the outer bound does not
exceed it either, all entries are. Bounds are rounded down and distances up, so a tie is
never left out. Lists shrink where rounds use few of their entries and grow, as they are
built anew, where too many rows fall through to all entries.

The state is written as a table after each pass, and the one before it is removed. A task's
sums per entry are added up by Spark; the driver sees codebooks and counters only.

Rows without a whole vector are left out. Null ids come last, repeated ids count as rows of
their own. With fewer rows than entries the codebooks are shorter; an empty table has no
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.tables import arrow_schema, parts
from quadlake.llm.vectors import extent, is_whole, packed, scaled, unpacked
from quadlake.session import checkpoint_folder, cut, remove

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Length of the lists: at the start, at least and at most.
FIRST_B, LEAST_B, MOST_B = 8, 4, 16
# Lists grow if more than this share of all parts needs every entry, and shrink if no more than
# this share needs the second half of its list.
OVERFLOW, UNUSED = 0.2, 0.02
# Bounds are kept as floats of 16 bits; this covers their rounding and that of square roots.
SLACK, MOST_BOUND = 1e-3, 60_000.0
_BATCH = 2048

_STATE = "vec_id long, label long, whole binary, entry binary, near binary, bounds binary, listed int, full int, deep int"


def _down(x: np.ndarray) -> np.ndarray:
    x = np.where(np.isinf(x), x, np.minimum(x * (1 - SLACK) - SLACK, MOST_BOUND))
    return x.astype(np.float16).astype(np.float32)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole rows to whole entries, exact."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= 1 << 20:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)
        return d.astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def to_entries(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own entries (row, place, component), exact."""
    d = entries - (x[:, None, :] if entries.ndim == 3 else x)
    return (d * d).sum(-1)


@dataclass
class Bounds:
    """What is kept of one part of a batch: entry, next entries in order, their bounds and the outer one."""

    entry: np.ndarray  # (rows,)
    near: np.ndarray  # (rows, b)
    lower: np.ndarray  # (rows, b), ascending
    outer: np.ndarray  # (rows,)


def search_all(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """All entries of each row: the nearest, the b next and a bound on the rest."""
    k = len(entries)
    d = distances(x, entries)
    if d.max(initial=0) < 1 << 54:  # ties to the lower index
        key = d * 256 + np.arange(k)
        key = np.sort(np.partition(key, min(b + 1, k - 1), axis=1)[:, :b + 2], axis=1)
        ranked, order = key >> 8, key & 255
    else:
        order = np.argsort(d, axis=1, kind="stable")[:, :b + 2]
        ranked = np.take_along_axis(d, order, 1)
    near, lower = np.zeros((len(x), b), np.uint8), np.full((len(x), b), np.inf, np.float32)
    n = min(b, k - 1)
    near[:, :n], lower[:, :n] = order[:, 1:n + 1], _down(np.sqrt(ranked[:, 1:n + 1]))
    outer = _down(np.sqrt(ranked[:, b + 1])) if k > b + 1 else np.full(len(x), np.inf, np.float32)
    return Bounds(order[:, 0].astype(np.uint8), near, lower, outer)


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """The bounds after the entries moved, which rows searched all entries, and how deep others looked."""
    lower = _down(np.maximum(old.lower - moved[old.near], 0))
    outer = _down(np.maximum(old.outer - moved.max(), 0))
    own = to_entries(x, entries[old.entry])
    reach = _up(np.sqrt(own))
    full = outer <= reach
    open_ = (lower <= reach[:, None]) & ~full[:, None]
    depth = np.where(open_.any(1), open_.shape[1] - np.argmax(open_[:, ::-1], axis=1), 0) if open_.shape[1] else np.zeros(len(x), int)
    entry, near = old.entry.copy(), old.near.copy()
    rows = np.flatnonzero(open_.any(1))
    for start in range(0, len(rows), 512):
        r = rows[start:start + 512]
        d = np.where(open_[r], to_entries(x[r], entries[near[r]]), np.iinfo(np.int64).max)
        lower[r] = np.where(open_[r], _down(np.sqrt(np.where(open_[r], d, 0))), lower[r])
        best = np.lexsort((near[r], d), axis=1)[:, 0]
        at = np.arange(len(r))
        found, idx = d[at, best], near[r, best]
        wins = (found < own[r]) | ((found == own[r]) & (idx < entry[r]))
        w, place = r[wins], best[wins]
        near[w, place], lower[w, place] = entry[w], _down(np.sqrt(own[w]))
        entry[w] = idx[wins]
    order = np.argsort(lower, axis=1, kind="stable")
    now = Bounds(entry, np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1), outer)
    now = resized(now, b)
    if full.any():
        new = search_all(x[full], entries, b)
        now.entry[full], now.near[full], now.lower[full], now.outer[full] = new.entry, new.near, new.lower, new.outer
    return now, full, depth


def resized(bounds: Bounds, b: int) -> Bounds:
    """Lists of length b: what falls off is covered by the outer bound, new places stay unused."""
    have = bounds.near.shape[1]
    if have > b:
        outer = np.minimum(bounds.outer, bounds.lower[:, b])
        return Bounds(bounds.entry, bounds.near[:, :b].copy(), bounds.lower[:, :b].copy(), outer)
    more = ((0, 0), (0, b - have))
    return Bounds(bounds.entry, np.pad(bounds.near, more), np.pad(bounds.lower, more, constant_values=np.inf), bounds.outer)


def next_length(b: int, full: int, deep: int, rows: int) -> int:
    """The length of lists for the next round, from what this one used."""
    if full > OVERFLOW * rows:
        return min(2 * b, MOST_B)
    return max(b // 2, LEAST_B) if deep <= UNUSED * rows else b


def moved_entries(books: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; unused ones stay."""
    out = books.copy()
    for (p, e), (n, total) in sums.items():
        out[p, e] = [s // n for s in total]
    return out


class Coder:
    """Codebooks and the state table of one table of vectors."""

    def __init__(self, df: DataFrame, n_parts: int, n_entries: int, scale: int, vec_id: str, vector: str, label: str):
        self.spark = df.sparkSession
        self.n_parts, self.scale = n_parts, scale
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"),
                         F.col(label).cast("long").alias("label")).where(is_whole(F.col("v")))
        self.rows = rows
        longest, self.kind = extent(rows, "v", scale)
        self.part = max(-(-longest // n_parts), 1)
        self.n = self.part * n_parts
        # The first vectors by id; equal ids by their components. A top list of fixed length.
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n_entries).select("v").collect()
        whole = scaled(pa.array([r.v for r in first], pa.list_(pa.float64())), self.n, scale)
        self.books = np.stack(np.split(whole, n_parts, axis=1)) if len(whole) else np.zeros((n_parts, 0, self.part), np.int64)
        self.b = FIRST_B
        self.folder = f"{checkpoint_folder(self.spark).rstrip('/')}/codes-{uuid.uuid4()}"
        self.state: DataFrame | None = None
        self.passes = 0

    def _write(self, df: DataFrame) -> None:
        path = f"{self.folder}/{self.passes}"
        df.write.parquet(path)
        self.state = self.spark.read.schema(_STATE).parquet(path)
        if self.passes:
            remove(self.spark, f"{self.folder}/{self.passes - 1}")
        self.passes += 1

    def assign_first(self) -> None:
        schema, n, scale, n_parts, b, kind = arrow_schema(_STATE), self.n, self.scale, self.n_parts, self.b, self.kind
        books = self.spark.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in parts(batch, _BATCH)):
                x = scaled(part.column(1), n, scale)
                found = [search_all(piece, e, b) for piece, e in zip(np.split(x, n_parts, axis=1), books.value)]
                whole = packed(x.astype(kind))
                yield _state_batch(part.column(0), part.column(2), whole, found, np.full(len(x), n_parts), np.zeros(len(x)), schema)

        self._write(self.rows.select("vec_id", "v", "label").mapInArrow(run, _STATE))

    def assign_again(self, old_books: np.ndarray, b: int) -> None:
        schema, n, n_parts, size, kind = arrow_schema(_STATE), self.n, self.n_parts, self.part, self.kind
        # Ways are rounded up, or a bound could shrink too little.
        ways = _up(np.sqrt(((self.books - old_books).astype(np.float64) ** 2).sum(2)))
        shared = self.spark.sparkContext.broadcast((self.books, ways))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, ways = shared.value
            for part in (p for batch in batches for p in parts(batch, _BATCH)):
                if not part.num_rows:
                    continue
                x = unpacked(part.column(2), kind, n).astype(np.int64)
                state, found = _bounds_of(part, n_parts), []
                searched, deep = np.zeros(len(x)), np.zeros(len(x))
                for p in range(n_parts):
                    now, full, depth = reassign(x[:, p * size:(p + 1) * size], books[p], ways[p], state[p], b)
                    found.append(now)
                    searched += full
                    deep += depth > state[p].near.shape[1] // 2
                yield _state_batch(part.column(0), part.column(1), part.column(2), found, searched, deep, schema)

        self.b = b
        self._write(self.state.mapInArrow(run, _STATE))

    def sums(self) -> dict[tuple[int, int], tuple[int, list[int]]]:
        """Count and sum per part and entry: a task adds up its rows, Spark the tasks."""
        n, n_parts, size, k, kind = self.n, self.n_parts, self.part, self.books.shape[1], self.kind
        names = [f"x{j}" for j in range(size)]
        ddl = ", ".join(["slot int", "n long", *[f"{c} long" for c in names]])
        schema = arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_parts * k, size + 1), np.int64)
            for part in (p for batch in batches for p in parts(batch, _BATCH)):
                if not part.num_rows:
                    continue
                x = unpacked(part.column(0), kind, n).reshape(-1, size)
                slots = (unpacked(part.column(1), "u1", n_parts) + np.arange(n_parts) * k).reshape(-1)
                order = np.argsort(slots, kind="stable")
                starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
                used = slots[order][starts]
                total[used, 0] += np.diff(np.append(starts, len(slots)))
                total[used, 1:] += np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
            used = np.flatnonzero(total[:, 0])
            columns = [pa.array(used, pa.int32()), *[pa.array(c) for c in total[used].T]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

        found = (self.state.select("whole", "entry").mapInArrow(run, ddl)
                 .groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect())
        return {divmod(r.slot, k): (r.n, list(r[2:])) for r in found}

    def used(self) -> tuple[int, int, int]:
        """Rows, parts that searched all entries, and parts that looked into the second half of their list."""
        r = self.state.agg(F.count(F.lit(1)), F.sum("full"), F.sum("deep")).first()
        return r[0], r[1] or 0, r[2] or 0


def _state_batch(ids, labels, whole, found: list[Bounds], full: np.ndarray, deep: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    b = found[0].near.shape[1]
    columns = [ids, labels, whole, packed(np.stack([f.entry for f in found], 1)),
               packed(np.concatenate([f.near for f in found], 1)),
               packed(np.concatenate([np.concatenate([f.lower, f.outer[:, None]], 1) for f in found], 1).astype("<f2")),
               pa.array(np.full(len(full), b), pa.int32()), pa.array(full.astype(np.int32)), pa.array(deep.astype(np.int32))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _bounds_of(batch: pa.RecordBatch, n_parts: int) -> list[Bounds]:
    b = batch.column(6)[0].as_py()
    entry = unpacked(batch.column(3), "u1", n_parts)
    near = unpacked(batch.column(4), "u1", n_parts * b)
    bounds = unpacked(batch.column(5), "<f2", n_parts * (b + 1))
    return [Bounds(entry[:, p], near[:, p * b:(p + 1) * b], bounds[:, p * (b + 1):(p + 1) * (b + 1) - 1],
                   bounds[:, (p + 1) * (b + 1) - 1]) for p in range(n_parts)]


def code_vectors(df: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each whole vector, and the codebooks (part, entry, component)."""
    if not 1 <= n_entries <= 256:
        raise ValueError("an entry is one byte")
    coder = Coder(df, n_parts, n_entries, scale, vec_id, vector, label)
    if not coder.books.shape[1]:
        return coder.rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error").where("false"), coder.books
    coder.assign_first()
    b = coder.b
    for k in range(rounds):
        old, coder.books = coder.books, moved_entries(coder.books, coder.sums())
        if k:
            rows, full, deep = coder.used()
            b = next_length(coder.b, full, deep, rows * n_parts)
        coder.assign_again(old, b)
    return coded(coder), coder.books


def coded(coder: Coder) -> DataFrame:
    """Code and error of each row of the last state."""
    n, n_parts, size, kind = coder.n, coder.n_parts, coder.part, coder.kind
    books = coder.spark.sparkContext.broadcast(coder.books)
    ddl = "vec_id long, label long, code string, error long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, _BATCH)):
            x = unpacked(part.column(2), kind, n).astype(np.int64)
            entry = unpacked(part.column(3), "u1", n_parts)
            error = sum(to_entries(x[:, p * size:(p + 1) * size], books.value[p][entry[:, p]]) for p in range(n_parts))
            codes = pa.array([row.tobytes().hex() for row in entry], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, pa.array(error, pa.int64())], schema=schema)

    return coder.state.select("vec_id", "label", "whole", "entry").mapInArrow(run, ddl)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame) -> DataFrame:
    """Codes with their errors, also summed per label, and the digest of the codebooks."""
    rows, books = code_vectors(df)
    rows = cut(rows)
    # Written first, so the planner knows its size: few labels are broadcast, many are not.
    totals = cut(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return (rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")))
