"""Hard negatives by the triangle inequality of angles.

Vectors are whole numbers; a score is their inner product. Each row stores its norm and its
angles to a few reference directions. If a row lies at angle s and an anchor at angle t from
a reference, the angle between them is at least |s - t| and at most min(s + t, 2 pi - s - t);
over all references this gives an interval of their cosine, and times the norms one of the
score. Only rows whose interval overlaps the wanted window are scored, in whole numbers.

Rows are kept in parts of bounded size, sorted by label, nearest reference and angle, and
tiles of some rows within a part. Intervals are taken three times: of whole parts, before an
anchor is sent to one; of tiles; and of rows. Bounds are widened by far more than rounding
can do, so no row is lost, whatever the references are; they are picked from a bounded sample.

First each anchor's positives are found: its best rows of the same label. Each pair of them
then has a window of scores, in which the best rows of other labels are sought. A part gives
its best few for each; Spark ranks these over the parts. No task holds more than a part and
a batch of anchors, whatever label, direction or vector the rows share.

Rows with a null label or without a whole vector take no part; null ids come last in ties, and
repeated ids are rows of their own (two equal anchors are both anchors, and each other's
positives). Ids divisible by SHIFTED have their label moved on by one first. Other columns are
ignored; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.llm.tables import arrow_schema, parts
from quadlake.llm.vectors import extent, is_whole, packed, products, scaled, unpacked
from quadlake.session import cut

SCALE = 256
SHIFTED = 7
ANCHORS = 100
BEST = 5
LOW, HIGH = 80, 100  # percent of the positive's score
REFERENCES = 16
# References are picked among so many rows, by hash. They steer the pruning only.
SAMPLE_ROWS = 4096
# Rows of a part: at least and, up to MOST_PARTS parts, at most. Summaries of all parts are
# broadcast, so there are never more than MOST_PARTS of them.
LEAST_PART, MOST_PART, MOST_PARTS = 2_048, 65_536, 50_000
TILE = 256
ANCHOR_BATCH = 512
# Candidates held for one batch before the best of them are kept.
POOL = 200_000
# Added to angles (kept as floats of 32 bits) and, relatively, to score bounds.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-6

_ROWS = "rid long, part int, vec_id long, label long, whole binary, norm double, angles binary"
_TASK = "part int, kind int, rid long, vec_id long, label long, whole binary, norm double, angles binary, lows array<double>, highs array<double>"
_FOUND = "rid long, place int, found_rid long, vec_id long, score long"
_NO_ID = np.iinfo(np.int64).max


def angles_to(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a right angle where a row has no direction."""
    cosine = x @ references.T / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(np.where(norms[:, None] > 0, cosine, 0.0), -1, 1)).astype(np.float32)


def score_bounds(angles: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray,
                 shortest: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchor, group) on the scores of anchors with groups of rows.

    A group has its least and most angle to each reference and its shortest and longest norm.
    """
    near = np.zeros((len(angles), len(least)))
    far = np.full((len(angles), len(least)), np.pi)
    for r in range(angles.shape[1]):
        t, lo, hi = angles[:, r, None].astype(np.float64), least[None, :, r], most[None, :, r]
        np.maximum(near, np.maximum(t - hi, lo - t), out=near)
        np.minimum(far, np.minimum(t + hi, 2 * np.pi - t - lo), out=far)
    upper = np.cos(np.clip(near - ANGLE_SLACK, 0, np.pi))
    lower = np.cos(np.clip(far + ANGLE_SLACK, 0, np.pi))
    size = norms[:, None]
    slack = SCORE_SLACK * size * longest + SCORE_SLACK
    high = size * np.where(upper >= 0, longest, shortest) * upper + slack
    low = size * np.where(lower >= 0, shortest, longest) * lower - slack
    return low, high


def pick_references(x: np.ndarray, n: int) -> np.ndarray:
    """Unit directions among rows, each as far as possible from those before it."""
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    mean = x.mean(0)
    size = np.linalg.norm(mean)
    chosen = [mean / size if size > 1e-9 else x[0]]
    nearest = x @ chosen[0]
    while len(chosen) < min(n, len(x)):
        k = int(np.argmin(nearest))
        if nearest[k] > 1 - 1e-9:
            break
        chosen.append(x[k])
        nearest = np.maximum(nearest, x @ x[k])
    return np.array(chosen)


@dataclass
class Index:
    """The rows in parts, and what is known of each part."""

    rows: DataFrame
    n: int  # components
    kind: str  # type of components
    numbers: np.ndarray  # of the parts, ascending
    least: np.ndarray  # (part, reference)
    most: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    labels: np.ndarray  # (part, 2): least and greatest label
    sizes: np.ndarray


def build_index(df: DataFrame, n_references: int = REFERENCES, scale: int = SCALE, shifted: int | None = SHIFTED,
                vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", modulus: int = 10) -> Index:
    """Each row with its norm and angles, in parts of bounded size."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & is_whole(F.col("v")))
    if shifted:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % modulus).otherwise(F.col("label")))
    n, kind = extent(rows, "v", scale)
    n = max(n, 1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(SAMPLE_ROWS).collect()
    floats = scaled(pa.array([r.v for r in sample], pa.list_(pa.float64())), n, scale).astype(np.float64)
    shared = df.sparkSession.sparkContext.broadcast(pick_references(floats, n_references))
    ddl = "vec_id long, label long, whole binary, norm double, angles binary, cell int, near float"
    schema = arrow_schema(ddl)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = shared.value
        for part in (p for b in batches for p in parts(b, 4096)):
            if not part.num_rows:
                continue
            x = scaled(part.column(2), n, scale)
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            angles = angles_to(x.astype(np.float64), norms, references)
            cell = angles.argmin(1) if angles.shape[1] else np.zeros(len(x), int)
            near = angles.min(1) if angles.shape[1] else np.zeros(len(x), np.float32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), packed(x.astype(kind)), pa.array(norms), packed(angles.astype("<f4")),
                pa.array(cell, pa.int32()), pa.array(near, pa.float32())], schema=schema)

    measured = cut(rows.select("vec_id", "label", "v").mapInArrow(measure, ddl))
    count = measured.count()
    size = max(LEAST_PART, min(MOST_PART, -(-count // 64)), -(-count // MOST_PARTS))
    # Ids and vectors split a label or a direction that many rows share.
    order = ["label", "cell", "near", "vec_id", "whole"]
    laid = (measured.repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
            .withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
            .select("rid", "part", "vec_id", "label", "whole", "norm", "angles"))
    index = cut(laid)
    return Index(index, n, kind, *_summaries(index))


def _merged(known: dict[int, list], part: int, new: list) -> None:
    """Least and most angles, norms and labels, and the number of rows of a part."""
    old = known.get(part)
    known[part] = new if old is None else [
        np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]),
        min(old[4], new[4]), max(old[5], new[5]), old[6] + new[6]]


def _summaries(index: DataFrame) -> tuple[np.ndarray, ...]:
    """Per part: number, least and most angles, norms, labels, rows. At most MOST_PARTS of them."""
    ddl = "part int, least array<float>, most array<float>, shortest double, longest double, low long, high long, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part, labels, norms = (b.column(k).to_numpy() for k in range(3))
            angles = unpacked(b.column(3), "<f4", -1)
            for p in np.unique(part).tolist():
                at = part == p
                _merged(known, p, [angles[at].min(0), angles[at].max(0), norms[at].min(), norms[at].max(),
                                   labels[at].min(), labels[at].max(), int(at.sum())])
        rows = [(p, v[0].tolist(), v[1].tolist(), *map(float, v[2:4]), *map(int, v[4:])) for p, v in known.items()]
        columns = list(zip(*rows)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    # A part may be read by two tasks, so their summaries are merged once more.
    found: dict[int, list] = {}
    for r in index.select("part", "label", "norm", "angles").mapInArrow(run, ddl).toLocalIterator():
        _merged(found, r.part, [np.array(r.least), np.array(r.most), *r[3:]])
    numbers = sorted(found)
    of = [found[p] for p in numbers]
    least, most = (np.array([v[k] for v in of]) if of else np.zeros((0, 0)) for k in (0, 1))
    shortest, longest, sizes = (np.array([v[k] for v in of]) for k in (2, 3, 6))
    return np.array(numbers, np.int64), least, most, shortest, longest, np.array([v[4:6] for v in of]).reshape(-1, 2), sizes


def _send(anchors: DataFrame, index: Index, same: bool, best: int) -> DataFrame:
    """The anchors once for each part that may hold a wanted row (kind 1 of a task's rows).

    anchors has (rid, vec_id, label, whole, norm, angles, lows, highs), with one window of scores
    for each thing sought. Where all rows of a part are of the anchor's label and enough to fill
    the list, its lower bound is one for the scores sought.
    """
    schema = arrow_schema(_TASK)
    known = Index(None, *[getattr(index, f) for f in ("n", "kind", "numbers", "least", "most", "shortest", "longest", "labels", "sizes")])
    shared = index.rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in (p for batch in batches for p in parts(batch, ANCHOR_BATCH)):
            if not b.num_rows:
                continue
            label = b.column(2).to_numpy()
            low, high = score_bounds(unpacked(b.column(5), "<f4", -1), b.column(4).to_numpy(), s.least, s.most, s.shortest, s.longest)
            has = (s.labels[None, :, 0] <= label[:, None]) & (label[:, None] <= s.labels[None, :, 1])
            only = has & (s.labels[:, 0] == s.labels[:, 1])
            lows, highs = _matrix(b.column(6)), _matrix(b.column(7))
            if same:
                sure = np.where(only & (s.sizes > best), low, -np.inf).max(1)
                wanted = has & (high >= sure[:, None])
            else:
                wanted = ~only & (high >= np.nanmin(lows, 1, initial=np.inf)[:, None]) & (low <= np.nanmax(highs, 1, initial=-np.inf)[:, None])
            a, p = np.nonzero(wanted)
            for start in range(0, len(a), 4096):
                rows = pa.array(a[start:start + 4096])
                taken = [c.take(rows) for c in b.columns]
                part = pa.array(s.numbers[p[start:start + 4096]], pa.int32())
                columns = [part, pa.array(np.ones(len(part), np.int32)), *taken]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return anchors.select("rid", "vec_id", "label", "whole", "norm", "angles", "lows", "highs").mapInArrow(run, _TASK)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows of a matrix, filled up with NaN."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0) or 1), np.nan)
    for k, values in enumerate(lists):
        out[k, :len(values)] = values
    return out


class Part:
    """The rows of one part in tiles."""

    def __init__(self, rows: list[pa.RecordBatch], n: int, kind: str):
        take = pa.Table.from_batches(rows).combine_chunks()
        self.rid, self.label, self.norm = (take[c].to_numpy() for c in ("rid", "label", "norm"))
        self.vec_id = take["vec_id"].fill_null(_NO_ID).to_numpy()
        self.x = unpacked(take["whole"].combine_chunks(), kind, n)
        self.angles = unpacked(take["angles"].combine_chunks(), "<f4", -1)
        order = np.argsort(self.rid, kind="stable")  # the order of the index
        for name in ("rid", "label", "norm", "vec_id", "x", "angles"):
            setattr(self, name, getattr(self, name)[order])
        starts = np.arange(0, len(self.rid), TILE)
        self.tiles = [(s, min(s + TILE, len(self.rid))) for s in starts.tolist()]
        self.least, self.most = (f.reduceat(self.angles, starts, axis=0) for f in (np.minimum, np.maximum))
        self.shortest, self.longest = (f.reduceat(self.norm, starts) for f in (np.minimum, np.maximum))
        self.low_label, self.high_label = (f.reduceat(self.label, starts) for f in (np.minimum, np.maximum))


def best_of_part(part: Part, batch: pa.RecordBatch, n: int, kind: str, same: bool, best: int) -> Iterator[tuple]:
    """(rid, place, found rid, found id, score): the best rows of a part for each anchor and window."""
    rid, label, norm = (batch.column(k).to_numpy() for k in (2, 4, 6))
    x, angles = unpacked(batch.column(5), kind, n), unpacked(batch.column(7), "<f4", -1)
    lows, highs = _matrix(batch.column(8)), _matrix(batch.column(9))
    windows = lows.shape[1]
    floor = lows.copy()  # rises as better rows are known
    pool = np.empty((0, 4), np.int64)  # anchor and window, score, id, row
    held, n_held = [], 0
    low, high = score_bounds(angles, norm, part.least, part.most, part.shortest, part.longest)
    # A part's best tiles come first, so that the floor rises soon.
    for t in np.argsort(-high.max(0), kind="stable").tolist():
        start, end = part.tiles[t]
        mixed = part.low_label[t] != part.high_label[t]
        if same:
            open_ = (part.low_label[t] <= label) & (label <= part.high_label[t])
        else:
            open_ = np.ones(len(label), bool) if mixed else label != part.low_label[t]
        open_ &= ((high[:, t, None] >= floor) & (low[:, t, None] <= highs)).any(1)
        a = np.flatnonzero(open_)
        if not len(a):
            continue
        lo, hi = score_bounds(angles[a], norm[a], part.angles[start:end], part.angles[start:end], part.norm[start:end], part.norm[start:end])
        fits = (part.label[None, start:end] == label[a, None]) if same else (part.label[None, start:end] != label[a, None])
        near = fits & ((hi[:, :, None] >= floor[a, None]) & (lo[:, :, None] <= highs[a, None])).any(2)
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            continue
        scores = products(x[a[rows]], part.x[start:end][columns])
        near = near[np.ix_(rows, columns)]
        if same:
            near &= part.rid[None, start:end][:, columns] != rid[a[rows], None]
        for w in range(windows):
            i, j = np.nonzero(near & (scores >= floor[a[rows], w, None]) & (scores <= highs[a[rows], w, None]))
            if len(i):
                found = start + columns[j]
                held.append(np.stack([a[rows[i]] * windows + w, scores[i, j], part.vec_id[found], part.rid[found]], 1))
                n_held += len(i)
        if n_held > POOL:
            pool, held, n_held = _best([pool, *held], best), [], 0
            of, counts = np.unique(pool[:, 0], return_counts=True)
            last = np.cumsum(counts) - 1
            full = counts == best
            floor.reshape(-1)[of[full]] = np.maximum(floor.reshape(-1)[of[full]], pool[last[full], 1])
    pool = _best([pool, *held], best)
    for u, score, vec_id, found in pool.tolist():
        a, w = divmod(u, windows)
        yield int(rid[a]), w, found, None if vec_id == _NO_ID else vec_id, score


def _best(found: list[np.ndarray], best: int) -> np.ndarray:
    """The first few of each anchor and window: by score, then id, then row."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[rank < best]


def _search(anchors: DataFrame, index: Index, same: bool, best: int) -> DataFrame:
    """(rid, place, found_rid, vec_id, score, rank): the best rows for each anchor and window."""
    n, kind = index.n, index.kind
    schema = arrow_schema(_FOUND)
    none = F.lit(None).cast("array<double>")
    rows = index.rows.select("part", F.lit(0).alias("kind"), "rid", "vec_id", "label", "whole", "norm", "angles",
                             none.alias("lows"), none.alias("highs"))
    # Part k goes to task k: its rows first, then the anchors sent there.
    dealt = (rows.unionByName(_send(anchors, index, same, best))
             .repartitionById(int(index.numbers[-1]) + 1, "part").sortWithinPartitions("part", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = None, [], None
        for batch in batches:
            of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(of) | np.diff(kinds)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
                if start == end:
                    continue
                if of[start] != number:
                    number, held, part = of[start], [], None
                if kinds[start] == 0:
                    held.append(batch.slice(start, end - start))
                    continue
                if part is None:
                    part, held = Part(held, n, kind), []
                for piece in parts(batch.slice(start, end - start), ANCHOR_BATCH):
                    columns = list(zip(*best_of_part(part, piece, n, kind, same, best)))
                    if columns:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    found = dealt.mapInArrow(run, _FOUND)
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found_rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mine(index: Index, anchors: int = ANCHORS, best: int = BEST, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The best negatives in the window of each anchor and positive."""
    chosen = cut(index.rows.where(F.col("vec_id") % anchors == 0).drop("part"))
    everything = chosen.withColumns({"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))})
    positives = cut(_search(everything, index, True, best))
    # Windows in whole numbers: low * p <= 100 * n <= high * p. With a negative p there is none.
    window = positives.where("score >= 0").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.expr(f"double((score * {low} + 99) div 100)").alias("lo"),
        F.expr(f"double(score * {high} div 100)").alias("hi")))).alias("w"))
    pairs = chosen.join(window, "rid").select(*chosen.columns, F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs"), F.col("w.rank").alias("ranks"))
    pairs = cut(pairs)
    negatives = _search(pairs, index, False, best).select(
        "rid", "place", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = (pairs.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode("ranks").alias("place", "positive_rank"))
          .join(positives.select("rid", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score")), ["rid", "positive_rank"]))
    return negatives.join(of, ["rid", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(df: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors."""
    index = build_index(df)
    if not len(index.numbers):
        return index.rows.selectExpr("vec_id AS anchor_id", "vec_id AS positive_id", "1 AS rank", "vec_id AS negative_id",
                                     "0L AS positive_score", "0L AS negative_score")
    return mine(index)
