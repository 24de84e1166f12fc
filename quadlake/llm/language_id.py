"""Language identification with a convolutional network over bytes.

A text's UTF-8 bytes, A-Z lower-cased, are cut into windows of WINDOW bytes that overlap by
the widest filter less one, so no run of bytes is lost between two. Each byte becomes a short
vector; filters of several widths slide over these; the highest response of each filter in a
window (max pooling, then rectified) feeds a softmax over the languages. The logarithms of a
text's windows are averaged, weighted by the letters in each, and give its language and score.

The network is written and trained in numpy, by Adam on batches of windows. Windows are cut
from whole labelled texts by the tasks; at most SAMPLE_WINDOWS of them, by hash and in equal
numbers per language, are collected to fit on, and MOST_LANGUAGES languages. Those are the only
bounds; every window of every text is scored. Windows are scored in batches of fixed size, so a very long text takes no more
memory than a short one beside its own bytes.

Null texts and texts without a letter are `und` with score 0, and so is everything if there are
no labelled windows. Repeated and null ids are rows of their own; a null id counts as the empty
string in the hold-out rule. Ties go to the language first in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.llm.tables import arrow_schema, emit, parts

WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width
DEPTH = 8  # components of a byte
# The network is fitted on at most so many labelled windows, shared evenly by the languages.
SAMPLE_WINDOWS = 6_000
# Only so many languages, those with most text, are learnt.
MOST_LANGUAGES = 200
EPOCHS, BATCH, RATE, DECAY = 5, 64, 4e-3, 1e-5
# Windows scored at once.
SCORED = 64
UNKNOWN = "und"

_WIDEST = max(WIDTHS)
_STRIDE = WINDOW - _WIDEST + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Bytes that are part of a letter: a-z, and all bytes of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def windows_of(text: str) -> np.ndarray:
    """The windows of a text, the last one filled up with zero bytes."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    n = max(1, -(-(len(data) - _WIDEST + 1) // _STRIDE))
    filled = np.zeros((n - 1) * _STRIDE + WINDOW, np.uint8)
    filled[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::_STRIDE]


class Room:
    """Memory for a batch of windows, used again for the next one."""

    def __init__(self, n: int, n_filters: int):
        self._flat = [np.empty(size, np.float32) for size in (WINDOW * n * DEPTH, _STRIDE * n * _WIDEST * DEPTH, _STRIDE * n * n_filters)]
        self._depths = (WINDOW, DEPTH), (_STRIDE, _WIDEST * DEPTH), (_STRIDE, n_filters)

    def of(self, n: int) -> list[np.ndarray]:
        return [flat[:places * n * depth].reshape(places, n, depth) for flat, (places, depth) in zip(self._flat, self._depths)]


@dataclass
class Network:
    """Byte vectors, one matrix of all filters (narrow ones padded with zeros), and the softmax."""

    languages: list[str]
    vectors: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (_WIDEST * DEPTH, filters)
    offsets: np.ndarray
    weights: np.ndarray  # (filters, languages)
    bias: np.ndarray

    def responses(self, windows: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, window, filter), and the bytes' vectors the filters saw. Places come first: so the
        highest response is taken over whole blocks of memory."""
        n = len(windows)
        room = room or Room(n, self.filters.shape[1])
        seen, rows, out = room.of(n)
        np.take(self.vectors, windows.T, axis=0, out=seen, mode="clip")
        for k in range(_WIDEST):
            rows[:, :, k * DEPTH:(k + 1) * DEPTH] = seen[k:k + _STRIDE]
        np.matmul(rows.reshape(-1, _WIDEST * DEPTH), self.filters, out=out.reshape(-1, out.shape[2]))
        return out, rows

    def pooled(self, windows: np.ndarray, room: Room | None = None) -> np.ndarray:
        return np.maximum(self.responses(windows, room)[0].max(0) + self.offsets, 0)

    def log_shares(self, windows: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Logarithms of the languages' probabilities for each window."""
        return _log_softmax(self.pooled(windows, room) @ self.weights + self.bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def train(windows: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """Fit on windows and their languages; None without any."""
    if not len(windows):
        return None
    names = sorted(set(languages))
    place = {name: k for k, name in enumerate(names)}
    y = np.array([place[name] for name in languages])
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    # Zero for what a filter narrower than the widest does not see.
    mask = np.concatenate([np.repeat((np.arange(_WIDEST * DEPTH) < w * DEPTH)[:, None], FILTERS, 1) for w in WIDTHS], 1)
    net = Network(names, rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
                  (rng.normal(0, 0.3, (_WIDEST * DEPTH, n_filters)) * mask).astype(np.float32), np.zeros(n_filters, np.float32),
                  rng.normal(0, 0.1, (n_filters, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    net.vectors[0] = 0  # what fills up a window
    fields = ("vectors", "filters", "offsets", "weights", "bias")
    first = {f: np.zeros_like(getattr(net, f)) for f in fields}
    second = {f: np.zeros_like(getattr(net, f)) for f in fields}
    step, room = 0, Room(BATCH, n_filters)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            step += 1
            for f, g in zip(fields, _gradients(net, windows[rows], y[rows], mask, room)):
                g = g + DECAY * getattr(net, f)
                first[f] = 0.9 * first[f] + 0.1 * g
                second[f] = 0.999 * second[f] + 0.001 * g * g
                scale = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                getattr(net, f)[...] -= (scale * first[f] / (np.sqrt(second[f]) + 1e-8)).astype(np.float32)
            net.vectors[0] = 0
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray, mask: np.ndarray, room: Room) -> Iterator[np.ndarray]:
    """Of the mean cross entropy, for vectors, filters, offsets, weights and bias."""
    n = len(windows)
    responses, rows = net.responses(windows, room)
    best = responses.argmax(0)
    top = np.take_along_axis(responses, best[None], 0)[0] + net.offsets
    pooled = np.maximum(top, 0)
    error = np.exp(_log_softmax(pooled @ net.weights + net.bias))
    error[np.arange(n), y] -= 1
    error /= n
    back = (error @ net.weights.T) * (top > 0)
    # Only the place of a filter's highest response takes part.
    seen = rows[best, np.arange(n)[:, None]]  # (window, filter, what it saw)
    filters = np.einsum("nf,nfd->df", back, seen) * mask
    to_vectors = (back[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
    at = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(_WIDEST)].reshape(-1)
    vectors = np.stack([np.bincount(at, to_vectors[:, d], 256) for d in range(DEPTH)], 1)
    yield from (vectors, filters, back.sum(0), pooled.T @ error, error.sum(0))


def scores(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, over all its windows."""
    total = np.zeros((len(texts), len(net.languages)))
    weight = np.zeros(len(texts))
    held: list[np.ndarray] = []
    of: list[np.ndarray] = []
    n_held = 0
    room = Room(SCORED, net.filters.shape[1])

    def run() -> None:
        if not n_held:
            return
        windows, owner = np.concatenate(held), np.concatenate(of)
        letters = _LETTER[windows].sum(1)
        shares = net.log_shares(windows, room)
        np.add.at(total, owner, shares * letters[:, None])
        np.add.at(weight, owner, letters)
        held.clear()
        of.clear()

    for k, text in enumerate(texts):
        if not has_letter(text):
            continue
        windows = windows_of(text)
        for start in range(0, len(windows), SCORED):
            piece = windows[start:start + SCORED]
            if n_held + len(piece) > SCORED:
                run()
                n_held = 0
            held.append(piece)
            of.append(np.full(len(piece), k))
            n_held += len(piece)
    run()
    mean = np.exp(_log_softmax(total / np.maximum(weight, 1)[:, None]))
    best = mean.argmax(1)
    return [(net.languages[b], float(m[b])) if w else (UNKNOWN, 0.0) for b, m, w in zip(best, mean, weight)]


def held_out(doc_id: Column) -> Column:
    """Rows whose language may not be learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


_MIX = np.random.default_rng(20240601).integers(1, 1 << 63, WINDOW // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def places(windows: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each window, by its bytes."""
    h = (np.ascontiguousarray(windows).view("<u8") * _MIX).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def fit(docs: DataFrame, most: int = SAMPLE_WINDOWS) -> Network | None:
    """Train on at most ``most`` windows of documents that are not held out."""
    usable = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
              .select("text", F.col("lang").cast("string").alias("lang")))
    sizes = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    quota = most // len(sizes)
    # A language's windows below this place are about twice those wanted; the tasks send no others.
    below = {r.lang: 2 * quota * _STRIDE / max(r.n, 1) for r in sizes}
    ddl = "lang string, place double, part binary"
    schema = arrow_schema(ddl)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterable[tuple]:
            for part in (p for b in batches for p in parts(b, 64)):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang in below and has_letter(text):
                        windows = windows_of(text)
                        for start in range(0, len(windows), 4096):
                            piece = windows[start:start + 4096]
                            at = places(piece)
                            for k in np.flatnonzero(at < below[lang]).tolist():
                                yield lang, float(at[k]), piece[k].tobytes()

        return emit(rows(), schema, 512)

    # The same window, however often it is there, counts once.
    order = Window.partitionBy("lang").orderBy("place", "part")
    chosen = (usable.mapInArrow(split, ddl).dropDuplicates().withColumn("row", F.row_number().over(order))
              .where(F.col("row") <= quota).select("lang", "part"))
    rows = sorted((r.lang, bytes(r.part)) for r in chosen.collect())
    if not rows:
        return None
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(windows, [lang for lang, _ in rows])


SCORES = "doc_id long, held_out boolean, lang_pred string, score double"


def languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b, 256)):
            found = scores(shared.value, part.column(2).to_pylist())
            columns = [part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, SCORES)


def language_id(docs: DataFrame) -> DataFrame:
    return languages(docs, fit(docs))
