"""Packing of documents into sequences by an order-preserving dynamic programme.

The documents are dealt out by ranges of doc_id, or of other columns that say their order;
within a range their ids form one stream, and only the places of the cuts are chosen. A window is what lies between two
cuts, at most ``width`` ids. Its cost is its padding plus a penalty for the cut at its
end: nothing at the end of a document, little after a sentence, more elsewhere. With
v(j) = cost(j) + position(j), the best cost of a cut at j is

    v(j) = penalty(j) + width + min v(i) over position(j) - width <= position(i) < position(j),

a minimum over a sliding window, which a monotone queue gives in constant time.

Null texts are empty and consist of the end id. Rows with a null doc_id come first and
repeated rows are packed each time; ties are ordered by doc_id and text. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from quadlake.llm.encode import WORD_BPE, encoder
from quadlake.llm.tables import map_rows

WIDTH = 4096
SENTENCE_PENALTY = 4
INNER_PENALTY = 16
# Where a document has no sentence end for so long, it may be cut here and there.
INNER_EVERY = 64
# Ids planned at a time: the last windows of a plan are planned again with what follows.
PLAN_WINDOWS = 256
_SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*(</w>)?")


@functools.cache
def sentence_ends(tokenizer: str) -> np.ndarray:
    """Whether an id ends a sentence, by id."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if _SENTENCE_END.fullmatch(token)]] = True
    return ends


def candidates(doc_ends: np.ndarray, sentences: np.ndarray, every: int = INNER_EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts, from 0 to the end of the last document, and their penalties."""
    total = int(doc_ends[-1])
    penalty = np.full(total + 1, -1, np.int16)
    penalty[sentences] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > every)
    if len(wide):
        inner = np.concatenate([np.arange(places[k] + every, places[k + 1], every) for k in wide])
        penalty[inner] = INNER_PENALTY
        places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: list[int], penalties: list[int], width: int = WIDTH,
              tail: Callable[[int], int] | None = None) -> list[int]:
    """Indexes of the cuts of least cost, the first and the last place included.

    tail: the cost of a last window of a given length, by default its padding.
    """
    value, previous = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        least = places[j] - width
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        v = value[j] = value[i] + penalties[j] + width
        previous[j] = i
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [len(places) - 1]
    if tail is not None and cuts[0]:
        end = places[-1]
        near = range(bisect_left(places, end - width), cuts[0])
        previous[cuts[0]] = min(near, key=lambda i: value[i] - places[i] + tail(end - places[i]))
    while cuts[-1]:
        cuts.append(previous[cuts[-1]])
    return cuts[::-1]


def tail_cost(n: int, width: int = WIDTH) -> int:
    return 0 if n & (n - 1) == 0 else min((n.bit_count() - 1) * INNER_PENALTY, width - n)


def tail_lengths(n: int, width: int = WIDTH) -> list[int]:
    """Lengths for a last window of n ids. A power of two is never padded, so its binary
    digits are windows without padding; taken when that costs less than the padding."""
    if n & (n - 1) == 0 or (n.bit_count() - 1) * INNER_PENALTY >= width - n:
        return [n]
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Packer:
    """Takes documents in order, gives their pieces; holds a bounded stretch of ids."""

    def __init__(self, first_sequence: int, ends: np.ndarray, width: int = WIDTH):
        self._sequence, self._ends, self._width = first_sequence, ends, width
        self._docs: list[tuple] = []  # doc_id, ids, ids of the document that are done
        self._held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self._docs.append((doc_id, ids, 0))
        self._held += len(ids)
        if self._held >= PLAN_WINDOWS * self._width:
            yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self._held:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        left = [ids[done:] for _, ids, done in self._docs]
        doc_ends = np.cumsum([len(x) for x in left])
        # The sentence may end within the document only, not with its end id.
        ends = np.concatenate([self._ends[x] for x in left])
        places, penalties = candidates(doc_ends, np.flatnonzero(ends) + 1)
        # What a plan that is not the last leaves over is planned again: it costs nothing.
        tail = (lambda n: tail_cost(n, self._width)) if last else (lambda n: 0)
        cuts = places[best_cuts(places.tolist(), penalties.tolist(), self._width, tail)].tolist()
        if last:
            lengths = [b - a for a, b in zip(cuts, cuts[1:])]
            lengths[-1:] = tail_lengths(lengths[-1], self._width)
        else:
            keep = max(2, len(cuts) - 4)
            lengths = [b - a for a, b in zip(cuts[:keep], cuts[1:keep])]
        yield from self._pieces(lengths)

    def _pieces(self, lengths: list[int]) -> Iterator[tuple]:
        at = 0  # the document
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, ids, done = self._docs[at]
                take = min(len(ids) - done, length - offset)
                part = ids[done:done + take]
                yield (doc_id, done, take, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self._sequence, offset)
                self._docs[at] = (doc_id, ids, done + take)
                at += done + take == len(ids)
                offset += take
            self._sequence += 1
            self._held -= length
        del self._docs[:at]


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2, width: int = WIDTH,
                   order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in which sequence.

    order: the columns that say in which order documents are packed. sequence_id is the
    range's number times 2 ** 32 plus a running number, so it follows that order.
    """
    from pyspark import TaskContext

    def pack(rows: Iterator[tuple]) -> Iterable[tuple]:
        ids_of, keys = encoder(tokenizer), []
        packer = Packer(TaskContext.get().partitionId() << 32, sentence_ends(tokenizer), width)

        def texts() -> Iterator[str | None]:
            for doc_id, text in rows:
                keys.append(doc_id)
                yield text

        for k, ids in enumerate(ids_of.encode_all(texts())):
            yield from packer.add(keys[k], np.append(ids, np.asarray(end_id, ids.dtype)))
        yield from packer.finish()

    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(*dict.fromkeys((*order, "doc_id", "text"))).repartitionByRange(shards, *order)
               .sortWithinPartitions(*order, "doc_id", "text").select("doc_id", "text"))
    return map_rows(ordered, pack, PIECES)
