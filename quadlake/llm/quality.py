"""Quality rules: base rules of form, then a hashed n-gram likelihood ratio.

The features of a document are its words and pairs of neighbouring words, hashed into a
fixed number of buckets. Two multinomials are estimated from bucket counts, one over the
documents labelled good, one over all documents; a document's rate is the mean over its
features of log p_target - log p_raw. Every document is held against one threshold, half
way between the rates that all but a small share of the labelled good documents exceed
and of the labelled bad ones fall short of (or the former alone, where they overlap); no
draw is made.

All labelled documents count, however many; labels without a document have no part.

A null or empty text has no word and fails the base rules. Rows are judged one by one,
so repeated rows and null ids give a row each. Other columns are ignored. Without labels
of good documents the ratio is 0 for every document and decides nothing. Texts are held one
by one, however long; an empty table has no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.screen import screened
from quadlake.llm.tables import map_rows
from quadlake.llm.words import WordHashes
from quadlake.operators.scan import Pages
from quadlake.session import cut

BUCKETS = 1 << 14
# The share of labelled documents on either side that the threshold may ignore.
IGNORED = 0.002
SMOOTHING = 1.0
MIN_WORDS = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True  # fixed values: the characters that count as symbols


def buckets_of(words: WordHashes) -> np.ndarray:
    """Buckets of the single words and the pairs of a text."""
    h = words.lower
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) if len(h) > 1 else h[:0]
    mixed = np.concatenate((h, pairs * np.uint64(0xD6E8FEB86659FD93)))
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """Bucket counts over the column text: each task adds up its own, Spark adds the tasks'."""
    def count(rows: Iterator[tuple]) -> Iterable[tuple]:
        total = np.zeros(BUCKETS, np.int64)
        for text, in rows:
            if text:
                total += np.bincount(buckets_of(WordHashes(text)), minlength=BUCKETS)
        yield from ((int(k), int(total[k])) for k in np.flatnonzero(total))

    out = np.zeros(BUCKETS, np.int64)
    # One row for each bucket at most.
    for r in map_rows(texts.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _counts(docs: DataFrame, marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over the trusted and over all documents. Only texts that may be trusted
    meet the labels, so others are not moved however many labels there are."""
    good = marks.where("quality = 1").select("doc_id")
    near, _ = screened(docs.select("doc_id", "text"), "doc_id", good)
    return _bucket_counts(near.join(good, "doc_id", "left_semi")), _bucket_counts(docs)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = ((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (target, raw))
    return np.log(p) - np.log(q)


def base_features(text: str | None, words: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    h, repeated = words.exact, 0
    if len(h) > 2:
        a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        windows = (h[:-2] * a) ^ ((h[1:-1] * b) >> np.uint64(3)) ^ (h[2:] * c)
        windows = (windows ^ (windows >> np.uint64(29))) * b
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows) + 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        repeated = int(np.count_nonzero(covered))
    return len(h), words.n_chars, int(np.count_nonzero(_SYMBOLS[words.data])), repeated_lines, repeated


FEATURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, rate double")


def features(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def measure(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in rows:
            words = WordHashes(text or "")
            found = buckets_of(words)
            yield doc_id, *base_features(text, words), float(shared.value[found].mean()) if len(found) else 0.0

    return map_rows(docs.select("doc_id", "text"), measure, FEATURES)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def marks_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of all labelled documents."""
    return cut(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
               .agg(F.min("quality").alias("quality")))


def _ranked(rates: DataFrame, share: float) -> float | None:
    """The least rate that at least this share of the rates does not exceed: an exact rank,
    found in sorted parts."""
    pages = Pages(rates.select("rate"), [F.col("rate")])
    return pages.page(1, max(math.ceil(pages.total * share), 1) - 1).first().rate if pages.total else None


def threshold_of(measured: DataFrame, marks: DataFrame, ignored: float = IGNORED) -> float:
    """The lowest rate of a kept document, from the labelled ones that pass the base rules.

    The quantiles are exact ranks among the rates of all labelled documents. Of several
    documents with one id the least rate counts.
    """
    rates = cut(measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "rate")
                .join(marks, "doc_id").groupBy("quality", "doc_id").agg(F.min("rate").alias("rate")))
    low, high = _ranked(rates.where("quality = 1"), ignored), _ranked(rates.where("quality = 0"), 1 - ignored)
    if low is None:
        return 0.0
    return (low + high) / 2 if high is not None and high < low else low


def quality(docs: DataFrame, labels: DataFrame, ignored: float = IGNORED) -> DataFrame:
    """Base features and verdict of each document."""
    marks = marks_of(labels)
    # A few numbers for each document, read for the threshold and for the verdicts.
    measured = cut(features(docs, log_ratio(*_counts(docs, marks))))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("rate") >= threshold_of(measured, marks, ignored))).alias("kept"), "rate")
