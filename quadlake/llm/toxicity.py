"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

The kernel of two words counts the triples of letters they share in order, gaps allowed,
each weighted by DECAY to the power of what it spans; words are marked at both ends.
Triples are hashed, so a word is a sparse vector and the kernel an inner product. The
machine works in the Nystroem space of landmark words taken from the labelled sentences:
phi(w) = K_ll ** -1/2 k(w, landmarks). As all this is linear, the trained machine folds
into one weight per triple, and scoring a word costs a few look-ups per letter.

Insults with inserted characters keep most triples across a gap; characters that are no
letters are dropped from words, and words spelt out letter by letter are joined.

Training is multiple-instance: in each toxic sentence the word with the highest margin
is the witness, all words of clean sentences are negative. A logistic curve over a
text's highest margins, fitted to the labelled texts, gives its score.

Null and empty texts have no word and get the lowest margin. Rows are scored one by one;
null ids are held out by the rule of the empty string's crc32 (0, so they are not held
out). Other columns are ignored. Without any labels of both kinds every score is 0.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.tables import arrow_schema, emit, map_rows, parts
from quadlake.session import cut

DECAY = 0.6
MAX_GAP = 3  # letters between neighbours of a triple
BUCKETS = 1 << 18
LANDMARKS = 192
THRESHOLD = 0.7
# The classifier is fitted on at most so many labelled documents of each class, by hash.
SAMPLE_DOCS = 1200
# Words of a kind the machine is fitted on: the commonest clean ones, then in each round the
# clean ones it takes for insults, and disguises of telling ones. A bound of the fit only.
NEGATIVES = 5_000
ROUNDS = 3
# A word tells the classes apart from this likelihood ratio on.
SURPRISE = 16.0
# Token margins kept per worker: a bound of memory, not of results.
KEPT_TOKENS = 400_000
NO_WORD = -3.0

_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][\s.*_-]+){2,}[^\W\d_](?!\S)")
_GAPS = [(i, j) for i in range(1, MAX_GAP + 2) for j in range(1, MAX_GAP + 2) if i + j <= MAX_GAP + 2]
_WEIGHTS = np.array([DECAY ** (i + j - 2) for i, j in _GAPS])


def tokens_of(text: str | None) -> list[str]:
    """Lower-case tokens between white space, and what spelt-out words spell."""
    if not text:
        return []
    text = text.lower()
    return text.split() + [m[0] for m in _SPELT.finditer(text)]


def word_of(token: str) -> str:
    """The letters of a token."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(word_of, tokens_of(text)) if w]


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight, word) of each different triple of the words, and the words' norms."""
    code = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    keys = []
    for k, (i, j) in enumerate(_GAPS):
        n = len(code) - i - j
        if n <= 0:
            continue
        inside = np.flatnonzero(word[:n] == word[i + j:])
        h = code[inside] * np.uint64(0x9E3779B97F4A7C15) ^ code[inside + i] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[inside + i + j] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        keys.append((word[inside] * BUCKETS + bucket) * 16 + k)
    # Sorted by word and triple, with the kind of gap in the low bits.
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    triple = key >> 4
    starts = np.flatnonzero(np.diff(triple, prepend=-1))
    sums = np.add.reduceat(_WEIGHTS[key & 15], starts) if len(key) else np.empty(0)
    owner, bucket = np.divmod(triple[starts], BUCKETS)
    norms = np.sqrt(np.bincount(owner, sums * sums, len(words)))
    return bucket, sums, owner, np.maximum(norms, 1e-9)


@dataclass
class Machine:
    weights: np.ndarray  # per bucket
    bias: float
    curve: np.ndarray  # the logistic curve over what features() gives

    def margins(self, words: list[str]) -> np.ndarray:
        buckets, weights, owners, norms = _triples(words)
        return np.bincount(owners, self.weights[buckets] * weights, len(words)) / norms + self.bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -40, 40)))


def features(margins: list[float]) -> list[float]:
    """What the logistic curve looks at: the mean of the three highest margins of a
    text's tokens, how many are positive, and how many tokens there are."""
    # Beyond 1 a margin says no more: the machine is trained to reach 1.
    top = [min(m, 1.0) for m in [*heapq.nlargest(3, margins), NO_WORD, NO_WORD, NO_WORD][:3]]
    return [sum(top) / 3, math.log1p(sum(m > 0 for m in margins)), math.log1p(len(margins)), 1.0]


_NEVER = np.array([0.0, 0.0, 0.0, -40.0])


def _dense(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Words by the given buckets only."""
    buckets, weights, owners, norms = _triples(words)
    place = np.searchsorted(columns, buckets)
    place[place == len(columns)] = 0
    hit = columns[place] == buckets
    flat = np.bincount(owners[hit] * len(columns) + place[hit], weights[hit], len(words) * len(columns))
    return flat.reshape(len(words), len(columns)) / norms[:, None]


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a, ca = x1[active], c[active]
        new = np.linalg.solve(ridge + (a * ca[:, None]).T @ a, (a * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve, by Newton steps with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


def _inserted(word: str) -> list[str]:
    """A word with a letter inserted or doubled at each inner place."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in ("x", word[k - 1])]


def train(sample: list[tuple[list[str], int]], odds_of_toxic: float | None = None) -> Machine:
    """Fit on (sentences as words joined by blanks, label) of documents held in memory."""
    docs = [([s.split() for s in sentences], label) for sentences, label in sample]
    counts = [Counter(w for d, label in docs if label == t for w in {w for s in d for w in s}) for t in (1, 0)]
    sizes = [sum(label == t for _, label in docs) for t in (1, 0)]

    def hits(index: dict[str, int]) -> Counter:
        return Counter(tuple(found) for d, label in docs if label == 1 for s in d if (found := sorted({index[w] for w in s if w in index})))

    def found(machine: Machine) -> tuple[np.ndarray, np.ndarray]:
        scorer = Scorer(machine)
        return np.array([scorer.features([w for s in d for w in s]) for d, _ in docs]), np.array([t for _, t in docs], float)

    return learn(*counts, *sizes, hits, found, odds_of_toxic)


def learn(in_toxic: Counter, in_clean: Counter, n_toxic: int, n_clean: int, hits: Callable[[dict[str, int]], Counter],
          found: Callable[[Machine], tuple[np.ndarray, np.ndarray]], odds_of_toxic: float | None = None) -> Machine:
    """Fit from how many documents of each kind have a word.

    hits: how often each combination of the given words makes up what a toxic sentence has
    of them. found: features of the labelled documents, and their labels. odds_of_toxic:
    toxic to clean documents among all labels, if the sample differs.
    """
    if not n_toxic or not n_clean:
        return Machine(np.zeros(BUCKETS), 0.0, _NEVER)

    def odds(w: str) -> float:
        return float(np.log((in_toxic[w] + 0.1) / n_toxic) - np.log((in_clean[w] + 0.5) / n_clean))

    def surprise(w: str) -> float:
        """Twice the log-likelihood ratio of a word's split between the classes."""
        t, c = in_toxic[w], in_clean[w]
        expected = (t + c) * n_toxic / (n_toxic + n_clean)
        return 2 * (t * np.log(t / expected) + (c * np.log(c / (t + c - expected)) if c else 0.0))

    # What marks out few documents may do so by chance.
    telling = {w for w in in_toxic if odds(w) > 1.5 and surprise(w) >= SURPRISE}
    ranked = sorted(telling, key=lambda w: (-surprise(w), w))
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    near = ranked[:LANDMARKS // 2]
    landmarks = list(dict.fromkeys([*near, *common]))[:LANDMARKS]
    columns = np.unique(_triples(landmarks)[0])
    base = _dense(landmarks, columns)
    values, vectors = np.linalg.eigh(base @ base.T)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # K_ll ** -1/2 up to a rotation
    fold = base.T @ root

    def embed(words: list[str]) -> np.ndarray:
        return np.vstack([_dense(words[k:k + 1000], columns) @ fold for k in range(0, len(words), 1000)])

    def folded(weights: np.ndarray) -> np.ndarray:
        full = np.zeros(BUCKETS)
        full[columns] = fold @ weights
        return full

    pool = sorted(telling)
    index = {w: k for k, w in enumerate(pool)}
    sentences = hits(index)
    if not sentences:
        return Machine(np.zeros(BUCKETS), 0.0, _NEVER)
    # What is inserted into a word that clean texts never use must not hide it.
    disguised = [v for w in ranked if not in_clean[w] and len(w) >= 4 for v in _inserted(w)][:NEGATIVES]
    negative, rest = common[:NEGATIVES], common[NEGATIVES:]
    xp, xn, xd = embed(pool), embed(negative), embed(disguised or pool[:1])
    margin = np.array([odds(w) for w in pool])
    for _ in range(ROUNDS):
        chosen = Counter()
        for s, n in sentences.items():
            chosen[max(s, key=lambda k: (margin[k], -k))] += n
        rows = np.array(sorted(chosen), np.int64)
        x = np.vstack([xp[rows], xd, xn])
        y = np.concatenate([np.ones(len(rows) + len(xd)), -np.ones(len(xn))])
        # A word weighs as often as it was chosen or occurred, the classes brought to equal size.
        even = n_clean / n_toxic
        c = np.concatenate([even * np.array([chosen[k] for k in rows.tolist()], float),
                            np.full(len(xd), even), [in_clean[w] for w in negative]])
        weights, bias = _machine(x, y, c)
        margin = xp @ weights + bias
        # Clean words outside the negatives that the machine takes for insults join them.
        if rest:
            judge = Machine(folded(weights), bias, _NEVER)
            wrong = np.concatenate([judge.margins(rest[k:k + 10_000]) for k in range(0, len(rest), 10_000)]) > -0.5
            hard = [w for w, bad in zip(rest, wrong) if bad][:NEGATIVES]
            taken = set(hard)
            rest = [w for w in rest if w not in taken]
            negative, xn = negative + hard, np.vstack([xn, embed(hard)]) if hard else xn
    machine = Machine(folded(weights), bias, _NEVER)
    machine.curve = _logistic(*found(machine))
    if odds_of_toxic:
        machine.curve[-1] += math.log(odds_of_toxic * n_clean / n_toxic)
    return machine


class Scorer:
    """Scores texts; the margins of tokens seen before are kept."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self._kept: dict[str, float] = {}

    def learn(self, tokens: Iterable[str]) -> None:
        if len(self._kept) > KEPT_TOKENS:
            self._kept.clear()
        kept = self._kept
        new = [t for t in tokens if t not in kept]
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            words = [word_of(t) for t in part]
            found = np.maximum(self.machine.margins(words), NO_WORD).tolist()
            kept.update((t, m if w else NO_WORD) for t, w, m in zip(part, words, found))

    def features(self, tokens: list[str]) -> list[float]:
        self.learn(set(tokens))
        return features(list(map(self._kept.__getitem__, tokens)))

    def score_all(self, texts: list[str | None]) -> tuple[list[float], list[list[float]]]:
        """The score and the features of each text."""
        tokens = [tokens_of(t) for t in texts]
        self.learn(set().union(*tokens))
        found = [features(list(map(self._kept.__getitem__, ts))) for ts in tokens]
        return self.machine.scores(np.array(found).reshape(-1, len(_NEVER))).tolist(), found


_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


def sentences_of(text: str) -> list[str]:
    return [" ".join(words) for s in _SENTENCE.split(text) if (words := words_of(s))]


def held_out(doc_id: Column) -> Column:
    """Rows whose label may not be learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Train on at most sample_docs documents of each class that are not held out."""
    usable = (labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
              .where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    # Two top lists of a fixed length: small enough to broadcast.
    chosen = [usable.where(F.col("toxic") == t).orderBy(*order).limit(sample_docs) for t in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = cut(docs.select("doc_id", "text").join(ids, "doc_id")
                .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
                .repartition("doc_id"))
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    odds = counts[1] / counts[0] if len(counts) == 2 else None

    def vocabulary(rows: Iterator[tuple]) -> Iterable[tuple]:
        for text, toxic in rows:
            yield from ((w, toxic) for w in {w for s in sentences_of(text or "") for w in s.split()})

    # Whole texts stay in the tasks: the driver gets words with counts, then combinations of
    # telling words with counts, then a few features of each sampled document.
    words: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in map_rows(texts.select("text", "toxic"), vocabulary, "word string, toxic int").groupBy("word", "toxic").count().collect():
        words[r.toxic][r.word] = r["count"]
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}

    def hits(index: dict[str, int]) -> Counter:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def combine(rows: Iterator[tuple]) -> Iterable[tuple]:
            known = shared.value
            for (text,) in rows:
                for s in sentences_of(text or ""):
                    if found := sorted({known[w] for w in s.split() if w in known}):
                        yield (found,)

        of = map_rows(texts.where("toxic = 1").select("text"), combine, "words array<int>").groupBy("words").count()
        return Counter({tuple(r.words): r["count"] for r in of.collect()})

    def found(machine: Machine) -> tuple[np.ndarray, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def measure(rows: Iterator[tuple]) -> Iterable[tuple]:
            scorer = Scorer(shared.value)
            for doc_id, text, toxic in rows:
                yield doc_id, scorer.features(tokens_of(text)), toxic

        rows = map_rows(texts, measure, "doc_id long, found array<double>, toxic int").collect()
        rows.sort(key=lambda r: r.doc_id)
        return np.array([r.found for r in rows]), np.array([r.toxic for r in rows], float)

    return learn(words[1], words[0], sizes.get(1, 0), sizes.get(0, 0), hits, found, odds)


SCORES = "doc_id long, score double, highest_margin double"


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """The score of every whole text."""
    schema = arrow_schema(SCORES)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (p for b in batches for p in parts(b, 256)):
            scores, found = scorer.score_all(part.column(1).to_pylist())
            yield from emit(zip(part.column(0).to_pylist(), scores, (f[0] for f in found)), schema)

    return docs.select("doc_id", "text").mapInArrow(score, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score and verdict of each document, by a machine trained on the labels."""
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "highest_margin")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (p for b in batches for p in parts(b, 256)):
            scores, _ = scorer.score_all(part.column(place).to_pylist())
            yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
