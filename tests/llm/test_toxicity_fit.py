"""The string kernel against its definition, and fits on whole texts."""

import itertools
import zlib

import numpy as np
import pytest

from quadlake.llm import toxicity


def kernel(a, b):
    """Sum over shared letter triples, gaps allowed, of the products of their weights."""
    def weights(word):
        marked = "\x01" + word + "\x01"
        out = {}
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if (k - i) <= toxicity.MAX_GAP + 2:
                t = marked[i] + marked[j] + marked[k]
                out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    size = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[t] * y.get(t, 0) for t in x) / size


def test_kernel_is_that_of_gapped_triples():
    words = ["insult", "inxsult", "i", "an", "insulting", "zebra", "aaaa", "münze"]
    columns = np.unique(toxicity._triples(words)[0])
    dense = toxicity._dense(words, columns)
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        assert dense[i] @ dense[j] == pytest.approx(kernel(a, b), abs=1e-9)


def test_whole_texts_are_fitted(spark):
    """Insults that come after tens of thousands of characters are learnt and found."""
    filler = "the quick brown fox and some other plain words go on here. "
    insults = ["grumblewart", "snotfozzle"]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 2
        text = filler * (500 if k % 4 < 2 else 3) + (f"you are a {insults[k // 2 % 2]} my friend." if toxic else "you are a kind sort my friend.")
        rows.append((k, text))
        labels.append((k, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1}
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks).collect()}
    assert all(found[k] == k % 2 for k in held) and len(held) > 40
    # Labels of held-out rows change nothing.
    other = marks.selectExpr("doc_id", "IF(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(docs, other).collect()} == found
