"""The near-copy join keeps no texts once its links are written, and still finds every link."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from quadlake.llm import jaccard
from quadlake.session import checkpoint_folder


@pytest.mark.parametrize("block_grams", [1_000_000, 500])
def test_no_texts_stay_in_the_shared_folder(spark, block_grams):
    r = random.Random(block_grams)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(80):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(120)] = f"x{r.randrange(9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    found = jaccard.drop_near_copies(docs, 4, 85).count() if block_grams == 1_000_000 else None
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs, 4, 85, block_grams).collect()}

    label = list(range(len(texts)))
    sets = [set(jaccard.gram_set(t, 4).tolist()) for t in texts]
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))
    assert found is None or found == len(set(label))

    kept = [f for new in set(folder.glob("*")) - before for f in new.rglob("*.parquet")]
    assert kept and not [f for f in kept if "text" in pq.read_schema(f).names]


def test_labels_reach_sets_as_rows_of_their_own(spark):
    """Sets of one label need no link, whether the label comes with the text or in another row."""
    texts = ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"]
    rows = [(1, 0, 0, bytes([k]), None, True, False, t) for k, t in enumerate(texts)]
    said = [(1, 0, 0, bytes([k]), bytes([0]), False, False, None) for k in (1, 2)]
    ddl = "family long, block int, part int, sig binary, label binary, probe boolean, mapped boolean, text string"

    def links(*more):
        return jaccard._within(spark.createDataFrame(rows + list(more), ddl), 2, 50, True).where("src is not null").count()

    assert links() == 2
    assert links(said[0]) == 1
    assert links(*said) == 0
