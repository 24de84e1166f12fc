"""Stages that drop rows move only those that may go; verdicts against plain counts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.llm import jaccard, quality
from quadlake.llm.exact_dedup import drop_copies
from quadlake.llm.screen import screened
from quadlake.llm.words import WordHashes

SF = "/root/testdata/sf0.001"


def test_screen_loses_no_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 3, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    keys = rows.where("doc_id % 50 = 0 OR doc_id IS NULL").select("doc_id").distinct()
    near, clear = screened(rows, "doc_id", keys)
    assert near.columns == clear.columns == rows.columns
    assert near.count() + clear.count() == 20_000
    wanted = rows.join(keys, rows["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi").count()
    assert near.join(keys, near["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi").count() == wanted
    assert near.count() < wanted + 100
    assert screened(rows, "doc_id", keys.where("false"))[0].count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """A hot group, repeated rows, null ids and clashing names."""
    texts = [(k, f"text number {k} with some words to tell it from others {k * k}") for k in range(60)]
    rows = texts + [(100 + k, "one and the same text for a third of all the rows here") for k in range(40)]
    rows += [(None, "one and the same text for a third of all the rows here"), (None, None), (200, None), (201, ""),
             (5, texts[5][1]), (5, texts[5][1]), (7, "another  text"), (7, "anothertext"), (None, "null id alone"), (None, "null id alone")]
    return spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], "doc_id long, text string, sha string, n_chars int, kept boolean")


def test_drop_copies_against_plain_groups(copies):
    groups = {}
    for r in copies.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.text))
    firsts = map(min, ([(a, b, c, d or "") for a, b, c, d in g] for g in groups.values()))
    want = [(None if g[1] else g[2], g[3]) for g in firsts]
    got = drop_copies(copies)
    assert got.columns == copies.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert drop_copies(copies.where("false")).count() == 0


def test_drop_near_copies_of_odd_rows(copies):
    got = sorted(((r.doc_id, r.text) for r in jaccard.drop_near_copies(copies, 5, 80).collect()), key=repr)
    assert (100, "one and the same text for a third of all the rows here") in got
    assert sum(t == "one and the same text for a third of all the rows here" for _, t in got) == 1
    assert [i for i, t in got if t == "null id alone"] == [None]
    assert sum(t is None or not t.strip() for _, t in got) == 3
    assert sum(i == 5 for i, _ in got) == 1


def test_bounded_buckets_give_the_same_links(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, jaccard.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 500)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == want


def test_quality_verdict_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    label = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    raw, good, found = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    rows = docs.collect()
    for r in rows:
        found[r.doc_id] = quality.buckets_of(WordHashes(r.text or ""))
        np.add.at(raw, found[r.doc_id], 1)
        if label.get(r.doc_id) == 1:
            np.add.at(good, found[r.doc_id], 1)
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    rate = {i: float(ratio[f].mean()) if len(f) else 0.0 for i, f in found.items()}
    assert all(abs(got[i].rate - rate[i]) < 1e-9 for i in rate)
    passed = {i for i, r in got.items() if not r.base_failed}
    low = sorted(rate[i] for i in passed if label.get(i) == 1)
    high = sorted(rate[i] for i in passed if label.get(i) == 0)
    threshold = low[max(0, int(np.ceil(quality.IGNORED * len(low))) - 1)]
    if high:
        top = high[int(np.ceil((1 - quality.IGNORED) * len(high))) - 1]
        threshold = (threshold + top) / 2 if top < threshold else threshold
    assert {i for i, r in got.items() if r.kept} == {i for i in passed if rate[i] >= threshold - 1e-12}
    # However the rows are dealt.
    again = quality.quality(docs.repartition(7, "source"), labels.repartition(3))
    assert {r.doc_id: r.kept for r in again.collect()} == {i: r.kept for i, r in got.items()}
