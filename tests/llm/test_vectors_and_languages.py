"""Hard negatives, vector codes and languages against brute force, held-out rows and odd tables."""

import random
import zlib

import numpy as np
import pytest

from quadlake.llm import hard_negatives as hn
from quadlake.llm import language_id as li
from quadlake.llm import vector_codes as vc
from quadlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<float>, label int, score int, part string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, ddl=DDL):
    return spark.createDataFrame([(i, v, c, 7, "x") for i, v, c in rows], ddl)


@pytest.fixture(scope="module")
def odd_rows():
    """Null and repeated ids, null labels, broken vectors, ties, a zero vector, and a third of all rows alike."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.2, 8).tolist(), int(rng.integers(0, 4))) for k in range(-100, 500)]
    rows += [(1000 + k, [0.25] * 8, 1) for k in range(300)]
    rows += [(2000 + k, None, 1) for k in range(2)] + [(2002, [0.1] * 7 + [None], 2), (2003, [NAN] * 8, 1), (2004, [INF] + [0.0] * 7, 1)]
    rows += [(None, [0.25] * 8, 1), (None, [0.2] * 8, 2), (3, [0.3] * 8, None), (4, [0.0] * 8, 1), (300, [0.25] * 8, 2), (300, [0.25] * 8, 2)]
    return rows


def whole(rows, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], c) for i, v, c in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.array(v), c) for i, v, c in kept]


def negatives(rows):
    rows = [(i, x, c if i is None or i % 7 else (c + 1) % 10) for i, x, c in whole(rows, 256) if c is not None]
    place = {None: 1 << 62}
    out = []
    for k, (i, x, c) in enumerate(rows):
        if i is None or i % 100:
            continue
        scores = sorted(((-int(x @ y), place.get(j, j) if j is None else j, n) for n, (j, y, _) in enumerate(rows) if n != k))
        positives = [(s, n) for s, _, n in scores if rows[n][2] == c][:5]
        for s, n in positives:
            window = [(-t, rows[m][0]) for t, _, m in scores if rows[m][2] != c and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, rows[n][0], r + 1, j, -s, t) for r, (t, j) in enumerate(window[:5])]
    return sorted(out, key=repr)


def test_hard_negatives_against_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_PART", 60)
    monkeypatch.setattr(hn, "MOST_PART", 60)
    monkeypatch.setattr(hn, "TILE", 16)
    monkeypatch.setattr(hn, "POOL", 50)
    rows = odd_rows
    got = sorted(map(tuple, hn.hard_negatives(vectors(spark, rows)).collect()), key=repr)
    assert got == negatives(rows)
    assert len(got) > 50


def test_hot_label_and_vector_are_split(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_PART", 60)
    monkeypatch.setattr(hn, "MOST_PART", 60)
    index = hn.build_index(vectors(spark, odd_rows))
    assert index.sizes.max() < 3 * 60 and index.sizes.sum() == index.rows.count()


def test_parts_out_of_reach_are_not_searched(spark, monkeypatch):
    """Far clusters, one label each: no anchor goes to a part that cannot hold a wanted row."""
    monkeypatch.setattr(hn, "LEAST_PART", 50)
    monkeypatch.setattr(hn, "MOST_PART", 50)
    rng = np.random.default_rng(1)
    rows = [(k, (np.eye(8)[k % 8] + rng.normal(0, 0.01, 8)).tolist(), k % 8) for k in range(1, 1601) if k % 7]
    index = hn.build_index(vectors(spark, rows))
    chosen = index.rows.where("vec_id % 100 = 0").selectExpr("*", "array(double('-inf')) lows", "array(double('inf')) highs")
    sent = hn._send(chosen, index, True, 5).count()
    assert sent <= 2 * chosen.count() * len(index.numbers) / 8
    assert sorted(map(tuple, hn.mine(index).collect()), key=repr) == negatives(rows)


def test_score_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (200, 6)) * (rng.random((200, 1)) > 0.05)
    norms = np.sqrt((x * x).sum(1))
    angles = hn.angles_to(x.astype(float), norms, hn.pick_references(x.astype(float), 5))
    low, high = hn.score_bounds(angles, norms, angles, angles, norms, norms)
    assert (low <= x @ x.T).all() and (x @ x.T <= high).all()
    assert np.median(high - low) < 2 * np.median(norms) ** 2


def codes(rows, scale, n_entries, n_parts, rounds):
    kept = sorted(whole(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.stack([r[1] for r in kept])
    size = x.shape[1] // n_parts
    pieces = [x[:, p * size:(p + 1) * size] for p in range(n_parts)]
    books = [piece[:n_entries].copy() for piece in pieces]
    for k in range(rounds + 1):
        d = [((piece[:, None] - book[None]) ** 2).sum(2) for piece, book in zip(pieces, books)]
        at = [m.argmin(1) for m in d]
        if k < rounds:
            for p in range(n_parts):
                for e in set(at[p].tolist()):
                    mine = pieces[p][at[p] == e]
                    books[p][e] = mine.sum(0) // len(mine)
    error = sum(m.min(1) for m in d)
    return sorted(((r[0], "".join(f"{a[k]:02x}" for a in at), int(error[k])) for k, r in enumerate(kept)), key=repr), np.stack(books)


@pytest.mark.parametrize("n_entries, first_b", [(64, 2), (16, 4), (256, 8)])
def test_codes_against_all_distances(spark, odd_rows, monkeypatch, n_entries, first_b):
    monkeypatch.setattr(vc, "FIRST_B", first_b)
    monkeypatch.setattr(vc, "LEAST_B", 1)
    got, books = vc.code_vectors(vectors(spark, odd_rows), n_entries=n_entries, rounds=6)
    want, want_books = codes(odd_rows, 1024, n_entries, 4, 6)
    assert np.array_equal(books, want_books)
    assert sorted(map(tuple, got.select("vec_id", "code", "error").collect()), key=repr) == want


def test_bounds_save_distances_on_clusters(spark, monkeypatch):
    """Tight clusters: after the first moves nearly all parts are settled by their lists."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, 8))
    rows = [(k, (centres[k % 20] + rng.normal(0, 0.01, 8)).tolist(), 0) for k in range(2000)]
    seen = []
    used = vc.Coder.used
    monkeypatch.setattr(vc.Coder, "used", lambda self: seen.append(used(self)) or seen[-1])
    vc.code_vectors(vectors(spark, rows), n_entries=20, rounds=4)
    assert seen[-1][0] == 2000 and seen[-1][1] < 0.05 * 4 * 2000


def test_lists_adapt():
    assert vc.next_length(8, full=900, deep=0, rows=1000) == 16
    assert vc.next_length(vc.MOST_B, full=900, deep=0, rows=1000) == vc.MOST_B
    assert vc.next_length(8, full=0, deep=0, rows=1000) == 4
    assert vc.next_length(8, full=0, deep=500, rows=1000) == 8


def test_label_errors_and_odd_vectors(spark, odd_rows):
    rows = vc.vector_codes(vectors(spark, odd_rows)).collect()
    labels = {}
    for i, _, c in odd_rows:
        labels.setdefault(i, c)
    total = {}
    for r in rows:
        if r.vec_id not in (None, 3, 4, 300):
            total.setdefault(labels[r.vec_id], set()).add(r.label_error)
    assert all(len(v) == 1 for v in total.values())
    ragged = [(1, [0.5, 0.5, 0.5], 1), (2, [0.5], 1), (3, [], None), (4, [0.1] * 5, None)]
    found = {r.vec_id: r for r in vc.vector_codes(vectors(spark, ragged)).collect()}
    assert set(found) == {1, 2, 3, 4} and all(r.error == 0 for r in found.values())
    for query in (vc.vector_codes, hn.hard_negatives):
        assert query(vectors(spark, ragged).where("false")).count() == 0
        assert query(vectors(spark, [(1, None, 1)])).count() == 0
        with pytest.raises(ValueError):
            query(vectors(spark, [(1, [1e30], 1)])).collect()


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.98 * len(judged) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    long = "thing and other " * 40_000
    rows = [(k, " ".join(random.Random(k).choices(words, k=60)), lang) for k in range(200)
            for lang, words in [(("aa", "thing and other".split()), ("bb", "ceci est chose".split()))[k % 2]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "aa"), (903, long, None), (904, "é", None), (None, "ceci est", None), (905, "中文", None),
             (906, "x\x00y", None), (906, "x\x00y", None)]
    docs = spark.createDataFrame([(i, t, c, "s", 0.5) for i, t, c in rows], "doc_id long, text string, lang string, source string, score double")
    got = [tuple(r) for r in li.language_id(docs).collect()]
    assert len(got) == len(rows)
    found = {r[0]: r for r in got}
    assert all(found[k][2:] == ("und", 0.0) for k in (900, 901, 902))
    assert found[903][2] == "aa" and found[None][2] == "bb" and found[904][2] in ("aa", "bb")
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(found[k][2] == ("aa", "bb")[k % 2] for k in held) and len(held) > 20
    unlabelled = docs.withColumn("lang", docs.lang.substr(0, 0)).where("false")
    assert li.language_id(unlabelled).count() == 0
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in li.language_id(none).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    for n in (0, 1, 5, li.WINDOW, li.WINDOW + 1, 3 * li.WINDOW + 7):
        text = "".join(chr(97 + k % 26) for k in range(n))
        windows = li.windows_of(text)
        joined = b"".join(w.tobytes()[:li._STRIDE] for w in windows) + windows[-1].tobytes()[li._STRIDE:]
        assert joined.rstrip(b"\0").decode() == text


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    windows = rng.integers(97, 110, (6, li.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])
    net = li.train(windows, ["ab"[k] for k in y], epochs=1)
    for f in ("vectors", "filters", "offsets", "weights", "bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    mask = (net.filters != 0).astype(float)
    room = li.Room(6, net.filters.shape[1])
    room._flat = [f.astype(np.float64) for f in room._flat]

    def loss():
        shares = net.log_shares(windows, room)
        return -shares[np.arange(6), y].mean()

    gradients = [g.copy() for g in li._gradients(net, windows, y, mask, room)]
    for f, g in zip(("vectors", "filters", "offsets", "weights", "bias"), gradients):
        values = getattr(net, f)
        for place in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(6)]:
            if f == "filters" and not mask[place]:
                continue
            kept = values[place]
            values[place] = kept + 1e-6
            up = loss()
            values[place] = kept - 1e-6
            down = loss()
            values[place] = kept
            assert abs((up - down) / 2e-6 - g[place]) < 1e-5


def test_queries_run(spark):
    for name in ("op11_hard_negatives", "op12_vector_codes", "op13_language_id"):
        assert QUERIES[name](spark, SF).count() > 0
