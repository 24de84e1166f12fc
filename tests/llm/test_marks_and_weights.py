"""Rules as a frame, hosts without a path, target weights, and the mix against a plain scheduler."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadlake.llm import mixing, url_filter


# URL rules

def verdicts(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [r.verdict for r in url_filter.judge(pages, rules).orderBy("page_id").collect()]


def test_host_words_need_no_path(spark):
    urls = ["http://casino.com", "http://casino.com?x=1", "http://www.bet.net", "http://bet.net#a", "http://my-pills.org",
            "http://ads-track.net", "http://casino.com/", "http://alphabet.net", "http://x.net/casino.html", "http://x.net?casino.com"]
    assert verdicts(spark, urls, url_filter.METHOD_RULES) == ["block"] * 7 + ["allow"] * 3


def test_rules_as_a_frame(spark):
    rules = spark.createDataFrame([
        (7, "shop", r"^shop\.", "block", 1, ["Shop"], None),
        (8, "any", r"\.pdf$", "allow", 2, None, None),
        (3, "tie", r"^shop\.a", "allow", 1, ["shop"], []),
        (9, "one", r"^(x|y)\.", "block", 1, [], ["x", "y", "x"])], url_filter.RULE_ROWS)
    urls = ["http://shop.b/", "http://shop.a/", "http://shop.b/z.pdf", "http://y.c", "http://z.c", None, "http://" + "x." * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules, default="none").orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [
        ("shop", "block"), ("tie", "allow"), ("any", "allow"), ("one", "block"), (None, "none"), (None, "none"), ("one", "block")]
    assert verdicts(spark, ["http://a.org/"], spark.createDataFrame([], url_filter.RULE_ROWS)) == ["allow"]


def test_many_rules_and_many_empty_hosts(spark):
    rules = (spark.range(3000).select(
        F.col("id").alias("rule_id"), F.concat(F.lit("r"), "id").alias("rule"), F.concat(F.lit("^site"), "id", F.lit("\\.com")).alias("pattern"),
        F.lit("block").alias("verdict"), F.lit(1).alias("rank"), F.array(F.concat(F.lit("site"), "id"), F.lit("com")).alias("tokens"),
        F.array().cast("array<string>").alias("either")))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.concat(
        F.lit("http://site"), (F.col("id") % 4000).cast("string"), F.lit(".com/"))).alias("url"))
    got = url_filter.judge(pages, rules)
    assert got.count() == 6000
    assert got.where("verdict = 'block'").count() == sum(1 for i in range(0, 6000, 2) if i % 4000 < 3000)
    assert got.where("rule IS NOT NULL AND rule <> concat('r', page_id % 4000)").count() == 0


# mixing

def plain_schedule(weights, slots):
    """The group of each slot: of the released blocks the one due first, then the first group."""
    period, had, chosen = sum(weights), [0] * len(weights), []
    for t in range(slots):
        released = [(-(-(had[k] + 1) * period // w), k) for k, w in enumerate(weights) if had[k] * period // w <= t]
        k = min(released)[1]
        had[k] += 1
        chosen.append(k)
    return chosen


def test_schedule_equals_a_plain_one(spark):
    for weights in ([1], [3, 2], [7, 1, 1, 4], [1, 1, 1], [90, 5, 3, 2]):
        period = sum(weights)
        order = [r.grp for r in mixing.schedule(spark, weights).orderBy("slot").collect()]
        assert order * 3 == plain_schedule(weights, 3 * period)


def by_slot(found):
    return sorted((r for r in found if r["__in_mix"]), key=lambda r: (r["__slot"], r["__place"]))


def test_mix_equals_a_plain_one(spark):
    names = ["a"] * 300 + ["b"] * 90 + [None] * 40
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    targets = {"a": 0.5, "b": 0.25, None: 0.25}
    got = [r.doc_id for r in by_slot(mixing.mix(docs, block_rows=4, period=64, targets=targets).collect())]
    bucket = {r.doc_id: r.b for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    queues = [sorted((k for k, n in enumerate(names) if n == s), key=lambda k: (bucket[k], k)) for s in ("a", "b", None)]
    want = []
    for k in plain_schedule([32, 16, 16], 1000):
        if not queues[k]:
            break
        want += queues[k][:4]
        queues[k] = queues[k][4:]
    assert got == want and got


@pytest.mark.parametrize("targets", [{"a": 1, "b": 1}, {"a": 5, "b": 1, None: 2}, {"b": 2.5, "gone": 4}, {"a": 1, "b": 0}])
def test_target_weights_hold(spark, targets):
    names = (["a"] * 2000 + ["b"] * 1000 + [None] * 500 + ["c"] * 10)
    docs = spark.createDataFrame([(k, f"t{k}", s) for k, s in enumerate(names)], "doc_id long, text string, source string")
    found = mixing.mix(docs, targets=targets).collect()
    assert len(found) == len(names)
    asked = {s for s, w in targets.items() if w > 0 and s in names}
    kept = by_slot(found)
    assert {r.source for r in kept} == asked
    assert all(r["__slot"] is None and not r["__in_mix"] for r in found if r.source not in asked)
    total = sum(targets[s] for s in asked)
    blocks = sorted({(r["__slot"], r.source is None, r.source) for r in kept})
    had = Counter()
    for t, (_, _, s) in enumerate(blocks, 1):
        had[s] += 1
        # Weights are rounded to slots of the period, far below a block here.
        assert all(abs(had[x] - t * targets[x] / total) < 1.2 for x in asked)
    # It ends only where a source has run dry.
    ran_dry = [s for s in asked if sum(r.source == s for r in kept) == names.count(s)]
    assert ran_dry


def test_odd_weights(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    for bad in ({}, {"a": 0}, {"a": -1}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.mix(docs, targets=bad)
    assert mixing.mix(docs, targets={"x": 1}).where("__in_mix").count() == 0
    assert mixing.mix(docs.where("false"), targets={"a": 1}).count() == 0


def test_null_ids_are_spread_and_small_sources_are_a_group(spark):
    rows = [(None, f"t{k}", "a") for k in range(3000)] + [(k, "x", f"tiny{k}") for k in range(20)] + [(k, "x", "b") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, most=None, period=64).collect()
    assert len(found) == len(rows) and len({(r["__slot"], r["__place"]) for r in found}) == len(rows)
    groups = {s: {r["__group"] for r in found if r.source == s} for s in ("a", "b", "tiny0", "tiny19")}
    assert groups["tiny0"] == groups["tiny19"] and not groups["tiny0"] & (groups["a"] | groups["b"])
