"""The operators against brute force, exact round trips and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from quadlake.llm import (
    chat, encode, exact_dedup, jaccard, mixing, packing, quality, simple8b, token_counts, token_files, toxicity,
    url_filter,
)
from quadlake.llm.queries import QUERIES
from quadlake.llm.words import WordHashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["don't", "x's'", "!'s", "a_b", "3rd.", "≠a", "é", "—", "<|endoftext|>", " \n", " ", "  ", "''", "'re",
       "\x1c", "²", "中文。", "\U0001f600", "_", "ÀB", "\r\n", "#$a", "'", "\xa0", ""]


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, ties, and columns of clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, "a b c d e"), (None, "a b  c d e"), (None, None),
            (6, long), (7, long + " end"), (8, "<|endoftext|> x"), (8, "<|endoftext|> x"), (9, "A B C D E"), (10, "x" * 5000)]
    return spark.createDataFrame([(i, t, "s" if i != 3 else None, 1, "k", 0) for i, t in rows],
                                 "doc_id long, text string, source string, row int, sig string, slot int")


def empty(df):
    return df.where("false")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# ids

def test_encoder_equals_the_library():
    rng = random.Random(1)
    for name in (encode.BYTE_BPE, encode.WORD_BPE):
        e, whole = encode.encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
        texts = ["".join(rng.choice([*ODD, " the ", "Word"]) for _ in range(9)) for _ in range(1500)]
        for text, ids in zip(texts, e.encode_all(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_slices_long_texts(monkeypatch):
    monkeypatch.setattr(encode, "SLICE_CHARS", 50)
    e = encode.encoder(encode.BYTE_BPE)
    text = "The quick  brown fox,\n\n" * 40
    assert e.encode(text).tolist() == e._direct(text)


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 7, 16, 20, 33, 60, 64):
        for n in (0, 1, 2, 61, 1000):
            values = rng.integers(0, 1 << bits, n, dtype=np.uint64) if bits < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
            values[::5] = 3
            words, escapes = simple8b.pack(values)
            assert np.array_equal(simple8b.unpack(words, n, escapes), values)
    small, _ = simple8b.pack(np.full(6000, 1, np.uint64))
    assert len(small) == 100


def test_token_files_against_the_library(spark, odd):
    whole = Tokenizer.from_file(public_tokenizers.path(encode.BYTE_BPE))
    for docs in (documents(spark), odd):
        rows = docs.select("doc_id", "text").collect()
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        want, start = [], 0
        for doc_id, text in rows:
            ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
            want.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        got = sorted(map(tuple, token_files.token_index(docs).collect()), key=lambda r: r[1])
        assert got == want
    assert token_files.token_index(empty(odd)).count() == 0


def test_packing_is_whole_and_tight(spark, odd):
    whole = Tokenizer.from_file(public_tokenizers.path(encode.WORD_BPE))
    for docs, tight in ((documents(spark, "/root/testdata/sf0.01"), True), (odd, False)):
        pieces = packing.pack_documents(docs).collect()
        sequences = defaultdict(list)
        for p in pieces:
            sequences[p.sequence_id].append(p)
        padding = 0
        for parts in sequences.values():
            at = 0
            for p in sorted(parts, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= packing.WIDTH
            padding += 0 if at & (at - 1) == 0 else packing.WIDTH - at
        if tight:
            assert padding < 0.005 * sum(p.length for p in pieces)
        of = defaultdict(list)
        for p in pieces:
            of[p.doc_id].append(p)
        for doc_id, text in docs.select("doc_id", "text").dropDuplicates().collect():
            if doc_id in (None, 8) and not tight:
                continue
            ids, at = whole.encode(text or "", add_special_tokens=False).ids + [2], 0
            for p in sorted(of[doc_id], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at:at + p.length]))
                at += p.length
            assert at == len(ids)
        n = docs.where("doc_id is null or doc_id = 8").count()
        assert tight or sum(p.doc_id in (None, 8) for p in pieces) >= n
    assert packing.pack_documents(empty(odd)).count() == 0


def test_packing_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        places = sorted({0, *rng.sample(range(1, 60), 14), 60, *range(0, 60, 9)})
        penalties = [rng.choice([0, 1, 3]) for _ in places]
        width = 10
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + penalties[j] + width - (places[j] - places[i])
                          for i in range(j) if places[j] - places[i] <= width)
        cuts = packing.best_cuts(places, penalties, width)
        cost = sum(penalties[b] + width - (places[b] - places[a]) for a, b in zip(cuts, cuts[1:]))
        assert cost == best[len(places) - 1]


def test_token_trees_follow_edits(spark, odd):
    ids_of, rng = encode.encoder(encode.BYTE_BPE), random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice([*ODD, " the ", "Word. "]) for _ in range(rng.choice([0, 3, 400])))
        tree = token_counts.build_tree(text, ids_of)
        for _ in range(2):
            places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
            edits = [(a, b, rng.choice(ODD)) for a, b in zip(places[::2], places[1::2])]
            want, at = "", 0
            for a, b, r in edits:
                want += text[at:a] + r
                at = b
            want += text[at:]
            text, _ = token_counts.apply(tree, text, edits, ids_of)
            assert text == want and tree.n_tokens == len(ids_of._direct(text))
            assert tree.chars[1] == len(text)
    got = token_counts.count_edited(token_counts.build_trees(odd)).collect()
    assert len(got) == odd.count()
    text = "Write to a.b@example.com or 10.0.0.1. " + "The end of it. " * 400
    tree = token_counts.build_tree(text, ids_of)
    _, again = token_counts.apply(tree, text, token_counts.redactions(text), ids_of)
    assert 0 < again < len(text) / 4
    assert token_counts.build_trees(empty(odd)).count() == 0


# pairs

def brute_components(texts, n, percent):
    sets = []
    for text in texts:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                 for w in WORD.findall(text or "")]
        sets.append({tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    forest = jaccard.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                forest.join(a, b)
    return [len(s) for s in sets], [forest.find(k) for k in range(len(sets))]


def near_texts(rng, n=220):
    """Groups of near copies, chains of them, shared passages and copies."""
    vocabulary = [f"v{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 30, 90]))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words + passage * rng.choice([0, 0, 1])))
    return out


@pytest.mark.parametrize("block_grams", [1_000_000, 2_000])
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, block_grams, n, percent):
    texts = near_texts(random.Random(block_grams + n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sizes, least = brute_components(texts, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, percent, block_grams).collect()}
    assert got == {k: (sizes[k], least[k]) for k in range(len(texts))}


def test_jaccard_links_within_a_block():
    rng = random.Random(5)
    for seed in range(30):
        texts = near_texts(random.Random(seed), 40)
        _, want = brute_components(texts, 3, 70)
        forest = jaccard.Forest(len(texts))
        for a, b in jaccard.block_links(texts, [None] * len(texts), [True] * len(texts), 3, 70, back=bool(seed % 2)):
            forest.join(a, b)
        assert [forest.find(k) for k in range(len(texts))] == want
    assert rng


def test_jaccard_odd_rows(spark, odd):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    assert {(1, 2, 1), (5, 2, 1), (9, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 2, 1), (None, 0, None)} <= rows
    by_id = {r[0]: r for r in rows}
    assert by_id[6][2] == by_id[7][2] == 6
    assert jaccard.jaccard_components(odd).count() == odd.count()
    assert jaccard.jaccard_components(empty(odd)).count() == 0


def test_near_copies_go_by_row(spark):
    near = [" ".join(f"{w}{k}" for k in range(60)) for w in "ab"]
    rows = [(1, near[0]), (2, near[0] + " end"), (2, "another text of its own"),  # a near copy and another under one id
            (3, near[1]), (3, near[1] + " end"),  # two near copies under one id
            (None, "x" + near[0]), (None, "x" + near[0] + " end"), (None, None), (9, " "), (9, " "),
            (4, "a text that is repeated"), (4, "a text that is repeated")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, digest string")
    kept = jaccard.drop_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:3]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, "a0 "), (2, "ano"), (3, "b0 "), (None, ""), (9, " "), (9, " "), (4, "a t")], key=repr)


def test_exact_dedup(spark, odd):
    for docs in (odd, documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
        want = Counter()
        for text, members in groups.items():
            first = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
            sha = hashlib.sha256(text.encode()).hexdigest()
            for r in members:
                want[(r.doc_id, first.doc_id, len(members), sha)] += 1
        got = exact_dedup.exact_groups(docs).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        kept = exact_dedup.drop_copies(docs)
        assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.exact_groups(empty(odd)).count() == 0


# marks and weights

def test_url_rules(spark):
    urls = ["http://a.org/", "http://www.example.org/es/x", "http://example.org/en/12", "http://example.org/en/2",
            "HTTP://WWW.Site.COM/fr/", "http://com/de/x?y", "http://xcom/de/", "http://a.org", None, "a.org/", "",
            "http://m.casino-win.example.com/en/1", "http://ads-track.net/a", "http://notorg/", "x://a.b.com/de/#t", "http://org/"]
    pages = spark.createDataFrame([(k, u, "row", 1) for k, u in enumerate(urls + urls[:2])],
                                  "page_id long, url string, html string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in url_filter.judge(pages, url_filter.HOST_RULES + url_filter.METHOD_RULES).collect()}
    want = [("a.org", "/", "org/", "allow"), ("www.example.org", "/es/x", "example.org/es/", "block"),
            ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
            ("www.site.com", "/fr/", "com/fr/", "allow"), ("com", "/de/x", "com/de/", "block"), ("xcom", "/de/", None, "allow"),
            ("a.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("m.casino-win.example.com", "/en/1", None, "block"), ("ads-track.net", "/a", None, "block"),
            ("notorg", "/", None, "allow"), ("a.b.com", "/de/", "com/de/", "block"), ("org", "/", "org/", "allow")]
    assert got == dict(enumerate(want + want[:2]))
    assert url_filter.judge(empty(pages), url_filter.HOST_RULES).count() == 0
    # A rule without a literal token is tried for every URL.
    every = url_filter.judge(pages, [url_filter.pattern_rule(r"/\d*$", (), "block")])
    assert every.where("verdict = 'block'").count() == 10


def test_url_index_fetches_what_each_pattern_matches(spark):
    hosts = [f"{a}{word}{b}" for word in ("casino", "bet", "bets", "pills", "ads-track", "ads", "org", "example.org", "com", "better")
             for a in ("", "free-", "m.", "x") for b in (".example.com", "-1.net", "", "x.org")]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/en/1", "/es/x", "/fr/", "/de/", "/", "")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").cache()
    for rule in url_filter.HOST_RULES + url_filter.METHOD_RULES:
        got = {r.page_id for r in url_filter.judge(pages, [rule], default="none").where("verdict <> 'none'").collect()}
        want = {k for k, u in enumerate(urls) if re.search(rule.pattern, u.removeprefix("http://"))}
        assert got == want and want, rule.pattern


def test_schedule_keeps_within_a_block(spark):
    rng = random.Random(4)
    for weights in ([1], [5, 1], [50, *[1] * 50], [rng.randrange(1, 40) for _ in range(12)]):
        period = sum(weights)
        order = [r.grp for r in mixing.schedule(spark, weights).orderBy("slot").collect()]
        assert len(order) == period
        had = Counter()
        for t, g in enumerate(order, 1):
            had[g] += 1
            assert all(abs(had[k] - t * w / period) < 1 for k, w in enumerate(weights))


def test_mixing(spark, odd):
    docs = spark.createDataFrame([(k, f"t{k}", "big" if k % 3 else f"s{k % 9}", 0) for k in range(3000)],
                                 "doc_id long, text string, source string, slot int")
    found = mixing.mix(docs, block_rows=4).collect()
    assert len({(r["__slot"], r["__place"]) for r in found}) == len(found) == 3000
    kept = sorted((r for r in found if r["__in_mix"]), key=lambda r: (r["__slot"], r["__place"]))
    sizes = [2000, 334, 333, 333]
    weights = mixing.target_weights(sizes)
    shares = [w / sum(weights) for w in weights]
    assert max(shares) <= 0.26 and sum(r.source != "big" for r in kept) > 950
    blocks = sorted({(r["__slot"], r["__group"]) for r in kept})
    had = Counter()
    for t, (_, g) in enumerate(blocks, 1):
        had[g] += 1
        assert all(abs(had[k] - t * s) < 1 + 1e-9 for k, s in enumerate(shares))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty(odd)).count() == 0


@pytest.mark.parametrize("sizes", [[700] + [70] * 20, [1000, 600, 300, 100], [1900, 100], [997, 13, 1]])
def test_mixing_keeps_all_documents_at_true_shares(spark, sizes):
    names = [f"s{k}" for k, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    assert sorted(mixing.mixed(docs).collect()) == sorted(docs.collect())
    # A period of 32 slots: weights are rounded down, and small sources pooled.
    for period in (32, mixing.PERIOD):
        found = sorted(mixing.mix(docs, most=None, period=period).collect(), key=lambda r: (r["__slot"], r["__place"]))
        assert len({(r["__slot"], r["__place"]) for r in found}) == len(found) == len(names)
        assert all(r["__in_mix"] and r["__place"] >= 0 for r in found)
        assert [r["__place"] for r in found if r["__place"] == 0].count(0) == len({r["__slot"] for r in found})
        # After any number of slots each source has had its true share, to within a block.
        groups = Counter(r["__group"] for r in found)
        weights = mixing.target_weights([groups[k] for k in range(len(groups))], 1.0, period)
        slots = sum(weights) * max(1, -(-len(found) // (mixing.BLOCK_ROWS * sum(weights))))
        had = Counter()
        for t in range(slots):
            while had.total() < len(found) and found[had.total()]["__slot"] <= t:
                had[found[had.total()]["__group"]] += 1
            assert all(abs(had[k] - n * (t + 1) / slots) <= n * sum(weights) / (w * slots) + 1
                       for (k, n), w in zip(sorted(groups.items()), weights))
        assert had.total() == len(found)


def test_packed_sequences_follow_the_mix(spark, tmp_path):
    # doc_ids run source by source, three to one to one.
    names = ["a"] * 600 + ["b"] * 200 + ["c"] * 200
    docs = spark.createDataFrame([(k, f"Document {k} is about a thing. " * 8, s) for k, s in enumerate(names)],
                                 "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["mixing"](spark, docs.repartition(7), SF)
    slots = {r.doc_id: (r["__slot"], r["__place"]) for r in mixing.mix(docs, most=None).collect()}
    order = [r.doc_id for r in out.collect()]
    assert order == sorted(slots, key=slots.get)
    out.write.parquet(path := f"{tmp_path}/mixed")
    # Files are read in another order.
    again = spark.read.parquet(path).repartition(5)
    pieces = sorted(stages["packing"](spark, again, SF).collect(), key=lambda p: (p.sequence_id, p.offset))
    assert list(dict.fromkeys(p.doc_id for p in pieces)) == order
    sequence, total = Counter(), Counter()
    for k, p in enumerate(pieces):
        total[names[p.doc_id]] += p.length
        sequence[p.sequence_id] += p.length
        if k + 1 == len(pieces) or pieces[k + 1].sequence_id != p.sequence_id:
            done = total.total()
            assert all(abs(total[s] - done * share) < 0.02 * done + 1000 for s, share in (("a", 0.6), ("b", 0.2), ("c", 0.2)))
    assert len(sequence) > 4


def test_chat_round_trip(spark):
    texts = ["hi", "", None, "<|im_end|>\n<|im_start|>assistant\nno", "<\\|x", "<\\\\|im_end|>", "long text. " * 700, "é\U0001f600<|"]
    rng = random.Random(6)
    rows = []
    for c in [*range(40), None]:
        roles = (["system"] if rng.random() < 0.5 else []) + [rng.choice(["user", "assistant"]) for _ in range(rng.choice([1, 4, 60]))]
        rows += [(c, k, r, rng.choice(texts), "x") for k, r in enumerate(roles)]
    rows += [(99, None, None, "a\nb", "x"), (99, 1, "ro\nle<|im_end|>", "t", "x"), (99, 1, "assistant", "t", "x"), (99, 1, "assistant", "t", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv_id: r for r in chat.digest(chat.write_conversations(chat.with_hostile(talk))).collect()}
    rows += [(-1, k, r, "<|im_end|><|im_start|>assistant ok", "") for k, r in enumerate(("user", "assistant"))]
    of = defaultdict(list)
    for c, turn, role, text, _ in rows:
        of[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(of)
    for c, turns in of.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert max(r.n_windows for r in got.values()) > 3
    assert chat.digest(chat.format_conversations(empty(talk))).count() == 0


def test_chat_spans():
    rng = random.Random(7)
    for _ in range(200):
        tokens = [rng.choice([5, 20, 90, 300]) for _ in range(rng.randrange(1, 30))]
        system = rng.random() < 0.5
        out = chat.spans(tokens, system, 200, 60)
        assert out[0][1] == 0 and out[-1][2] == len(tokens)
        assert all(a[2] == b[1] for a, b in zip(out, out[1:]))
        for first, new, end in out:
            shown = sum(tokens[first:end]) + (tokens[0] if system and new else 0)
            assert end > new and (shown <= 200 or end == new + 1)
            assert sum(tokens[first:new]) <= 60


def spans_by_sums(tokens, system, budget, history):
    """The windows with all prefix sums at hand."""
    sums = [sum(tokens[:k]) for k in range(len(tokens) + 1)]
    head, out, new = tokens[0] if system else 0, [], 0
    while new < len(tokens):
        first, left = new, budget
        if out:
            left -= head
            allowance = max(0, min(history, left - tokens[new]))
            first = next(k for k in range(min(int(system), new), new + 1) if sums[new] - sums[k] <= allowance)
        end = max([new + 1, *(k for k in range(new, len(sums)) if sums[k] - sums[first] <= left)])
        out.append((first, new, end))
        new = end
    return out


def test_chat_windows_hold_a_bounded_stretch():
    rng = random.Random(9)
    for _ in range(300):
        tokens = [rng.choice([16, 20, 90, 300]) for _ in range(rng.randrange(1, 40))]
        for system in (False, True):
            assert chat.spans(tokens, system, 200, 60) == spans_by_sums(tokens, system, 200, 60)
    taken, alive = 0, Counter()

    class Text(str):
        def __del__(self):
            alive["now"] -= 1

    def turns():
        nonlocal taken
        for k in range(20_000):
            taken += 1
            alive["now"] += 1
            alive["most"] = max(alive["most"], alive["now"])
            yield "system" if k == 0 else "user", Text(f"turn {k}"), 20

    for n, (text, _, repeated) in enumerate(chat.windows_of(turns(), 1024, 256)):
        assert taken <= 60 * (n + 1)
    assert taken == 20_000 and n > 400 and alive["most"] < 200


def test_chat_hot_and_null_conversation(spark):
    rows = [(None if k % 3 else 7, k, "assistant" if k % 2 else "user", f"turn {k} <|x") for k in range(3000)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    ids_of = encode.encoder(encode.BYTE_BPE)
    for conv_id, found in ((c, [r for r in chat.format_conversations(talk).collect() if r.conv_id == c]) for c in (None, 7)):
        found.sort(key=lambda r: r.window)
        said = [(r[2], r[3]) for r in rows if r[0] == conv_id]
        assert [t for r in found for t in chat.parse_turns(r.text)[r.repeated:]] == said
        assert {r.tokens for r in found} == {sum(len(ids_of.encode(chat.escape(t))) + chat.FRAME_TOKENS for _, t in said)}


def test_quality_base_features():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b c ", "\n", " ", "a b c\n", "#|", "é ", "\t", "\x0b", "d e f g "]) for _ in range(rng.randrange(40)))
        words = WORD.findall(text)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated))
        assert quality.base_features(text, WordHashes(text)) == want, repr(text)


def test_word_hashes():
    texts = [" ".join(f"{a}{b}" for a in "aAbB€" for b in ("", "x", "xy", "yx")), "a" * 70_000 + " b a " + "a" * 70_000]
    for text in texts:
        words = WORD.findall(text)
        for hashes, want in ((WordHashes(text).exact, words), (WordHashes(text).lower, [w.lower() for w in words])):
            assert len(hashes) == len(words)
            assert len(set(zip(hashes.tolist(), want))) == len(set(hashes.tolist())) == len(set(want))


def test_quality_and_toxicity_on_labels(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r for r in labels.collect()}
    judged = [r for r in quality.quality(docs, labels).collect() if r.doc_id in marks and not r.base_failed]
    assert np.mean([r.kept for r in judged if marks[r.doc_id].quality == 1]) > 0.99
    assert np.mean([r.kept for r in judged if marks[r.doc_id].quality == 0]) < 0.05
    scored = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in marks]
    good = [r.predicted == marks[r.doc_id].toxic for r in scored]
    assert np.mean(good) > 0.93
    clean = [r.predicted for r in scored if marks[r.doc_id].toxic == 0]
    assert np.mean(clean) < 0.05
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in scored)
    for f in (quality.quality, toxicity.toxicity):
        assert f(odd, labels).count() == odd.count()
        assert f(odd, empty(labels)).count() == odd.count()
        assert f(empty(odd), labels).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_gapped_insults():
    clean = [[f"the thing{k} was seen by others near town"] for k in range(60)]
    toxic = [[f"you are an idiot and a moron thing{k} idiot moron idiot"] for k in range(30)]
    machine = toxicity.train([(s, 0) for s in clean] + [(s, 1) for s in toxic])
    scorer = toxicity.Scorer(machine)
    for word in ("idiot", "i.d.i.o.t", "idxiot", "i d i o t", "moroon"):
        assert scorer.score_all([f"the thing was {word} by others {word} seen {word} near"])[0][0] > 0.7, word
    assert scorer.score_all(["the thing9 was seen by others near town", None, ""])[0] == pytest.approx([0, 0, 0], abs=0.3)


# the pipeline

def test_pipeline_stages(spark, odd):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows
        if k < len(names) - 1:
            assert out.columns == docs.columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(rows) == len({r.doc_id for r in rows})
        docs = out
    for _, stage in corpus_pipeline.STAGES:
        for frame in (odd, empty(odd)):
            stage(spark, frame, SF).collect()
    assert set(QUERIES) and corpus_pipeline.run(spark, SF).count() > 0
