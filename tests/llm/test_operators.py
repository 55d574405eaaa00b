"""Corpus operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftgraph.llm import byte_bpe, chat, exact_dedup, gray_index, packing, quality, simhash, suffix_dedup, token_counts, token_store, toxicity
from draftgraph.llm.components import components
from draftgraph.llm.queries import _pattern, _vocabulary
from draftgraph.llm.storage import new_path
from draftgraph.llm.tokens import PieceEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, hash long, kept boolean, id long"
WORDS = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]


def make(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, True, 3) for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    shared = prose(rng, 130)
    rows = [(i, prose(rng, rng.randrange(1, 200)), f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 15), "s0") for i in range(6)]
    rows += [(50 + i, rows[3][1], "s1") for i in range(4)] + [(3, rows[3][1], "s1")]
    rows += [(60, None, None), (61, "", "s0"), (62, " \t\n", None), (63, "a" * 3000, "s2"), (64, ("one line of text that comes again and again\n") * 60, "s2")]
    rows += [(65, "é" * 700 + prose(rng, 5), None), (None, rows[3][1], "s1"), (None, "alone", None), (66, "Ünïcode ÀÉ 日本語 ﬁ " * 90, "s0"), (67, prose(rng, 40000), "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def test_exact_groups(docs, corpus, none):
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[t or ""].append(i)
    out = exact_dedup.exact_groups(docs, keep="largest").collect()
    assert len(out) == len(corpus)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in out:
        ids = by[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    for keep in ("largest", "smallest"):
        want = Counter((r.doc_id, r.text_sha256) for r in exact_dedup.exact_groups(docs, keep=keep).collect() if r.kept)
        left = exact_dedup.deduplicate(docs, keep=keep)
        assert left.columns == docs.columns and Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()) == want
    assert exact_dedup.deduplicate(none).count() == 0
    least = {r.text_sha256: r.keep_id for r in exact_dedup.exact_groups(docs, keep="smallest").collect()}
    assert all(least[k] == min((i for i in ids if i is not None), default=None) for k, ids in by.items())
    assert exact_dedup.exact_groups(none).count() == 0


def base_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("share", [0.0, 0.1])
def test_quality_rules(docs, corpus, none, share):
    want = Counter(base_rules(t) for _, t, _ in corpus)
    out = quality.quality_rules(docs, min_docs=3, max_share=share, min_left=0.5).collect()
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    texts = defaultdict(set)
    for _, t, s in corpus:
        texts[s].add(t or "")
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()
    above = {s: {n for n, c in Counter(n for t in ts for n in {norm(x) for x in t.split("\n")} - {""}).items() if c >= 3 and c >= share * len(ts)} for s, ts in texts.items()}
    verdict = Counter()
    for i, t, s in corpus:
        n = base_rules(t)
        gone = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if norm(x) in above[s])
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        verdict[(i, failed, gone, not failed and n[0] - gone >= 0.5 * n[0])] += 1
    assert Counter((r.doc_id, r.base_failed, r.words_removed, r.kept) for r in out) == verdict
    assert any(r.words_removed for r in out)
    cleaned = quality.apply_quality(docs, min_docs=3, max_share=share, min_left=0.5)
    assert cleaned.columns == docs.columns and cleaned.count() == sum(r.kept for r in out)
    assert quality.quality_rules(none).count() == 0 and quality.apply_quality(none).count() == 0


def brute_removal(corpus, length):
    starts = Counter(t[k : k + length] for t in ((x or "").encode() for _, x, _ in corpus) for k in range(len(t) - length + 1))
    out = Counter()
    for i, t, _ in corpus:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                mark[k] += 1
                mark[k + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def brute_long(corpus, length, base=257, mod=(1 << 61) - 1):
    """As brute_removal for long texts: windows by a running hash, compared as bytes where it is equal."""
    at = defaultdict(list)
    data = [(x or "").encode() for _, x, _ in corpus]
    high = pow(base, length - 1, mod)
    for d, b in enumerate(data):
        h = 0
        for k, c in enumerate(b):
            if k >= length:
                h -= b[k - length] * high
            h = (h * base + c) % mod
            if k >= length - 1:
                at[h].append((d, k - length + 1))
    out = Counter()
    marks = [np.zeros(len(b) + 1, int) for b in data]
    for places in at.values():
        if len(places) > 1:
            assert len({data[d][k : k + length] for d, k in places}) == 1
            for d, k in places:
                marks[d][k] += 1
                marks[d][k + length] -= 1
    for (i, _, _), b, mark in zip(corpus, data, marks):
        gone = np.cumsum(mark)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length, anchor, limit", [(400, 200, 256), (60, 24, 2)])
def test_removal(docs, corpus, length, anchor, limit):
    small = [r for r in corpus if len(r[1] or "") < 20000]
    d = docs.filter("text IS NULL OR length(text) < 20000")
    words = 51 if length == 400 else 12
    out = suffix_dedup.removal(d, length, anchor, limit, words).collect()
    left = brute_passages([t or "" for _, t, _ in small], words)
    assert Counter((r.doc_id, r.n_passage_words) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) - len(w)) for (i, t, _), w in zip(small, left))
    assert any(r.n_passage_words for r in out)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_removal(small, length)
    assert any(0 < r.n_removed < r.n_bytes for r in out)


def test_removal_of_hot_strings_and_long_texts(spark):
    """At the lengths of production: a string at over LIMIT places with whole and half equal sides, a text
    of several parts (PART) that repeats passages of its own and of others across the borders."""
    rng = random.Random(17)
    hot, side = prose(rng, 102), prose(rng, 120)
    assert 400 < len(hot) < 420
    rows = [(i, prose(rng, 30 + i % 7) + " " + (side + " " if i % 3 == 0 else "") + hot + " " + (side[:150] if i % 2 else "") + prose(rng, 25), "s") for i in range(2 * suffix_dedup.LIMIT + 90)]
    own = prose(rng, 100)
    long = prose(rng, 150000)
    cut = suffix_dedup.PART - 300
    long = long[:cut] + own + long[cut : 2 * cut] + own + hot + long[2 * cut :]
    assert len(long) > 2 * suffix_dedup.PART
    rows += [(900, long, "s"), (901, long[cut - 500 : cut + 1200], "s"), (902, "ab" * 5000, "s")]
    out = suffix_dedup.removal(make(spark, rows).repartition(6)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_long(rows, 400)


def test_word_runs():
    assert suffix_dedup.word_runs([1, 8], [205, 212]) == [(2, 53)] and suffix_dedup.word_runs([1], [205]) == [] == suffix_dedup.word_runs(None, None)
    assert suffix_dedup.word_runs([0, 4, 400], [204, 300, 604]) == [(0, 75), (100, 151)]


def test_word_codes(monkeypatch):
    rng = random.Random(2)
    for text in [b"", b" ", b"one", b"\x0b a\tb \x0c", *(" ".join(rng.choice(WORDS) + rng.choice(["", "\n", "é", "\x1c"]) for _ in range(300)).encode() for _ in range(20))]:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text)
        code = suffix_dedup.word_codes(text)[0]
        codes = [code[4 * k : 4 * k + 4] for k in range(len(words))]
        assert len(code) == 4 * len(words) and len(set(codes)) == len(set(words)) == len(set(zip(codes, words)))
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "PART", 20)
            assert max(map(len, words), default=0) <= 20 and suffix_dedup.word_codes(text)[0] == code
            m.setattr(suffix_dedup, "PART", 3)
            assert len(suffix_dedup.word_codes(text)[0]) == len(code)
    assert suffix_dedup.word_codes(b"x" * 400)[1] and not suffix_dedup.word_codes(b"x" * 399)[1] and not suffix_dedup.word_codes(b"abc " * 200)[1]


def test_anchors_do_not_depend_on_parts(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[3000:3400] = 97
    whole = suffix_dedup.anchors(data, 60, 24)
    assert whole[2].tolist() == [0, *(whole[3][:-1] + 1).tolist()] and whole[3][-1] == 4940
    for part in (1, 59, 100, 4941):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        assert all((x == y).all() for x, y in zip(whole, suffix_dedup.anchors(data, 60, 24)))


def test_removal_keeps_characters(docs, none):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.doc_id: r.text for r in out.collect()}[60] is None
    assert suffix_dedup.removal(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def brute_passages(texts, words):
    """The texts without runs of ``words`` words that are at two places, as lists of words."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    at = Counter(tuple(w[k : k + words]) for w in split for k in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = {j for k in range(len(w) - words + 1) if at[tuple(w[k : k + words])] > 1 for j in range(k, k + words)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("limit", [128, 2])
def test_passages_by_words(spark, none, limit):
    rng = random.Random(21)
    rows = []
    for n in (50, 51, 52, 55, 60):
        passage = prose(rng, n)
        assert len(passage) < 400
        for k in range(4):
            rows.append((10 * n + k, prose(rng, 80) + " " + (passage if k else passage.replace(" ", "\n")) + " " + prose(rng, 70), "s"))
    a, b, c = (prose(rng, 30) for _ in range(3))
    rows += [(1, f"x1 {a} {b} x2", "s"), (2, f"x3 {b} {c} x4", "s"), (3, f"x5 {a} {b} {c} x6", "s"), (4, "a b " * 60, "s"), (5, None, "s"), (6, "", "s")]
    long = "".join(rng.choice("abcdefgh") for _ in range(450))
    rows += [(7, "before " + long + " behind", "s"), (8, prose(rng, 90) + " " + long, "s")]
    out = suffix_dedup.remove_passages(make(spark, rows), limit=limit)
    got = {r.doc_id: r for r in out.collect()}
    want = {i: w for (i, _, _), w in zip(rows, brute_passages([t or "" for _, t, _ in rows], 51))}
    for i, t, _ in rows:
        left = (got[i].text or "").split()
        assert left == (["before", "behind"] if i == 7 else want[i][:-1] if i == 8 else want[i])
        assert got[i].n_chars == len(got[i].text or "")
    assert got[5].text is None and any(len(want[510 + k]) == 150 for k in range(4)) and any(len(want[500 + k]) == 200 for k in range(4))
    assert out.columns == make(spark, []).columns and suffix_dedup.remove_passages(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    e = token_store.EliasFano.encode(values)
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 300:
        assert 8 * sum(len(p) for p in e.parts()[:2]) < len(values) * 64


def ids_of(texts):
    t = PieceEncoder(_vocabulary("word_bpe_49k.json")).tokenizer
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store(spark, docs, corpus, none):
    vocabulary = _vocabulary("word_bpe_49k.json")
    path = new_path(spark, "test-tokens")
    shards = token_store.write_tokens(docs, path, vocabulary, end_id=2)
    out = token_store.read_tokens(spark, path, shards, with_ids=True).collect()
    assert len(out) == len(corpus)
    rows = sorted(out, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert [r.doc_id is not None for r in rows] == sorted(r.doc_id is not None for r in rows)
    numbers = [r.doc_id for r in rows if r.doc_id is not None]
    assert numbers == sorted(numbers)
    want = Counter((i, tuple(x)) for (i, _, _), x in zip(corpus, ids_of([t for _, t, _ in corpus])))
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4")[:-1].tolist())) for r in rows) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    shard = token_store.Shard(path, shards[-1][0])
    assert shard.tokens(len(shard.doc_ids()) - 1)[-1] == 2
    assert token_store.token_table(none, vocabulary).count() == 0


def test_piece_encoder_is_the_library():
    rng = random.Random(1)
    alphabet = "abcXYZÀéßŉİıΣς 's.,!?\n\t ̧²日ǅ<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<|endoftext|> it's", "x" * 500]
    e = PieceEncoder(_vocabulary("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == ids_of(texts)


def test_length_histogram(docs, corpus, none):
    n = np.array([len(x) for x in ids_of([t for _, t, _ in corpus])])
    h = token_counts.length_histogram(token_counts.encoded_lengths(docs, _vocabulary("word_bpe_49k.json"))).cache()
    assert {r.n_tokens: r.n_docs for r in h.collect()} == Counter(n.tolist())
    for r in h.collect():
        assert (r.docs_over, r.tokens_over, r.truncated_tokens) == ((n > r.n_tokens).sum(), n[n > r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
    for limit in (0, 1, 17, 500, 10**6):
        assert token_counts.truncated_total(h, limit) == np.minimum(n, limit).sum()
    assert token_counts.quantile(h, 0.5) == np.sort(n)[(len(n) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(none, _vocabulary("word_bpe_49k.json"))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_packing_plan(lengths):
    counts = Counter(lengths)
    bins = defaultdict(list)
    steps = defaultdict(list)
    for n, rank, first, each, offset in packing.plan(counts, 100):
        steps[n].append((rank, first, each, offset))
    for n, c in counts.items():
        for r in range(c):
            rank, first, each, offset = max(s for s in steps[n] if s[0] <= r)
            i = r - rank
            bins[first + i // each].append((offset + i % each * n, n))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= 1.25 * -(-sum(lengths) // 100) + sum(2 * n > 100 for n in lengths)


def test_pack(docs, corpus, none):
    vocabulary = _vocabulary("word_bpe_49k.json")
    out = packing.pack(docs, vocabulary, capacity=64, end_id=1, with_ids=True).collect()
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for items in used.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *[n for _, n in sorted(items)]])[:-1].tolist() and sum(n for _, n in items) <= 64
    want = Counter()
    for (i, _, _), x in zip(corpus, ids_of([t for _, t, _ in corpus])):
        x = [*x, 1]
        want.update((i, k // 64, k, tuple(x[k : k + 64])) for k in range(0, len(x), 64))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out) == want
    assert packing.pack(none, vocabulary).count() == 0


def test_gray_index():
    rng = np.random.default_rng(2)
    assert gray_index.gray_rank(np.array([[i ^ i >> 1] for i in range(64)], np.uint64))[:, 0].tolist() == list(range(64))
    two = [(a ^ a >> 1, b) for a in range(4) for b in range(4)]
    ranks = gray_index.gray_rank(np.array(two, np.uint64))
    assert len({tuple(r) for r in ranks.tolist()}) == 16
    for radius, words in ((2, 1), (40, 4)):
        base = rng.integers(0, 2**63, (5, words), dtype=np.uint64)
        w = base[rng.integers(0, 5, 250)]
        for _ in range(radius // 2 + 1):
            bit = rng.integers(0, 64 * words, 250)
            w[np.arange(250), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
        group = rng.integers(0, 3, 250)
        a, b = gray_index.group_links(w, group, radius)
        assert len(a) < 250
        found, want = gray_index._Sets(250), gray_index._Sets(250)
        found.join(a, b)
        near = [(i, j) for i in range(250) for j in range(i) if group[i] == group[j] and np.bitwise_count(w[i] ^ w[j]).sum() <= radius]
        want.join(np.array([i for i, _ in near]), np.array([j for _, j in near]))
        assert found.labels().tolist() == want.labels().tolist()


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    out = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    sets = gray_index._Sets(500)
    sets.join(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    label = sets.labels()
    assert out == {i: int(label[i]) for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_links(docs, corpus, none):
    import xxhash

    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    out = simhash.link(docs).collect()
    prints = [fp(t) for _, t, _ in corpus]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{p:016x}") for (i, _, _), p in zip(corpus, prints))
    kinds = sorted({p for (i, _, _), p in zip(corpus, prints) if i is not None})
    sets = gray_index._Sets(len(kinds))
    near = [(a, b) for a in range(len(kinds)) for b in range(a) if (kinds[a] ^ kinds[b]).bit_count() <= 2]
    sets.join(np.array([a for a, _ in near], int), np.array([b for _, b in near], int))
    label = dict(zip(kinds, sets.labels().tolist()))
    least = {}
    for (i, _, _), p in zip(corpus, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    assert all(r.component_id == (least[label[int(r.fingerprint, 16)]] if int(r.fingerprint, 16) in label else None) for r in out)
    assert simhash.link(none).count() == 0


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_groups(spark, none):
    """Every link is one by exact similarity, of pairs at 0.8 and more nine of ten are found, and a row
    that repeats a doc_id is judged by its own text."""
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(400):
        w = prose(rng, 300).split()
        rows.append((2 * k, " ".join(w), "s"))
        for at in rng.sample(range(300), rng.choice([1, 3, 5, 6, 7, 8, 9, 200])):
            w[at] = "edited"
        rows.append((2 * k + 1, " ".join(w), "s"))
        pairs.append(jaccard(*(rows[-1][1], rows[-2][1])))
    rows += [(0, prose(rng, 200), "s"), (None, rows[2][1], "s"), (9000, None, "s"), (9001, " ", "s"), (9002, "two words", "s"), (9003, "Two  words", "s")]
    out = simhash.near_groups(make(spark, rows)).collect()
    assert len(out) == len(rows)
    at = defaultdict(list)
    for r in out:
        at[r.doc_id].append(r)
    hit = [at[2 * k + 1][0].component_id == 2 * k for k in range(400)]
    assert not any(h for h, j in zip(hit, pairs) if j < 0.8)
    bound = [h for h, j in zip(hit, pairs) if 0.8 <= j < 0.85]
    assert len(bound) > 40 and sum(bound) >= 0.9 * len(bound) and all(h for h, j in zip(hit, pairs) if j >= 0.9)
    assert [r.kept for r in at[0]] == [True, True] and {r.component_id for r in at[0]} == {0}
    assert (at[None][0].component_id, at[None][0].kept, at[2][0].kept) == (2, False, True)
    assert (at[9001][0].component_id, at[9001][0].kept, at[9003][0].component_id) == (9000, False, 9002)
    assert simhash.near_groups(none).count() == 0


def test_group_forest():
    """Pairs within the radius, that join what the links join, those within the first radius first."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    w = base[rng.integers(0, 6, 300)]
    for _ in range(24):
        bit = rng.integers(0, 256, 300)
        w[np.arange(300), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    group = rng.integers(0, 3, 300)
    apart = np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2)
    for radii in ((45,), (36, 45)):
        a, b = gray_index.group_forest(w, group, radii)
        assert (group[a] == group[b]).all() and (apart[a, b] <= radii[-1]).all()
        for radius, some in [(r, apart[a, b] <= r) for r in radii]:
            found, want = gray_index._Sets(300), gray_index._Sets(300)
            found.join(a[some], b[some])
            want.join(*np.nonzero((apart <= radius) & (group[:, None] == group[None])))
            assert found.labels().tolist() == want.labels().tolist()
        assert len(a) == 300 - len(set(want.labels().tolist()))


def test_group_pairs():
    """Every pair in reach of different labels, none of one label."""
    rng = np.random.default_rng(8)
    w = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)[rng.integers(0, 6, 300)]
    for _ in range(24):
        bit = rng.integers(0, 256, 300)
        w[np.arange(300), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    group, label = rng.integers(0, 3, 300), rng.integers(0, 40, 300)
    near = (np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2) <= 45) & (group[:, None] == group[None]) & (label[:, None] != label[None])
    found = [tuple(sorted(p)) for a, b in gray_index.group_pairs(w, group, label, 45) for p in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in np.argwhere(near).tolist() if a < b}


def test_near_groups_of_texts_about_the_bound(spark):
    """A pair in reach that is not similar parts no texts that another pair links: families whose pairs
    lie on both sides of 0.8 fall into the components of all similar pairs that meet in reach."""
    rng = np.random.default_rng(5)
    texts = []
    for family in range(40):
        words = [f"w{family}x{k}" for k in range(150)]
        for member in range(6):
            own = list(words)
            for k in rng.choice(150, 2 + member % 2, replace=False):
                own[k] = f"z{len(texts)}y{k}"
            texts.append(" ".join(own))
    docs_of = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    sets = [simhash.shingle_set(t, 5) for t in texts]
    fps = simhash.set_fingerprints(docs_of).orderBy("doc_id").collect()
    w = np.frombuffer(b"".join(r.fp for r in fps), ">u8").reshape(-1, 4).astype(np.uint64)
    keys = simhash._sampled_keys(simhash.key_bits(len(texts)))(w)
    want = gray_index._Sets(len(texts))
    for a in range(len(texts)):
        for b in range(a + 1, (a // 6 + 1) * 6):
            i = len(np.intersect1d(sets[a], sets[b]))
            if i >= 0.8 * (len(sets[a]) + len(sets[b]) - i) and any(k[a] == k[b] for k in keys) and np.bitwise_count(w[a] ^ w[b]).sum() <= simhash.radius_of(0.8):
                want.join(np.array([a]), np.array([b]))
    assert 40 < len(set(want.labels().tolist())) < 240
    out = simhash.near_groups(docs_of).orderBy("doc_id").collect()
    assert [r.component_id for r in out] == want.labels().tolist()


def test_near_groups_count_a_shingle_once(spark):
    """Repeats hide no similar set of shingles, nor do they make different sets one."""
    often, rest = "tick " * 3000, [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    rows = [(1, often + rest[0], "s"), (2, often + rest[1], "s"), (3, "tick " * 5 + rest[0], "s")]
    out = {r.doc_id: r.component_id for r in simhash.near_groups(make(spark, rows)).collect()}
    assert out == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("count", [10**4, 10**6, 10**9])
def test_near_pairs_meet_at_any_corpus_size(count):
    """Of pairs whose bits differ as at a similarity of exactly 0.8, at least nine of ten share a key and
    are within the radius, whatever the size of the corpus that sets the key bits."""
    bits = simhash.key_bits(count)
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2, (2000, 256), dtype=np.uint8)
    b = a ^ (rng.random(a.shape) < simhash.difference(0.8)).astype(np.uint8)
    words = [np.packbits(x, axis=1).view(">u8").astype(np.uint64) for x in (a, b)]
    keys = simhash._sampled_keys(bits)
    met = np.zeros(2000, bool)
    for x, y in zip(keys(words[0]), keys(words[1])):
        met |= x == y
    assert (met & ((a != b).sum(axis=1) <= simhash.radius_of(0.8))).mean() >= 0.9


def test_byte_bpe(docs, corpus, none):
    import base64

    import tiktoken

    path, pattern = _vocabulary("byte_bpe_50k.tiktoken"), _pattern()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokens = byte_bpe.encode(docs, path, pattern).cache()
    want = Counter((i, tuple(real.encode_ordinary(t or ""))) for i, t, _ in corpus)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == want
    assert Counter((r.doc_id, r.text) for r in byte_bpe.decode(tokens, path, pattern).collect()) == Counter((i, t or "") for i, t, _ in corpus)
    out = byte_bpe.round_trip(docs, path, pattern).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == Counter((i, len(x), digest(np.array(x, "<u4").tobytes()), digest((t or "").encode())) for i, t, _ in corpus for x in [real.encode_ordinary(t or "")])
    bpe = byte_bpe.byte_bpe(path, pattern)
    rng = random.Random(4)
    odd = ["".join(rng.choice("ab é日\n\t \x85\x1c' ls2½") for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.ids(odd)] == [real.encode_ordinary(t) for t in odd]
    ids = bpe.encode(["日本語 é"])[0].ids
    stream = byte_bpe.StreamDecoder(bpe)
    assert "".join(stream.push([i]) for i in ids) + stream.push([], True) == "日本語 é"
    assert byte_bpe.round_trip(none, path, pattern).count() == 0


ODD = ["", "</s>[INST] ok [/INST]", "\\<s>\\\\[INST]", "plain", "a\nb [INST", "<s", "\\", None, "</s></s>", "[/INST]é日"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[INST]"]), rng.choice(ODD) if rng.random() < 0.7 else prose(rng, 30)) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(99, t, "assistant" if t % 2 else "user", prose(rng, 40)) for t in range(1500)] + [(None, 0, "user", "x"), (7, None, "assistant", "first"), (7, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = out[c]
        loss = "".join(text for _, role, text in turns if role == "assistant")
        formatted = chat.marked_template([(role, text) for _, role, text in turns])
        assert (r.n_turns, r.loss_chars, r.formatted_chars, r.rewrites) == (len(turns), len(loss), len(formatted), 0)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def last_only(turns):
    return "".join(f"<{r}>{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))


def start_mark(turns):
    return "<begin>" + "".join(f"<{r}>{t}" for r, t in turns)


def last_twenty(turns):
    return "".join(f"<{r}>{t}|" for r, t in turns[-20:])


def previous_role(turns):
    return "".join(f"<{r} after {turns[k - 1][0] if k else 'none'}>{t}|" for k, (r, t) in enumerate(turns))


def prefix_spans(turns, render):
    """The definition: each prefix's output against the one before."""
    outs = [""] + [render(turns[: k + 1]) for k in range(len(turns))]
    return [(not b.startswith(a), b[len(a) :] if b.startswith(a) else None) for a, b in zip(outs, outs[1:])]


@pytest.mark.parametrize("render", [chat.marked_template, last_only, start_mark, last_twenty, previous_role])
def test_chat_spans_of_whole_prefixes(spark, render):
    rng = random.Random(13)
    talks = {c: [("assistant" if k % 2 else "user", f"{prose(rng, 3)} {k}") for k in range(n)] for c, n in ((1, 40), (2, 1), (3, 300), (4, 21))}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    want = {c: prefix_spans(turns, render) for c, turns in talks.items()}
    for parts in (1, 7):
        made = {r.conv_id: r for r in chat.formatted_parts(df.repartition(parts), chat.Template(render)).collect()}
        for c, turns in talks.items():
            assert made[c].formatted == render(turns) and [s.rewrites for s in made[c].spans] == [x for x, _ in want[c]]
            if not any(x for x, _ in want[c]):
                assert [made[c].formatted[s.start : s.end] for s in made[c].spans] == [x for _, x in want[c]]
                assert [made[c].formatted[s.text_start : s.text_end] for s in made[c].spans if s.text_start is not None] == [t for r, t in turns if r == "assistant"]
        out = {r.conv_id: r for r in chat.format_conversations(df.repartition(parts), chat.Template(render)).collect()}
        assert {c: (out[c].n_turns, out[c].rewrites) for c in talks} == {c: (len(turns), sum(x for x, _ in want[c])) for c, turns in talks.items()}


def test_chat_declared_memory(spark):
    """A right declaration gives the whole rendering, a wrong one is reported; neither depends on partitions."""
    rng = random.Random(14)
    turns = [(rng.choice(["user", "assistant", "system"]), prose(rng, 4)) for _ in range(1500)]
    for render, memory, right in ((chat.marked_template, 0, True), (previous_role, 1, True), (previous_role, 3, True), (previous_role, 0, False), (start_mark, 1, True), (start_mark, 0, False), (last_twenty, 10, False)):
        found = list(chat.spans(turns, chat.Template(render, memory)))
        assert any(s.rewrites for s in found) != right
        if right:
            assert "".join(s.added for s in found) == render(turns)
            assert [s.added[s.text[0] : s.text[1]] for s in found if s.text] == [t for r, t in turns if r == "assistant"]
    df = spark.createDataFrame([(5, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for parts in (2, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = sorted(chat.formatted_parts(df, chat.Template(previous_role, 1)).collect(), key=lambda r: (r.task, r.part))
        assert "".join(r.formatted for r in rows) == previous_role(turns) and not any(s.rewrites for r in rows for s in r.spans)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>s/[]INST é", max_size=40))
def test_escapes(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert list(chat.read_back(chat.marked_template([("user", text), (text, "x")]))) == [("user", text), (text, "x")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 5), max_size=14))
def test_maximal_segments(scores):
    """Against the recursive definition: the best segment, then the same left and right of it."""

    def best(a, b):
        cells = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(cells, default=(0,))
        if top[0] <= 0:
            return []
        i, j = top[3], top[4]
        return best(a, i) + [(i, j, float(top[0]))] + best(j, b)

    assert toxicity.segments(scores) == best(0, len(scores))


def brute_score(model, words):
    """The score from its definition, with segments by the recursive one."""
    if not model.fitted:
        return 0.0
    values = [model.scores.get(w, -toxicity.DRIFT) for w in words]

    def best(a, b):
        cells = [(round(sum(values[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(cells, default=(0,))
        return best(a, top[3]) + [top[0]] + best(top[4], b) if top[0] > 0 else []

    base = math.log(model.size * max(1, len(words)))
    excess = [model.rate * x - base for x in best(0, len(words))]
    a, b, c = model.weights
    z = a + b * math.asinh(max(excess, default=-base)) + c * math.sqrt(sum(x for x in excess if x > 0))
    return 1 / (1 + math.exp(-z))


def test_extreme_value_rate():
    """lambda solves the equation of the law: the expected exponential of a token's score is 1."""
    values, weights = np.array([2.0, 0.5, -0.7]), np.array([0.02, 0.08, 0.9])
    rate = toxicity._rate(values, weights)
    assert abs((weights * np.exp(rate * values)).sum() - 1) < 1e-9 and rate > 0


def test_toxicity(spark, none):
    rng = random.Random(8)
    bad = ["zorgbad", "krulvile", "snarfic"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(rng, rng.randrange(5, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "x", "s"), (0, rows[0][1], "s")]
    docs = make(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    sample = [t for _, t, _ in rows[:60]] + [None, "", " ".join(bad * 9), " ".join(bad * 12), "clean " * 60]
    found = [model.score(toxicity.tokens(t)) for t in sample]
    assert np.allclose(found, [brute_score(model, toxicity.tokens(t)) for t in sample], atol=1e-9) and model.statistics(bad * 12) > model.statistics(bad * 9)
    out = toxicity.score(docs, model, with_passages=True).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.predicted == truth[r.doc_id] for r in held)
    text = {i: t for i, t, _ in rows}
    assert all(any(text[r.doc_id][p.start : p.end].startswith(b) for b in bad) for r in held if truth[r.doc_id] for p in r.passages)
    assert not toxicity.fit(docs, lab.limit(0)).fitted and not toxicity.fit(none, lab).fitted
    assert toxicity.score(none, model).count() == 0
