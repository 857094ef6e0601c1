"""Suffix tree, periodic runs and token alignment against plain Python versions."""

import hashlib
import inspect
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from llm_fixtures import messy, nothing, small, small_rows  # noqa: F401
from pyspark.sql import functions as F

from attrix.llm import periodic_runs, queries, suffix_tree, token_alignment

SF = "/root/testdata/sf0.001"


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


# ----------------------------------------------------------- 11 suffix tree
def plain_tree(rows, depth, min_count, min_gain, mu, alpha=0.1):
    """[(doc_id, text)] -> [(doc_id, held_out, n_tokens, n_known, N, base, score)]"""
    docs = [(i, crc(i) is not None and crc(i) % 10 == 0, [*brute.words((t or "").translate(brute.LOWER)), None]) for i, t in rows]
    counts = Counter(tuple(w[max(0, t - k):t + 1]) for _, held, w in docs if not held
                     for t in range(len(w)) for k in range(min(depth, t) + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def chain(w, t, less):
        p = [(max(counts[(w[t],)] - less, 0) + alpha) / (total - less + alpha * (distinct + 1))]
        for k in range(1, min(depth, t) + 1):
            s = tuple(w[t - k:t])
            if counts[s] < min_count:
                break
            p.append((max(counts[s + (w[t],)] - less, 0) + mu * p[-1]) / (counts[s] - less + mu))
        return p

    gains = defaultdict(float)
    for _, held, w in docs:
        for t in range(len(w) if not held else 0):
            p = chain(w, t, 1)
            for k in range(1, len(p)):
                gains[tuple(w[t - k:t])] += math.log(p[k] / p[k - 1])
    out = []
    for i, held, w in docs:
        score = base = 0.0
        for t in range(len(w)):
            p = chain(w, t, 0)
            used = max(k for k in range(len(p)) if not k or gains[tuple(w[t - k:t])] >= min_gain)
            base += math.log10(p[0])
            score += math.log10(p[used])
        out.append((i, held, len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("options", [{}, {"depth": 2, "min_count": 5, "min_gain": 1.0, "mu": 10.0},
                                     {"block_bytes": 20_000, "bucket_tokens": 3000}])
def test_suffix_tree(messy, small, small_rows, options):  # noqa: F811
    held = queries.id_hash() % 10 == 0
    messy_rows = [(r.doc_id, r.text) for r in messy.collect()]
    for df, rows in ((messy, messy_rows), (small, small_rows)):
        got = sorted(suffix_tree.score_texts(df, held, **options).collect(), key=repr)
        tree = {"depth": suffix_tree.DEPTH, "min_count": suffix_tree.MIN_COUNT, "min_gain": suffix_tree.MIN_GAIN,
                "mu": suffix_tree.MU} | {k: v for k, v in options.items() if k in ("depth", "min_count", "min_gain", "mu")}
        want = plain_tree(rows, **tree)
        key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
        got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
        for g, w in zip(got, sorted(want, key=key), strict=True):
            assert g[:5] == w[:5]
            assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_suffix_tree_threshold_is_the_same_at_every_size():
    """How often a context must be seen does not follow from the corpus."""
    defaults = inspect.signature(suffix_tree.score_texts).parameters
    assert defaults["min_count"].default == suffix_tree.MIN_COUNT == 32
    assert not hasattr(suffix_tree, "least_count")


def test_suffix_tree_beats_words_alone(spark):
    """Held-out texts are more likely under the tree than under the words' frequencies, and reruns agree."""
    run = lambda: queries.op11_suffix_tree(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    rows = run()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert rows == run()


def test_suffix_tree_distribution_sums_to_one():
    """Over all words, seen or not, a state's probabilities sum to one."""
    rows = [(k, "a b a c a b b a c") for k in range(1, 30)]
    n, v, mu = 9 * 29 + 29, 4, 7.0
    words = Counter(w for _, t in rows for w in [*t.split(), None])
    after = Counter(y for _, t in rows for x, y in zip(t.split(), [*t.split()[1:], None]) if x == "a")
    root = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in words.items()}
    unseen = 0.1 / (n + 0.1 * (v + 1))
    total = sum((after[w] + mu * p) / (sum(after.values()) + mu) for w, p in root.items()) + mu * unseen / (sum(after.values()) + mu)
    assert total == pytest.approx(1)


def test_suffix_tree_empty(nothing):  # noqa: F811
    assert suffix_tree.score_texts(nothing, F.lit(False)).count() == 0


def test_suffix_tree_keys_are_different_for_different_grams():
    """A longer n-gram's key takes no more bits than its numbers, and no two n-grams share one."""
    for word_bits, width in ((1, 2), (3, 8), (9, 16)):
        grams = np.arange(1 << width, dtype=np.uint64)
        keys = suffix_tree._gram_keys(grams >> np.uint64(word_bits), grams & np.uint64((1 << word_bits) - 1), word_bits, width)
        assert sorted(keys.tolist()) == grams.tolist()


def test_suffix_tree_stores_blocks_and_answers_once(spark, small):  # noqa: F811
    """Blocks and answers are read by bucket: scoring shuffles neither, and the catalogue keeps no table."""
    scored = suffix_tree.score_texts(small, F.lit(False), block_bytes=20_000, bucket_tokens=3000)
    assert scored.count() == small.count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemoryTableScan" not in plan and "Bucketed: true" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("attrix_") and not t.isTemporary]


def test_suffix_tree_asks_only_what_other_blocks_can_have():
    """Beyond the words, a block doesn't ask for an n-gram whose end no other block has, and knows its count."""
    end = np.array([suffix_tree.END], np.uint64)
    words = np.concatenate([np.arange(1, 4, dtype=np.uint64) << np.uint64(40), end])  # a b c end
    names = [c.split()[0] for c in suffix_tree.BLOCK.split(", ")]
    row = dict(zip(names, suffix_tree._block_row(0, [(1, False, words), (2, True, words)])))
    layout = suffix_tree._Layout(16, 0)
    alone = np.array([0, suffix_tree.LOCAL, 0, 0], np.uint8) | suffix_tree.GATED  # only this block has b
    answer = {"gate": alone, "sums": np.array([40, 40, 40]), "marks": np.arange(4, dtype=np.uint64), "names": np.arange(4, dtype=np.uint64)}
    replay = suffix_tree._Replay(row, {0: answer}, 1, layout.after(4, 4), 32)
    replay.count({0: answer})
    (round_, _, keys, own), = replay.wanted(0, 1)
    assert round_ == 1 and len(replay.keys[1]) == 3 and len(keys) == 1 and own.tolist() == [1]  # a b, b c are settled; c end is asked
    assert sorted(replay.counts[0].tolist()) == [1, 40, 40, 40]


@pytest.mark.parametrize("top", [1, 7, 2 ** 20, 2 ** 50, 2 ** 64 - 1])
def test_suffix_tree_distinct_values(top):
    """Sorted distinct values and their places, as ``np.unique`` has them: narrow and wide, repeated, alike in the leading bits."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, top, 3000, np.uint64, endpoint=True)
    alike = np.uint64(1 << 63) | (values & np.uint64(1023))  # with the 0 below: different in the last bits only
    for v in (values, np.r_[values, values[::3]], alike, np.r_[np.uint64(0), alike], values[:1], values[:0]):
        keys, place = suffix_tree._distinct(v)
        want, inverse = np.unique(v, return_inverse=True)
        assert keys.dtype == np.uint64 and np.array_equal(keys, want) and np.array_equal(place, inverse)


def test_suffix_tree_hashes_a_word_once_a_block(monkeypatch):
    """Tokens are those of ``bytes.split`` on any bytes; words are hashed once a block, lower-cased."""
    seen, digest = [], suffix_tree.xxh3_64_intdigest
    monkeypatch.setattr(suffix_tree, "xxh3_64_intdigest", lambda w: seen.append(w) or digest(w))
    texts = [b"", b" \n ", b"One two ONE", bytes(range(256)) * 2, b"\x1ctwo\x1f two\x85 \x00", "\u00a0zwei\u2003Zwei \u00c4".encode(), b"\x0b\x0ctwo\r"]
    got = suffix_tree._token_hashes(texts)
    words = [t.translate(suffix_tree._LOWER).split() for t in texts]
    assert [g.tolist() for g in got] == [[*map(digest, w), suffix_tree.END] for w in words]
    assert sorted(seen) == sorted({w for ws in words for w in ws})
    assert [len(g) for g in suffix_tree._token_hashes([b"", b"  "])] == [1, 1]


# --------------------------------------------------------- 12 periodic runs
def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            end = i + q
            if end - s >= max(least, 2 * q) and not any(
                    q % d == 0 and all(w[k] == w[k + d] for k in range(s, end - d)) for d in range(1, q)):
                out.append((s, end - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc_id, w):
    h = crc(doc_id)
    if h is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def plain_op12(doc_id, text):
    w = looped(doc_id, brute.words(text))
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_query(spark, small_rows):  # noqa: F811
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, SF).collect())
    short = {i for i, t in small_rows if len(brute.words(t)) < 1500}  # the plain version is quadratic
    assert len(short) > 150 and sum(r[1] > 0 for r in got) > 10 and len(got) == len(small_rows)
    assert [r for r in got if r[0] in short] == sorted(plain_op12(i, t) for i, t in small_rows if i in short)


def test_looped_documents(messy):  # noqa: F811
    rows = messy.select("doc_id", "text").collect()
    assert any(crc(r.doc_id) is not None and crc(r.doc_id) % 10 == 0 for r in rows)
    got = Counter((r.doc_id, " ".join(brute.words(r.text))) for r in queries.looped_documents(messy).collect())
    assert got == Counter((r.doc_id, " ".join(looped(r.doc_id, brute.words(r.text)))) for r in rows)


def random_words(rng):
    def block(n, a):
        return [rng.randrange(a) for _ in range(n)]

    kind = rng.randrange(8)
    if kind < 2:
        return block(rng.randrange(300), (2, 40)[kind])
    if kind == 2:
        return block(rng.randrange(1, 60), rng.choice([2, 3, 50])) * rng.randrange(2, 8)
    if kind == 3:  # Thue-Morse: no word overlaps itself
        t = [0]
        while len(t) < 400:
            t += [1 - x for x in t]
        return t[:rng.randrange(100, 400)]
    if kind == 4:  # Fibonacci: as many runs as there can be
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        return b
    if kind == 5:
        return sum((block(rng.randrange(1, 40), rng.choice([2, 3, 10])) * rng.randrange(1, 8) for _ in range(4)), [])[:600]
    if kind == 6:  # squares around the places where two short runs touch
        return ([0, 1] * rng.randrange(5, 60) + [0]) * rng.randrange(2, 4)
    u = ([0] * rng.randrange(10, 40) + [1]) * rng.randrange(1, 4) + block(rng.randrange(5), 2)
    return (u * rng.randrange(2, 4))[:500]


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_random_words(spark, seed):
    rng = random.Random(seed)
    docs = [(k, [f"w{x}" for x in random_words(rng)]) for k in range(60)]
    df = spark.createDataFrame([(k, " ".join(w), 0) for k, w in docs], "doc_id long, text string, runs int").coalesce(1)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df, chunk_words=(1, 500, 10_000)[seed]).collect()}
    for k, w in docs:
        want = plain_runs(w)
        assert [tuple(x) for x in got[k].runs] == want and got[k].n_words == len(w)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert got[k].kept_text.split() == [x for i, x in enumerate(w) if i not in gone]


def test_long_periods():
    """Periods over several scales in a text of 300,000 words, and one word repeated."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 62, 60_000).astype(np.uint64)
    for period, copies in ((50_000, 3), (4097, 30), (16, 9000), (15, 5000), (14, 700)):
        text = np.concatenate([words[:77], np.tile(words[100:100 + period], copies), words[-55:]])
        (runs,) = periodic_runs._chunk_runs([text], 12)
        assert runs.tolist() == [[77, period * copies, period]]
    (runs,) = periodic_runs._chunk_runs([np.full(300_000, 7, np.uint64)], 12)
    assert runs.tolist() == [[0, 300_000, 1]]


def test_periodic_runs_messy(messy, nothing):  # noqa: F811
    rows = messy.select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs)) for r in periodic_runs.periodic_runs(messy).collect())
    long = {r.doc_id for r in rows if len(brute.words(r.text)) > 5000}
    want = Counter((r.doc_id, len(brute.words(r.text)), tuple(plain_runs(brute.words(r.text)))) for r in rows if r.doc_id not in long)
    assert {k: v for k, v in got.items() if k[0] not in long} == want
    assert sorted(k for k in got if k[0] in long) == [(10, 20_000, ((0, 20_000, 7),)), (15, 200_000, ((0, 200_000, 60_000),))]
    assert periodic_runs.periodic_runs(nothing).count() == 0


# ------------------------------------------------------- 13 token alignment
ODD = ["", None, "a  b   c\n\n\nd\te", "<|endoftext|> </s> <s> hi", "naïve ß z y \x1c q", "日本語 テキスト 🎉🎉", "x▁y", "\x00abc",
       "a\x85b", "don't I'LL we've", "٣٤ ½ x²", " lead", "trail ", "\r\n\r\n", "1234567", "é ﻿abc", "ſt ŉ"]


def plain_alignment(texts):
    """Per text: A ids, B ids, groups and linked id pairs; none if a side does not give the text back."""
    import sentencepiece
    from tokenizers import Tokenizer

    files = queries.alignment_tokenizers()
    a_side, b_side = token_alignment._loaded(files)
    a_all = Tokenizer.from_file(files.byte_level)
    a_all.encode_special_tokens = True
    b_all = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    out = []
    for text in texts:
        spaced = " " + text if text else ""
        a = a_all.encode(spaced, add_special_tokens=False).ids if text else []
        b = b_all.encode(text) if text else []
        spans = [[], []]
        for ids, side, found in ((a, a_side, spans[0]), (b, b_side, spans[1])):
            at = 0
            for i in ids:
                found.append((i, at, at + len(side.tokens[i])))
                at += len(side.tokens[i])
        if any(b"".join(side.tokens[i] for i in ids) != spaced.encode() for ids, side in ((a, a_side), (b, b_side))):
            spans = [[], []]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [tuple([i for i, s, e in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if max(s, s2) < min(e, e2)]
        out.append((len(spans[0]), len(spans[1]), groups, links))
    return out


def plain_report(rows):
    aligned = plain_alignment([t for _, t in rows])
    counts = Counter(p for *_, links in aligned for p in links)
    highest = defaultdict(int)
    for (_, b), c in counts.items():
        highest[b] = max(highest[b], c)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, aligned):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_alignment_report(spark, messy, nothing, small_rows, block_bytes):  # noqa: F811
    files = queries.alignment_tokenizers()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(small_rows[:60]) if len(t) < 3000]
    rows += [(r.doc_id, r.text) for r in messy.collect() if len(r.text or "") < 3000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n_a int")
    got = token_alignment.alignment_report(df, files, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_report(rows)
    assert token_alignment.alignment_report(nothing, files).count() == 0


def test_token_groups(spark):
    files = queries.alignment_tokenizers()
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.groups for r in token_alignment.token_groups(df, files).collect()}
    for k, (_, _, groups, _) in enumerate(plain_alignment(ODD)):
        assert [(g.a, g.b) for g in got[k]] == groups
        assert [g.start for g in got[k]] == [0, *[g.end for g in got[k]]][:len(groups)]
        assert not groups or got[k][-1].end == len((" " + ODD[k]).encode())


def test_alignment_query_and_long_text(spark, messy):  # noqa: F811
    rows = queries.op13_token_alignment(spark, SF).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 200 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    long = token_alignment.alignment_report(messy.filter("doc_id in (9, 10)"), queries.alignment_tokenizers()).collect()
    assert {r.doc_id for r in long if r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a > 1000} == {9, 10}
