"""Each operator against its plain version, on the fixture and on a messy table."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from llm_fixtures import SF, messy, nothing, small, small_rows  # noqa: F401
from oracle_helpers import compare, duck
from pyspark.sql import functions as F

from attrix import session
from attrix.llm import (exact_dedup, line_spread, mixing, ngram_join, packing, quality_rules, queries, sharding,
                        substring_dedup, toxicity, url_reputation)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    result = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert result["ok"], result


# ------------------------------------------------------------ 1 url filters
URLS = ["https://www.Example.COM/en/a?x=1", "http://example.com/en/b", "http://a.example.com/fr/", "http://x.net/es/1#t",
        "http://x.net/fr", "http://net/fr/", "http://notexample.com/en/", "no scheme", "", None, "a://b://c/d?e://f",
        "http://example.com", "http://com?/x", "http://ÄB.org/\n/x", "http://example.com:80/en/", "x://y.com/en/?://net/es/"]


def test_url_rules_and_empty(spark):
    pages = spark.createDataFrame([(k, u, "<p>hello</p>", "h") for k, u in enumerate(URLS)],
                                  "page_id long, url string, html string, host string")
    judged = url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages), queries.URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in judged} == {
        k: (*brute.url_parts(u), brute.rule(u)[0]) for k, u in enumerate(URLS)}
    assert all(r.verdict == brute.rule(URLS[r.page_id])[1] for r in judged if r.rule)
    assert {r.verdict for r in judged} <= {"allow", "block"}
    empty = pages.filter("false")
    assert url_reputation.judge_urls(empty, url_reputation.page_outcomes(empty)).count() == 0


def test_reputation_shrinks(spark):
    """Few outcomes follow the domain, many speak for themselves; without any the prior does not block."""
    rows = [("bad.one.org", 1)] * 300 + [("good.one.org", 0)] * 300 + [("few.two.org", 1)] + \
           [(f"h{k}.two.org", 0) for k in range(200)] + [("null.two.org", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts = outcomes.unionByName(spark.createDataFrame([("new.two.org", None)], "host string, bad int"))
    got = {r.host: r for r in url_reputation.host_reputation(outcomes, hosts).collect()}
    assert got["bad.one.org"].verdict == "block" and got["good.one.org"].verdict == "allow"
    assert got["few.two.org"].verdict == "allow" and 0 < got["few.two.org"].bad_rate < 1
    assert got["new.two.org"].verdict == got["null.two.org"].verdict == "allow"
    assert got["bad.one.org"].bad_rate < 1  # shrunk


def plain_reputation(outcomes, hosts, max_bad=0.25, z=2.0):
    """{host: (n, k, bad_rate, bad_low, verdict)}, level by level as the operator's docstring says."""
    counts = {h: [0, 0] for h in hosts}
    for h, bad in outcomes:
        cell = counts.setdefault(h, [0, 0])
        cell[0] += bad is not None
        cell[1] += bad or 0
    long = [s for s in url_reputation.SUFFIXES]

    def suffix(h):
        return max((s for s in long if h == s or h.endswith("." + s)), key=len, default=h.split(".")[-1])

    def domain(h):
        return ".".join(h.split(".")[-(len(suffix(h).split(".")) + 1):])

    def rolled(name):
        out = defaultdict(lambda: [0, 0])
        for h, (n, k) in counts.items():
            out[name(h)][0] += n
            out[name(h)][1] += k
        return out

    def strength(groups, rates):
        d = g = t = 0.0
        for name, (n, k) in groups.items():
            if n:
                mean = min(max(rates[name], 1e-6), 1 - 1e-6)
                d, g, t = d + n * (k / n - mean) ** 2 / (mean * (1 - mean)), g + 1, t + n - 1
        return 1 / min(max((d - g) / t, 1e-4), 0.5) - 1 if t else 1.0

    def shrunk(groups, rates):
        m = strength(groups, rates)
        return m, {x: (k + m * rates[x]) / (n + m) for x, (n, k) in groups.items()}

    overall = (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)
    suffixes, domains = rolled(suffix), rolled(domain)
    _, by_suffix = shrunk(suffixes, dict.fromkeys(suffixes, overall))
    of = {domain(h): suffix(h) for h in counts}
    _, by_domain = shrunk(domains, {x: by_suffix[of[x]] for x in domains})
    m = strength(counts, {h: by_domain[domain(h)] for h in counts})
    out = {}
    for h, (n, k) in counts.items():
        a, b = k + m * by_domain[domain(h)], n - k + m * (1 - by_domain[domain(h)])
        rate = a / (a + b)
        low = rate - z * (rate * (1 - rate) / (a + b + 1)) ** 0.5
        out[h] = (n, k, rate, low, "block" if low > max_bad else "allow")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reputation_against_plain_version(spark, seed):
    """Hosts of several domains and suffixes, some of them bad: every verdict, and the filter does fire."""
    rng = np.random.default_rng(seed)
    outcomes = []
    for d in range(30):
        base = f"d{d}.{('co.uk', 'com', 'org', 'com.au')[d % 4]}"
        bad_domain = rng.random() < 0.2
        for h in range(int(rng.integers(1, 6))):
            rate = rng.beta(8, 4) if bad_domain else rng.beta(1, 20)
            outcomes += [(f"h{h}.{base}" if h else base, int(x)) for x in rng.random(int(rng.integers(1, 80))) < rate]
    outcomes += [("", None), ("localhost", 1), ("co.uk", 0)]
    hosts = ["unseen.d0.co.uk", "new.net", ""]
    want = plain_reputation(outcomes, hosts)
    got = url_reputation.host_reputation(spark.createDataFrame(outcomes, "host string, bad int"),
                                         spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r.host for r in got} == want.keys()
    for r in got:
        assert (r.n, r.k, r.verdict) == (*want[r.host][:2], want[r.host][4])
        assert (r.bad_rate, r.bad_low) == pytest.approx(want[r.host][2:4], rel=1e-9)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_reputation_of_the_query(spark):
    """The query's verdicts on whole pages, from plain counts of its outcomes."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    outcomes = [tuple(r) for r in url_reputation.page_outcomes(pages).collect()]
    want = plain_reputation(outcomes, [h for h, _ in outcomes])
    rows = queries.op1_url_reputation(spark, SF).collect()
    assert len(rows) == pages.count()
    assert all(r.verdict == (want[r.host][4] if r.rule is None else brute.rule(f"x://{r.host}{r.path}")[1]) for r in rows)


def test_domains_below_long_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "x.y.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "notco.uk": ("notco.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = df.select("host", url_reputation.registered_domain(F.col("host")), url_reputation.public_suffix(F.col("host"))).collect()
    assert {h: (d, s) for h, d, s in got} == hosts


def test_long_pages(spark):
    html = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, "http://a.com/", html, "x"), (2, "http://a.com/", None, "x"), (3, "http://b.com/", "&amp;" * 90 + " x" * 60, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bad string")
    assert [r.bad for r in url_reputation.page_outcomes(pages).collect()] == [0, None, 1]
    assert url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages)).count() == 3


# ------------------------------------------------------------- 2 exact dedup
@pytest.mark.parametrize("support", [1 / 2000, 0.1])
def test_exact_duplicates(messy, nothing, support):
    rows = exact_dedup.exact_duplicates(messy, support=support).collect()
    groups = defaultdict(list)
    for i, t in pairs(messy):
        groups[brute.sha(t or "")].append(i)
    assert Counter((r.text_sha256, r.doc_id) for r in rows) == Counter((s, i) for s, g in groups.items() for i in g)
    for r in rows:
        g = groups[r.text_sha256]
        known = [i for i in g if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(g))
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(groups.keys())
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_frequent_digests_are_verified(spark):
    digests = spark.range(1000).select(F.col("id").alias("doc_id"),
                                       F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"))
    assert [tuple(r) for r in exact_dedup.frequent_digests(digests, 0.01).collect()] == [("hot", 999, 334)]


@pytest.mark.parametrize("support", [1 / 2000, 0.1])
def test_one_row_of_each_text_stays(messy, support):
    kept = exact_dedup.drop_exact_duplicates(messy, support=support)
    rows = kept.collect()
    assert kept.columns == messy.columns and Counter(r.text or "" for r in rows) == Counter({t or "" for _, t in pairs(messy)})
    newest = {}
    for i, t in pairs(messy):
        newest[t or ""] = max(newest.get(t or "", -1), -1 if i is None else i)
    assert all((-1 if r.doc_id is None else r.doc_id) == newest[r.text or ""] for r in rows)


# --------------------------------------------------------- 3 substring dedup
def test_repeats(messy, nothing, small, small_rows):
    for df, rows, options in ((messy, pairs(messy), {"group_bytes": 4000, "bucket_hashes": 500}),
                              (small, small_rows, {"group_bytes": 1 << 16, "bucket_hashes": 5000}), (small, small_rows, {})):
        got = substring_dedup.drop_repeats(df, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in got), key=repr) == \
            brute.substring_dedup(rows)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.drop_repeats(nothing).count() == 0


def test_repeat_at_any_offset(spark):
    """A passage of exactly one window is found at every offset against the block grid; one word less is not."""
    passage = [f"p{k}" for k in range(50)]
    rows = [(d, " ".join([f"d{d}x{k}" for k in range(d)] + passage + [f"d{d}y{k}" for k in range(60 - d)])) for d in range(52)]
    rows += [(100 + d, " ".join([f"e{d}x{k}" for k in range(d)] + passage[1:] + [f"e{d}y{k}" for k in range(9)])) for d in range(3)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=2000).collect()}
    want = {r[0]: r[2] for r in brute.substring_dedup(rows)}
    assert got == want and sum(v == 50 for v in want.values()) == 51


# -------------------------------------------------------------- 4 line dedup
def test_spread_lines(spark, messy, nothing):
    rows = [(k, f"own {k}\nshared by {12 - k % 2}\n\nshared by all", f"s{k % 12}") for k in range(24)]
    rows += [(100 + k, "eleven sites only", f"t{k}") for k in range(9)] + [(None, "shared by all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_spread.drop_spread_lines(docs).collect()}
    assert got[0].text == rows[0][1] and got[1].text == "own 1\nshared by 11\n"  # first documents keep their lines
    assert got[None].n_removed == 1 and got[100].n_removed == 0
    for r in line_spread.drop_spread_lines(messy, min_sites=3).collect():
        assert r.n_removed <= r.n_lines
    assert line_spread.drop_spread_lines(messy, min_sites=3).count() == messy.count()
    assert line_spread.drop_spread_lines(nothing).count() == 0


def test_null_and_empty_sites_differ(spark):
    """Eight named sites, the empty string and null are ten sites."""
    rows = [(k, "shared", s) for k, s in enumerate([*[f"s{j}" for j in range(8)], "", None])]
    cut = line_spread.drop_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.n_removed) for r in cut.collect()) == [(k, int(k > 0)) for k in range(10)]


def test_spread_lines_of_messy_documents(messy):
    """Clashing columns, an id with two texts, and 100,000 lines, against the plain version."""
    cut = line_spread.drop_spread_lines(messy, min_sites=2, counts=False)
    assert cut.columns == messy.columns and {r.n_lines for r in cut.collect()} == {7}
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter(brute.spread_lines(rows, 2))
    counted = line_spread.drop_spread_lines(messy, min_sites=2)
    assert {r.n_lines for r in counted.filter("doc_id = 15").collect()} == {100_000}


def test_many_shared_lines_take_time_in_proportion(spark):
    """Twelve documents of 40,000 shared lines each."""
    import time

    text = "\n".join(f"shared line {k}" for k in range(40_000))
    docs = spark.createDataFrame([(k, text, f"s{k}") for k in range(12)], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: (r.n_removed, len(r.text)) for r in line_spread.drop_spread_lines(docs).collect()}
    assert got == {k: (40_000, 0) if k else (0, len(text)) for k in range(12)}
    assert time.time() - began < 60


def test_near_threshold_lines_are_exact(spark):
    """Even a coarse sketch decides as an exact count does."""
    rows = [(line * 100 + s, f"line {line}", f"site {s}") for line in range(40) for s in range(20 + line)]
    docs = spark.createDataFrame(rows, "doc_id long, line string, site string")
    lines = docs.select("doc_id", "site", line_spread.line_hash(F.col("line")).alias("hash"))
    assert line_spread.spread_lines(lines, 40, lg_k=6, band=6.0).count() == 20


# ------------------------------------------------------------------ 5 mixing
def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "é": 700, None: 300, "z": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(1, 500, 800), np.full(800, 0.37)
    out = mixing.fly(size, chance, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(chance.sum()) and (out * size).sum() == pytest.approx((chance * size).sum())


@pytest.mark.parametrize("share", [0.03, 0.37, 0.9])
def test_landing_meets_the_words(share):
    """Even with very long documents, and each document is drawn about as often as it should be."""
    size = np.r_[np.random.default_rng(1).integers(1, 1500, 900), 20_000, 15_000, 9_000]
    draws = np.array([mixing.land(size, np.full(len(size), share), np.random.default_rng(s)) for s in range(60)])
    assert set(np.unique(draws)) <= {0.0, 1.0}
    assert np.abs(draws @ size - share * size.sum()).max() < 60
    assert abs(draws.mean() - share) < 0.02 and np.abs(draws.mean(axis=0) - share).mean() < 0.09


def test_mixture(messy, nothing, small):
    sized = small.select("doc_id", F.col("n_chars").alias("size"), "source")
    for bucket_rows in (4096, 16):
        got = mixing.draw_copies(sized, bucket_rows=bucket_rows).collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in sized.collect())
        sources = defaultdict(lambda: [0, 0.0, 0])
        for r in got:
            assert 0 <= r.copies <= 3
            sources[r.source][0] += r.copies * r.size
            sources[r.source][1] = r.target
            sources[r.source][2] = max(sources[r.source][2], r.size)
        # ten documents a source here: what is missed is less than the longest
        assert all(abs(taken - target) <= longest for taken, target, longest in sources.values())
        assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.draw_copies(sized, bucket_rows=bucket_rows).collect()))
    decisions = mixing.mix_decisions(messy).collect()
    assert len(decisions) == messy.count()
    mixed = mixing.mix_sources(messy)
    assert mixed.columns == messy.columns and mixed.count() == sum(r.copies for r in decisions)
    assert mixing.mix_decisions(nothing).count() == mixing.mix_sources(nothing).count() == 0


# ----------------------------------------------------------------- 6 packing
def packed(df, **options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack_documents(df, queries.tokenizer_path(), **options).collect()
    want = Counter((d, *p) for d, t in pairs(df) for p in brute.pieces(t, tokenizer))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), -(-sum(r.length for r in rows) // 2048)


def test_packing(messy, nothing, small):
    packed(messy)
    bins, bound = packed(small)
    assert bins <= bound * 1.02 + 1
    packed(small, block_rows=64, rounds=3)  # many blocks that are not solved at once
    assert packing.pack_documents(nothing, queries.tokenizer_path()).count() == 0


def test_words_apart_equal_whole_texts():
    """Cached word by word, or in a cache that overflows, tokens are those of the whole text."""
    al = "aBcÄöéÉßñçİıſKÅﬁ ǅ'’`.,!?;:-1234567890½²٣中文ひらк РӜ\u0301\u200d\u00a0\u2003 \t\n\x1c😀#$%<|>\"ªº"
    rng = np.random.default_rng(5)
    texts = ["".join(al[k] for k in rng.integers(0, len(al), rng.integers(1, 40))) for _ in range(8000)]
    texts += ["don't I'LL we've 'S x's. a.b,c word.,! ...word, É\u0301., <|endoftext|> word<|endoftext|>", ""]
    for limit in (1_000_000, 50):
        tokens = packing.WordTokens(queries.tokenizer_path(), limit)
        for text in texts:
            ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(tokens.encode(text.encode()), "<u4").tolist() == ids, text


def test_crossover_and_evolution():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 1100, 400)
    parents = []
    for order in (np.arange(400), np.argsort(-lengths)):
        p, fill = np.full(400, -1), []
        packing.best_fit(lengths, order, p, fill, 2048)
        parents.append(p)
    for _ in range(20):
        child = packing.crossover(lengths, *parents, rng)
        assert child.min() == 0 and np.bincount(child, weights=lengths).max() <= 2048
        assert (np.bincount(child) > 0).all()
        parents = [parents[1], child]
    best, _ = packing.evolve(lengths, [], np.random.default_rng(0), 2048, 6, 4)
    first, _ = packing.evolve(lengths, [], np.random.default_rng(0), 2048, 0, 1)
    assert packing.lower_bound(lengths, 2048) <= best.max() + 1 <= first.max() + 1


def test_islands_beat_best_fit():
    """Three pieces fill a sequence exactly; longest first, best fit wastes sequences that the islands win back."""
    rng = np.random.default_rng(11)
    wins = 0
    for seed in range(4):
        a = rng.integers(520, 700, 60)
        b = np.array([rng.integers(max(520, 2048 - x - 800), 2048 - x - 519) for x in a])
        lengths = np.concatenate([a, b, 2048 - a - b])
        alone, fill = np.full(len(lengths), -1), []
        packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), alone, fill, 2048)
        parents = [packing.evolve(lengths, [], np.random.default_rng([seed, i]), 2048, packing.GENERATIONS, packing.POPULATION)[0]
                   for i in range(packing.ISLANDS)]
        best, _ = packing.evolve(lengths, parents, np.random.default_rng(seed), 2048, 40, 8)
        bins = np.bincount(best, weights=lengths)
        assert bins.max() <= 2048 and len(bins) >= packing.lower_bound(lengths, 2048) == 60
        wins += len(bins) < len(fill)
    assert wins == 4


# ---------------------------------------------------------------- 7 sharding
def test_jump_hash():
    keys = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 500)
    for n in (1, 2, 24, 25, 1000):
        assert np.array_equal(sharding.jump_shards(keys, n), [brute.jump(int(k), n) for k in keys])


@pytest.mark.parametrize("rows_per_bucket", [200_000, 1])
def test_shards(messy, small, nothing, rows_per_bucket):
    for df in (messy, small):
        got = sharding.assign_shards(df, 24, rows_per_bucket=rows_per_bucket).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 8) for i, t in pairs(df))
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and r.grown_shard in (r.shard, 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign_shards(nothing).count() == 0


# ------------------------------------------------------------- 8 n-gram join
def unique_ids(df):
    return df.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(df.filter("doc_id is null"))


def test_similar_documents(messy, nothing, small, small_rows):
    for df, rows in ((unique_ids(messy), pairs(unique_ids(messy))), (small, small_rows)):
        got = ngram_join.similar_documents(df).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.similar(rows)
    assert ngram_join.similar_documents(messy).count() == messy.count()
    assert ngram_join.similar_documents(nothing).count() == 0


@pytest.mark.parametrize(("percent", "n"), [(40, 1), (50, 1), (85, 1), (50, 3)])
def test_any_percent(spark, percent, n):
    """Small sets too: a pair may be similar by one shared element."""
    rng = np.random.default_rng(percent + n)
    rows = [(0, "a"), (1, "a b"), (2, "b"), (3, "c d e"), (4, "c")]
    rows += [(10 + k, " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 12)))) for k in range(150)]
    rows += [(200 + k, " ".join(f"v{x}" for x in np.r_[0:60 - k, 1000 * k:1000 * k + k])) for k in range(30)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.similar(rows, n, percent)
    assert {r.doc_id: r.n_links for r in got} == brute.link_counts(rows, n, percent)


def test_counters_follow_the_input(spark):
    """More input gets more counters; full counters alone make no list hot, an element well above the others does."""
    assert [ngram_join.counter_cells(b) for b in (0, 10 ** 9, 10 ** 12, 10 ** 14)] == [1 << 20, 1 << 20, 1 << 22, 1 << 24]
    rng = np.random.default_rng(1)
    elements = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
    for mean in (10, 70_000, 10 ** 6):
        counts = rng.poisson(mean, 1 << 20).astype(np.uint64)
        heavy = int(elements[0] >> np.uint64(44))
        counts[heavy] += np.uint64(10 * (mean + ngram_join.HOT_SETS))
        levels = np.minimum(255, ngram_join.LEVELS * np.log2(1.0 + counts)).astype(np.uint8)
        _, hot = ngram_join._postings(elements, levels, 0, 40, ngram_join.hot_level(counts))
        assert not hot.any()  # the frequent element comes last and is not posted
        assert (levels >= ngram_join.hot_level(counts)).sum() == 1


@pytest.mark.parametrize("block", [500, 7])
def test_similar_families(spark, monkeypatch, block):
    """Large families of edited copies, small sets, and boundary cases, with long lists cut into blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for family, (size, members, edits) in enumerate([(120, 60, 4), (400, 40, 12), (24, 40, 1), (9, 30, 1), (40, 50, 2)]):
        base = [f"f{family}w{k}" for k in range(size)]
        for m in range(members):
            text = list(base)
            for at in rng.integers(0, size, rng.integers(0, edits + 1)):
                text[at] = f"e{rng.integers(1 << 30)}"
            rows.append((int(rng.integers(1 << 40)), " ".join(text[:size - int(rng.integers(0, 2))])))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.similar(rows)


def test_candidate_sets_are_not_shuffled_by_node(spark, monkeypatch):
    """Whole sets are stored once by node: pairs move them at most once, groups too, and each step's shuffle files go at its end."""
    plans, settings, write = {}, set(), ngram_join.shared_table

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        settings.add(spark.conf.get(session.SHUFFLE_CLEANUP))
        return write(df, name)

    monkeypatch.setattr(ngram_join, "shared_table", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    try:
        words = [f"w{k}" for k in range(100)]
        rows = [(k, " ".join([*words, f"x{k}"])) for k in range(40)] + [(100 + k, " ".join([*words[:60], f"y{k}", f"y{k}"])) for k in range(9)]
        got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0) for k in range(40)} | {(100 + k, 100) for k in range(9)}
    assert settings == {"true"} and spark.conf.get(session.SHUFFLE_CLEANUP, None) == before
    assert plans["pair-links"].count("Bucketed: true") == 2 and plans["group-links"].count("Bucketed: true") == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("attrix_") and not t.isTemporary]


@pytest.mark.parametrize("block", [500, 7])
def test_links_are_all_counted(spark, monkeypatch, block):
    """n_links is the number of similar documents, in pairs, families cut into blocks and copies alike."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(None, "a text without an id")]
    for family, (size, members, edits) in enumerate([(120, 45, 6), (300, 30, 25), (24, 30, 1), (60, 8, 2)]):
        for _ in range(members):
            text = [f"f{family}w{k}" for k in range(size)]
            for at in rng.integers(0, size, rng.integers(0, edits + 1)):
                text[at] = f"e{rng.integers(1 << 30)}"
            rows += [(len(rows) + k, " ".join(text)) for k in range(int(rng.integers(1, 3)))]
    rows.append((None, rows[1][1]))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.link_counts(rows)
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == want and max(want.values()) > 20
    assert [r.n_links for r in got if r.doc_id is None] == [0, 0]


@pytest.mark.parametrize("block_bytes", [8 << 20, 4000])
def test_hot_lists(spark, monkeypatch, block_bytes):
    """A family on a third of all rows: no task meets a whole list, blocks are cut by bytes, results stay."""
    monkeypatch.setattr(ngram_join, "HOT_SETS", 15)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 100)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    met, groups = ngram_join._met, ngram_join._group_links

    def bounded(table, *options):
        out = met(table, *options)
        assert all(table["bucket"][0].as_py() < 0 or n <= 16 for n in Counter(out.filter(out["kind"].to_numpy() == 1)["a"].to_pylist()).values())
        return out

    def small(table, percent):
        total = sum(len(e.as_py()) for e in table["elements"])
        assert block_bytes > 4000 or total <= 6 * block_bytes, total
        return groups(table, percent)

    monkeypatch.setattr(ngram_join, "_met", bounded)
    monkeypatch.setattr(ngram_join, "_group_links", small)
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"r{rng.integers(1 << 30)}" for _ in range(40))) for k in range(100)]
    for k in range(60):
        text = [f"w{j}" for j in range(40 if k < 30 else 200)]
        text[int(rng.integers(0, len(text)))] = f"e{rng.integers(1 << 30)}"
        rows.append((1000 + k, " ".join(text)))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.similar(rows)
    assert {r.doc_id: r.n_links for r in got} == brute.link_counts(rows)


def test_frequent_shingles_by_chance_make_no_candidates(spark, monkeypatch):
    """Documents that share a few frequent shingles and nothing else stay out of all groups; families and pairs are still found."""
    monkeypatch.setattr(ngram_join, "CELLS", 2)  # counters that tell nothing apart, as a much larger table's
    written, write = {}, ngram_join.shared_table

    def noted(df, name="table"):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(ngram_join, "shared_table", noted)
    rng = np.random.default_rng(9)
    found = sorted((int(ngram_join.shingle_set(p.encode())[0]), p)
                   for p in (" ".join(f"c{k}x{j}" for j in range(4)) for k in range(2000)))
    upper = next(k for k, (h, _) in enumerate(found) if h >= 1 << 63)
    phrases = [p for _, p in found[:2] + found[upper:upper + 2]]  # first in the order, whichever of the two counters is lower
    rows = []
    for k in range(60):
        words = [f"r{rng.integers(1 << 40)}" for _ in range(200)]
        for j, phrase in enumerate(phrases):
            words[40 * j:40 * j] = phrase.split()
        rows.append((k, " ".join(words)))
    for k in range(30):
        words = [f"w{j}" for j in range(200)] if k < 26 else [f"v{k // 2}w{j}" for j in range(200)]
        words[int(rng.integers(0, 200))] = f"e{rng.integers(1 << 40)}"
        rows.append((1000 + k, " ".join(words)))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute.similar(rows)
    assert {r.doc_id: r.n_links for r in got} == brute.link_counts(rows)
    assert sorted(r.rep for r in written["candidates"].collect()) == list(range(1000, 1030))


def test_short_and_long_lists_share_the_work(spark):
    """What short lists leave to long ones grows with the number of shared elements, so that no pair is missed by both."""
    size = F.col("id")
    rows = spark.range(1, 500).select("id", ngram_join._short_share(size).alias("h"), ngram_join._long_share(32 * size).alias("m")).collect()
    left = [r.m for r in sorted(rows)]
    assert left == sorted(left) and all(r.h >= 1 and r.h + r.m == r.id + 1 for r in rows)
    assert spark.range(1, 64).filter(ngram_join._long_share(size) != 1).count() == 0
    for percent in (40, 85):  # a similar pair shares size // 32 posted elements or more, for either size
        for a in range(1, 300):
            for b in range(-(-percent * a // 100), a + 1):
                beyond = max(-(-percent * s // 100) - s // 32 - 1 for s in (a, b))
                assert -(-percent * (a + b) // (100 + percent)) - beyond >= max(1, a // 32)



def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 103), (101, 103), (102, 100)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in ngram_join.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[k] == 100 for k in (101, 102, 103))
    assert all(got[k] == 500 for k in range(501, 560))


# ---------------------------------------------------------- 9 quality rules
def test_quality(messy, small, nothing):
    for df in (messy, small):
        got = quality_rules.judge_quality(df).collect()
        base = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
        assert base == Counter((i, *brute.quality(t)) for i, t in pairs(df))
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and not r.failed)
    assert quality_rules.judge_quality(nothing).count() == 0


def plain_fences(rows, prior=quality_rules.PRIOR_ROWS):
    """rows: (lang, source, {measure: value}) of documents with words -> {(lang, source): {measure: (low, high)}}."""
    q = quality_rules

    def quantile(values, rank):
        return values[min(len(values) - 1, max(0, int(np.ceil(rank * len(values) - 1e-9)) - 1))]

    def cut(points):
        best = None
        total, whole = sum(w for _, w in points), sum(v * w for v, w in points)
        square = sum(v * v * w for v, w in points)
        w1 = s1 = q1 = 0.0
        for k, ((v, w), (nxt, _)) in enumerate(zip(points, points[1:])):
            w1, s1, q1 = w1 + w, s1 + v * w, q1 + v * v * w
            if nxt > v:
                w2 = total - w1
                m1, m2 = s1 / w1, (whole - s1) / w2
                d1, d2 = max(q1 / w1 - m1 * m1, 0) ** 0.5, max((square - q1) / w2 - m2 * m2, 0) ** 0.5
                found = (w1 * w2 * (m2 - m1) ** 2, -k, (v + nxt) / 2, k, nxt - v, (m2 - m1) / (d1 + d2 + 1e-9), w2 / total,
                         points[-1][0] - nxt)
                best = max(best, found) if best else found
        return best

    def split(values):
        points = [(quantile(values, (i + 0.5) / q.POINTS), 1.0) for i in range(q.POINTS)] + [(values[-1], 0.5)]
        fence = None
        for level in range(q.CUTS):
            best = cut(points)
            if not best or best[5] < q.APART or best[6] > q.MINORITY or (level and best[4] < best[7]):
                break
            fence, points = best[2], points[:best[3] + 1]
        return fence

    def level(key):
        groups = defaultdict(list)
        for lang, source, m in rows:
            groups[key(lang, source)].append(m)
        out = {}
        for k, ms in groups.items():
            length = sorted(m[q.LENGTH] for m in ms)
            a, b, c = (quantile(length, r) for r in (0.1, 0.5, 0.9))
            out[k] = {"n": len(ms), "low": a - q.REACH * (b - a) - q.SLACK, "high": c + q.REACH * (c - b) + q.SLACK}
            for r in q.RATES:
                values = sorted(m[r] for m in ms)
                out[k][r] = split(values)
                mid = quantile(values, 0.5)
                out[k][r, "bulk"] = mid + 2 * q.TO_TENTH * (quantile(values, 0.75) - mid)
        return out

    corpus, langs, own = level(lambda *_: 0), level(lambda lang, _: lang), level(lambda lang, source: (lang, source))

    def pulled(value, n, parent):
        if value is None or parent is None:
            return parent if value is None else value
        return (n * value + prior * parent) / (n + prior)

    out = {}
    for (lang, source), g in own.items():
        def fence(name, g=g, lang=lang):
            return pulled(g[name], g["n"], pulled(langs[lang][name], langs[lang]["n"], corpus[0][name]))
        out[lang, source] = {r: None if fence(r) is None else min(max(fence(r), g[r, "bulk"]), 1.0) for r in q.RATES}
        out[lang, source][q.LENGTH] = (fence("low"), fence("high"))
    return out


def test_fences_against_plain_version(spark, messy, small):
    """Every fence and every verdict, from exact quantiles (the sketches of such small groups hold all values)."""
    for df, prior in ((messy, 500), (small, 500), (small, 20)):
        docs = quality_rules.text_measures(df.select("doc_id", "lang", "source", "text"))
        measured = quality_rules._with_rates(docs)
        rows = [(r.lang, r.source, r.asDict()) for r in measured.collect() if r.n_words]
        want = plain_fences(rows, prior)
        got = {(r.lang, r.source): r for r in quality_rules.fitted_fences(measured, prior).collect()}
        assert got.keys() == want.keys()
        for key, r in got.items():
            assert (r.mean_word_low, r.mean_word_high) == pytest.approx(want[key]["mean_word"])
            for m in quality_rules.RATES:
                assert r[f"{m}_high"] == (None if want[key][m] is None else pytest.approx(want[key][m])), (key, m)
        for r in quality_rules.judge_quality(df, prior_rows=prior).collect():
            if r.n_words:
                limits = want[r.lang, r.source]
                failed = {m for m in quality_rules.RATES if limits[m] is not None and r[m] > limits[m] + 1e-12}
                assert failed | ({"mean_word"} if not limits["mean_word"][0] <= r.mean_word <= limits["mean_word"][1] else set()) == set(r.failed)


def test_thresholds_follow_the_group(spark):
    """The same text is usual in one source and rejected in another."""
    odd = " ".join(f"| w7y{k} # |" for k in range(20))
    rows = [(k, "en", "tables", " ".join(f"| w{k}x{j} # |" for j in range(20))) for k in range(300)]
    rows += [(1000 + k, "en", "prose", " ".join(f"word{k}x{j}" for j in range(40))) for k in range(300)]
    rows += [(5000, "en", "tables", odd), (5001, "en", "prose", odd)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(
        spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got[5000] and not got[5001] and got[0] and got[1000]


def test_junk_does_not_move_its_fence(spark):
    """A source with 15% of junk lines rejects them, as one with less does."""
    def text(k, junk):
        return " ".join(f"w{k}x{j} ##|" if junk else f"word{k}x{j}" for j in range(30))
    rows = [(1000 * share + k, "en", f"s{share}", text(k, k < 3 * share)) for share in (2, 15) for k in range(300)]
    got = quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    assert {r.doc_id for r in got.filter("array_contains(failed, 'symbol_rate')").collect()} == {
        i for i, _, s, _ in rows if i % 1000 < 3 * int(s[1:])}


# --------------------------------------------------------------- 10 toxicity
def test_toxicity(spark, messy, nothing):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(900):
        bad, shout = k % 5 == 0, k % 4 == 0
        text = [f"w{rng.integers(3000)}" for _ in range(80)] + (["vilest", f"nasty{rng.integers(9)}"] if bad else [])
        rows.append((k, " ".join(text) + (" shouting loud" if shout else ""), "x"))
        if k < 600:
            labels.append((k, int(shout), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    known = spark.createDataFrame(labels, "doc_id long, loud int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge_toxicity(docs, known, ("loud", "toxic")).collect()}
    held = range(600, 900)
    assert len(got) == 900 and np.mean([got[k].toxic == (k % 5 == 0) for k in held]) > 0.97
    assert all(got[k].kept != got[k].toxic for k in held)
    kept = toxicity.drop_toxic(docs, known, ("loud", "toxic"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k].kept}
    assert toxicity.judge_toxicity(messy, known, ("loud", "toxic")).count() == messy.count()
    assert toxicity.judge_toxicity(nothing, known, ("loud", "toxic")).count() == 0
    none = toxicity.judge_toxicity(docs, known.filter("false"), ("loud", "toxic"))
    assert none.filter("toxic").count() == 0 and none.count() == 900


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, messy):
    import corpus_pipeline

    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert 2 not in ids  # a copy of 1


def test_pipeline_against_plain_versions(spark):
    """Each stage on what its predecessor kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    judged = {r.doc_id: r.toxic for r in toxicity.judge_toxicity(docs, queries.toxicity_labels(spark, SF)).collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        if name == "toxicity":
            assert sorted(rows) == sorted(r for r in before if not judged[r.doc_id])
        elif name == "line_dedup":
            want = brute.spread_lines([(r.doc_id, r.text, r.source) for r in before], line_spread.MIN_SITES)
            assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((i, t, len(t)) for i, t in want)
        elif name == "near_duplicates":
            stay = {i for i, _, c in brute.similar([(r.doc_id, r.text) for r in before], n=5, percent=80) if i == c}
            assert sorted(rows) == sorted(r for r in before if r.doc_id in stay)
        elif name == "mixture":
            copies = {r.doc_id: r.copies for r in mixing.mix_decisions(docs).collect()}
            assert Counter(rows) == Counter({r: copies[r.doc_id] for r in before if copies[r.doc_id]})
        else:
            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(
                (r.doc_id, *p) for r in before for p in brute.pieces(r.text, tokenizer))
            continue
        before, docs = rows, spark.createDataFrame(rows, docs.schema)


def test_near_duplicates_of_the_stage(spark):
    """One changed word in 50: similar at 5 words and 80%, not at 4 words and 85%."""
    import corpus_pipeline

    base = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:25], "other", *base[26:]])), (3, " ".join(base[::-1]))]
    assert {i for i, _, c in brute.similar(rows) if i == c} == {1, 2, 3}
    stay = {i for i, _, c in brute.similar(rows, n=5, percent=80) if i == c}
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r.doc_id for r in got.collect()} == stay == {1, 3}


def test_an_id_with_two_texts(spark):
    """A copy goes though its id also names another text, and repeated rows are one document."""
    import corpus_pipeline

    t = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"z{k}" for k in range(60))
    rows = [(1, t, 0), (5, t + " more", 0), (5, other, 0), (5, other, 0), (5, other, 1), (7, "lone", 0), (7, "lone text", 0),
            (8, other + " end", 0), (9, "", 0), (9, None, 0), (None, t, 0), (None, t, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, t), (5, other), (7, "lone"), (7, "lone text"), (9, ""), (9, None), (None, t), (None, t)])


def test_stages_of_an_empty_table(spark, nothing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == nothing.columns)


def test_mixed_copies_of_repeated_rows(spark):
    """Rows that share id, source and text share out their draws; each copy keeps its own other columns."""
    rows = [(k % 5, f"text {k % 5} of words", f"s{k % 2}", k) for k in range(40)] + [(9, "once here", "s0", 99), (None, None, None, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    drawn = {(r.doc_id, r.source): 0 for r in docs.collect()}
    for r in mixing.mix_decisions(docs).collect():
        drawn[r.doc_id, r.source] += r.copies
    got = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter({k: n for k, n in drawn.items() if n})
    each = Counter(r.copies for r in got)
    for key in drawn:
        same = [each[k] for i, _, s, k in rows if (i, s) == key]
        assert max(same) - min(same) <= 1


def test_pipeline_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    bins = defaultdict(int)
    for r in out.collect():
        bins[r.sequence_id] += r.length
    assert bins and max(bins.values()) <= 2048
