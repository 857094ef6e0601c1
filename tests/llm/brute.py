"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, size=50):
    """docs: [(doc_id, text)] -> sorted [(doc_id, n_words, n_removed, kept_sha256)]."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for k in range(len(w) - size + 1 if doc_id is not None else 0):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if doc_id is not None else 0):
            if first[tuple(w[k:k + size])] < doc_id:
                gone[k:k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), sha(kept)))
    return sorted(out, key=repr)


def shingles(text, n=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1)))


def similar(docs, n=4, percent=85):
    """docs: [(doc_id, text)], unique ids -> sorted [(doc_id, n_shingles, component_id)]."""
    sets = {i: shingles(t, n) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in lists[x] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = [(i, len(s), root(i)) for i, s in sets.items()]
    return sorted(out + [(None, len(shingles(t, n)), None) for i, t in docs if i is None], key=repr)


def link_counts(docs, n=4, percent=85):
    """docs: [(doc_id, text)], unique ids -> {doc_id: number of similar documents}."""
    sets = [(i, shingles(t, n)) for i, t in docs if i is not None]
    out = dict.fromkeys((i for i, _ in sets), 0)
    for k, (i, s) in enumerate(sets):
        for j, other in sets[:k]:
            common = len(s & other)
            if common and 100 * common >= percent * (len(s) + len(other) - common):
                out[i] += 1
                out[j] += 1
    return out


def quality(text, size=5):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    again = [False] * len(w)
    for k in range(len(w) - size + 1):
        if windows[tuple(w[k:k + size])] > 1:
            again[k:k + size] = [True] * size
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(again))


def jump(key, shards):
    key, b, j = key & (2 ** 64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return host.translate(LOWER), path


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule(url):
    host, path = url_parts(url)
    best = (None, None)
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, verdict)
    return best


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, resharing what is cut off."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def pieces(text, tokenizer, capacity=2048):
    """[(piece, start, length, crc)] of a text, encoded whole."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    out = []
    for k, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start:start + capacity]
        out.append((k, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out


def spread_lines(docs, min_sites):
    """docs: [(doc_id, text, source)] -> [(doc_id, text)] without cross-site lines but in their first documents."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in docs:
        for line in (text or "").split("\n"):
            if words(line):
                sites[line].add(source)
                if doc_id is not None:
                    first[line] = min(first.get(line, doc_id), doc_id)
    out = []
    for doc_id, text, _ in docs:
        kept = [x for x in (text or "").split("\n")
                if not words(x) or len(sites[x]) < min_sites or (doc_id is not None and first.get(x) == doc_id)]
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out
