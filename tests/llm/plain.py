"""Plain-Python versions of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = "[\\x20\\x09-\\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def rule_counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    hit = {p for i, g in enumerate(grams) if often[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(hit), "base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w)}


def bad_hosts(rows):
    """rows: (source, base_failed)"""
    per = defaultdict(list)
    for host, failed in rows:
        if host is not None:
            per[host].append(failed)
    if not per:
        return set()
    rates = [sum(x) / len(x) for x in per.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    k = 100.0 if var <= 1e-12 else min(max(mean * (1 - mean) / var - 1, 1.0), 1e6)
    return {h for h, x in per.items() if (sum(x) + mean * k) / (len(x) + k) > 0.5}


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(items, near):
    """Index -> smallest index of its component, by comparing all pairs."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def mark_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)


def hits(text, items):
    """(words, hit words, items with a window) of a text; items: (id, text)."""
    w = mark_words(text)
    hit, found = set(), set()
    for item, words_of in items:
        v = mark_words(words_of)
        n = min(len(v), 10)
        for i in range(len(v) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k:k + n] == v[i:i + n]:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), found


def mix(rows):
    """rows: (doc_id, source, text) -> (targets by source, copies by row)."""
    size = [len(words(t)) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in sources}
    budget, target, free = sum(size), {}, set(sources)
    while free:
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * total[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: 3.0 * total[s] for s in over})
        free -= over

    def key(i):
        d, _, t = rows[i]
        text = f"{'' if d is None else d}:{t or ''}"
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16), d is not None, d or 0, size[i], i

    queue = []
    for rank, s in enumerate(sources):
        at = 0
        mine = sorted((i for i in range(len(rows)) if rows[i][1] == s), key=key)
        for _ in range(3):
            for i in mine:
                at += size[i]
                if size[i]:
                    queue.append((at * (10 // weight[s]), rank, i))
    copies, used = [0] * len(rows), 0
    for _, _, i in sorted(queue):
        used += size[i]
        if used > budget:
            break
        copies[i] += 1
    return {s: target.get(s, 0.0) for s in sources}, total, copies


def crc(text):
    return zlib.crc32((text or "").encode())
