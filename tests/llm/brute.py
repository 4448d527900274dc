"""Plain restatements of what the queries return, one document at a time, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def spaced(text, lower=False):
    text = text or ""
    return SPACED.findall(text.translate(LOWER) if lower else text)


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def decontaminated(docs, items, window=10):
    by = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            by[tuple(w[k : k + window])].add(i)
    sizes = {len(x) for x in by}
    out = []
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := by.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def warc(pages):
    best = {}
    for i, h in pages:
        best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, h in pages:
        b = (h or "").encode()
        first = best[h or ""] == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    return out


def shingle_set(text, size=5):
    w = spaced(text, True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = Counter()
    for own in by.values():
        for p in combinations(sorted(own), 2):
            pairs[p] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(d, len(sets[d]), root(d), root(d) == d) for d, _ in docs]


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = spaced(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = set()
        for i in range(len(w) - 7):
            if count[tuple(w[i : i + 8])] > 1:
                rep.update(range(i, i + 8))
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    return out


def substrings(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs):
        w, gone = spaced(t), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[d] = (d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return [out[d] for d, _ in docs]


def held_out(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def good_turing(counts, largest=5):
    """r to the count that is kept of r, from the counts of all n-grams of one order; by Katz's formula, else absolute discounting."""
    of = Counter(counts)
    b = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
    kept = {}
    for r in range(1, largest + 1):
        kept[r] = r - b
        if of[r] and of[1] and of[1] != (largest + 1) * of[largest + 1]:
            star = (r + 1) * of[r + 1] / of[r]
            cut = (largest + 1) * of[largest + 1] / of[1]
            if cut < 1 and 0 < (x := (star / r - cut) / (1 - cut)) < 1:
                kept[r] = x * r
    return lambda r: kept.get(r, r)


def katz(docs):
    """Rows of the query, P(w | a b), and the training words' counts."""
    tokens = {d: ["\0start", "\0start", *spaced(t, True), "\0end"] for d, t in docs}
    grams = [Counter(), Counter(), Counter()]
    for d, t in tokens.items():
        if not held_out(d):
            for order in range(3):
                grams[order].update(tuple(t[i - order : i + 1]) for i in range(2, len(t)))
    keeps = [good_turing(g.values()) for g in grams]
    words, n = grams[0], sum(grams[0].values())
    left = n - sum(map(keeps[0], words.values()))
    total, left = (n, left) if left > 1e-9 else (n + 1, 1)
    after = defaultdict(list)
    for order in (1, 2):
        for g, r in grams[order].items():
            after[g[:-1]].append((g[-1], r))
    history = {}

    def p(*g):
        if len(g) == 1:
            return keeps[0](words[g]) / total if words.get(g) else left / total
        h = g[:-1]
        if h not in after:
            return p(*g[1:])
        if h not in history:
            c, kept = sum(r for _, r in after[h]), sum(keeps[len(h)](r) for _, r in after[h])
            c += kept > c - 1e-9
            history[h] = c, (1 - kept / c) / (1 - sum(p(*h[1:], w) for w, _ in after[h]))
        c, alpha = history[h]
        r = grams[len(h)].get(g)
        return keeps[len(h)](r) / c if r else alpha * p(*g[1:])

    size = n + len(words) + 1
    out = []
    for d, _ in docs:
        t = tokens[d]
        own = [words.get((w,), 0) for w in t[2:]]
        score = sum(math.log10(p(*t[i - 2 : i + 1])) for i in range(2, len(t)))
        out.append((d, held_out(d), len(own), sum(c > 0 for c in own), n, sum(math.log10((c + 1) / size) for c in own), score))
    return out, p, words
