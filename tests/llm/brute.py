"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(ids, [x for x in links if sets[x[1]]])
    return {i: (len(sets[i]), found[i], found[i] == i) for i in ids}


def repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def contaminated(docs, items, least=0.8, k=5):
    def terms(s):
        return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", lower(s or ""))

    def grams(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = defaultdict(float)
    for d, text in docs:
        w = terms(text)
        for j, item in items:
            own = terms(item)
            if not own:
                continue
            n = min(k, len(own))
            want, have = Counter(grams(own, n)), grams(w, n)
            m = len(own) - n + 1
            for s in range(max(1, len(have) - m + 1)):
                window = Counter(have[s : s + m])
                both = sum((window & want).values())
                value = both / (sum(window.values()) + m - both)
                if value >= least:
                    out[d, j] = max(out[d, j], value)
    return dict(out)
