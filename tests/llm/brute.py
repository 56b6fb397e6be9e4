"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows):
    """doc_id -> (n_shingles, component_id), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def without_repeats(rows, window=13):
    """doc_id -> (n_words, n_removed, digest)."""
    tokens = {d: words(t, lower=False) for d, t in rows}
    least = {}
    for d, w in tokens.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in tokens.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_scores(rows, held):
    """doc_id -> (n_tokens, n_known, N, base score)."""
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*words(t), None])
    total, types = sum(counts.values()), len(counts)
    out = {}
    for d, t in rows:
        tokens = [*words(t), None]
        score = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in tokens)
        out[d] = (len(tokens), sum(counts[x] > 0 for x in tokens), total, score)
    return out


def luhn(digits):
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text):
    """The four base kinds as written in the contract."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def mixed(sizes):
    """``[(doc_id, source, size)]`` -> source totals and targets, by resharing until none is above."""
    per = defaultdict(int)
    for _, source, size in sizes:
        per[source] += size
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, fixed = 1.5 * sum(per.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * per[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * per[s]
        left = 1.5 * sum(per.values()) - sum(fixed.values())
    return per, {s: fixed.get(s, left * weight[s] / sum(weight[x] for x in free) if free else 0) for s in order}


def contaminated(docs, items, least=0.75):
    """{(doc_id, item_id): (item shingles, shared)}"""
    out = {}
    for i, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, t in docs:
            x = words(t)
            shared = len(want & {tuple(x[j : j + k]) for j in range(len(x) - k + 1)})
            if shared >= least * len(want):
                out[d, i] = (len(want), shared)
    return out


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
