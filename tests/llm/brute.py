"""The agreed results worked out the plain way, on lists of (doc_id, text)."""

import collections
import itertools
import math
import re

import xxhash

PLAIN, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PLAIN.findall(text or "")


def letter_words(text):
    return LETTERS.findall((text or "").encode().lower())


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs):
    """doc_id: (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = collections.Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def repeated_passages(texts, width=35):
    """(n_words, n_removed, kept) of each text."""
    split = [words(t) for t in texts]
    count = collections.Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = {p for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def _bucket(*parts, buckets=1 << 14):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _grams(text):
    w = words(text)
    return [_bucket(x) for x in w] + [_bucket(a, b) for a, b in itertools.pairwise(w)]


def quality(docs, trusted, threshold=-0.1, buckets=1 << 14):
    """(base_failed, llr, kept) of each of the docs (doc_id, text)."""
    raw, target = collections.Counter(), collections.Counter()
    grams = [_grams(t) for _, t in docs]
    for (d, _), g in zip(docs, grams, strict=True):
        raw.update(g)
        if d in trusted:
            target.update(g)
    n, m, out = sum(raw.values()), sum(target.values()), []
    weight = lambda b: math.log((target[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets)) if m else 0.0
    for (_, t), g in zip(docs, grams, strict=True):
        w = words(t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        llr = sum(map(weight, g)) / len(g) if g else None
        out.append((failed, llr, not failed and llr is not None and llr >= threshold))
    return out


def leaks(texts, items, width=10):
    """Whether any window of an item stands in each text."""
    windows = {tuple(w[k : k + width]) for w in map(letter_words, items) for k in range(max(1, len(w) - width + 1) if w else 0)}
    sizes = {len(x) for x in windows}
    return [any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)) for w in map(letter_words, texts)]
