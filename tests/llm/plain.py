"""The operators' results by the plainest means, for small tables."""

import re
from collections import Counter

import numpy as np


def distance(a, b):
    row = np.arange(len(b) + 1)
    at = np.arange(len(b) + 1)
    b = np.array(b, dtype=object)
    for i, x in enumerate(a, 1):
        cost = np.concatenate([[i], np.minimum(row[:-1] + (b != x), row[1:] + 1)])
        row = np.minimum.accumulate(cost - at) + at
    return int(row[-1])


def linked(a, b, similarity=0.8):
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    spare = max(sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values()))
    return spare <= most and distance(a, b) <= most


def words(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text).encode().split()


def groups(texts):
    """Smallest index of each text's group of near copies."""
    own = [words(t) for t in texts]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if find(i) != find(j) and (own[i] == own[j] or (own[i] and own[j] and linked(own[i], own[j]))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(own))]


def without_repeats(docs, size=20):
    """{doc_id: (words, removed, text)} of substring dedup."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = text.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            if key in seen:
                gone[s:s + size] = [True] * size
            seen.add(key)
        out[doc] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def without_line_runs(docs):
    """{doc_id: text} of line dedup: two content lines in a row, or one of 50 words, that stood before."""
    seen, out = set(), {}
    blank = " \t\n\x0b\x0c\r"
    for doc, text in sorted(docs):
        lines = text.split("\n")
        full = [(i, x.strip(blank)) for i, x in enumerate(lines) if x.strip(blank)]
        runs = [((a[1], b[1]), a[0], b[0]) for a, b in zip(full, full[1:])]
        runs += [((x,), i, i) for i, x in full if len(re.split(r"[ \t\x0b\f\r]+", x)) >= 50]
        gone = set()
        for key, first, last in sorted(runs, key=lambda r: r[1]):
            if key in seen:
                gone.update(range(first, last + 1))
            seen.add(key)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def good(text):
    """The verdict of the current quality policy."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    chars = sum(map(len, w))
    return not (len(w) < 10 or 100 * len(covered) > 20 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w)
                or chars < 2 * len(w) or chars > 15 * len(w) or 2 * len(re.findall("[A-Z]", text)) > chars)


def bench_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def leaked(text, items, size=10):
    patterns = set()
    for item in items:
        w = bench_words(item)
        m = min(size, len(w))
        patterns |= {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set()
    w = bench_words(text)
    return any(tuple(w[i:i + m]) in patterns for m in {len(p) for p in patterns} for i in range(len(w) - m + 1))
