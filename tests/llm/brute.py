"""Plain versions of the contracts, for small tables."""

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    words = WORD.findall(text or "")
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in (i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
        n < 50 or 100 * len(hit) > 50 * n,
    )


def passages(text, least):
    """Words that a repeated passage of ``least`` words or more covers, and the longest repeat."""
    words = WORD.findall(text or "")
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest = max(longest, k)
                if k >= least:
                    covered.update(range(i, i + k))
    return len(covered), longest


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in rows}
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = components(sets, links)
    return {d: (len(sets[d]), of[d]) for d in sets}


def embeddings(rows, threshold=0.93):
    """{vec_id: (n_links, component_id)} of (vec_id, vector, label) rows."""
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, dtype=float), label)
    links = []
    for i in good:
        for j in good:
            (a, la), (b, lb) = good[i], good[j]
            if i < j and la == lb and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links.append((i, j))
    of = components([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in x for x in links), of[r[0]]) for r in rows}


def pieces(ids, capacity):
    ids = [*ids, 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    crc = lambda part: zlib.crc32(np.asarray(part, "<u4").tobytes())
    return [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
