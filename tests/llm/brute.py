"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def smallest_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substring_dedup(rows, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)} of (doc_id, text) rows with distinct ids."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def jaccard_components(rows, size=4, percent=85):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = defaultdict(int)
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), k in common.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    near = smallest_reachable(sets, links)
    return {d: (len(s), near[d]) for d, s in sets.items()}


def repeated_bytes(rows, size=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] += 1
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out
