import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.grammar import Grammar
from docweave.llm.periodic_runs import find_runs, periodic_runs, run_digests, with_periodic_tails

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All runs by their definition: (start, length, period)."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def got_runs(sequences):
    doc, start, length, period = find_runs([np.array(s, np.int64) for s in sequences])
    return [[(int(s), int(n), int(q)) for d, s, n, q in zip(doc, start, length, period, strict=True) if d == i] for i in range(len(sequences))]


SEQUENCE = st.one_of(
    st.lists(st.integers(0, 1), max_size=60),
    st.lists(st.integers(0, 3), max_size=60),
    st.tuples(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=8)).map(lambda x: x[0] + x[1] * x[2] + x[3]),
)


@settings(max_examples=500, deadline=None)
@given(st.lists(SEQUENCE, max_size=6))
def test_runs_equal_their_definition(sequences):
    assert got_runs(sequences) == [plain_runs(s) for s in sequences]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=70), min_size=1, max_size=4), st.data())
def test_extensions_equal_a_walk(sequences, data):
    words = [100]
    for k, s in enumerate(sequences):
        words += [*s, 101 + k]
    w = np.array(words)
    inside = [i for i, x in enumerate(words) if x < 100]
    pairs = data.draw(st.lists(st.tuples(st.sampled_from(inside), st.sampled_from(inside)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=30))
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    g = Grammar(w, w >= 100, until=data.draw(st.sampled_from([1, 4])))
    right, left = g.common(a, b), g.common(a, b, forward=False)
    for i, j, r, l in zip(a, b, right, left, strict=True):
        n = 0
        while words[i + n] == words[j + n]:
            n += 1
        m = 0
        while words[i - m] == words[j - m]:
            m += 1
        assert (r, l) == (n, m)


def test_long_runs_of_every_shape():
    rng = random.Random(7)
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    sequences = [[5] * 20_000, [0, 1, 2] * 4000 + [9] + [0, 1, 2] * 4000, b, [rng.randrange(50) for _ in range(5000)], [rng.randrange(700) for _ in range(700)] * 5, fib]
    want = [[(0, 20_000, 1)], [(0, 12_000, 3), (12_001, 12_000, 3)]]
    got = got_runs(sequences)
    assert got[:2] == want and got[4] == [(0, 3500, 700)]
    assert got[2] == plain_runs(b[:]) and got[3] == plain_runs(sequences[3])


def plain_rows(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        h, n = (zlib.crc32(str(d).encode()), len(w)) if d is not None else (1, 0)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def test_documents_equal_a_plain_version(spark):
    rng = random.Random(2)
    words = ["a", "b", "ça", "the", "x\x1cy", "中"]
    rows = [(d, rng.choice([" ", "\n", "\t "]).join(rng.choice(words[: rng.randint(1, 6)]) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for d in range(200)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "z z z z z z z"), (3, rows[3][1]), (600, "w " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, runs string").repartition(3)
    got = run_digests(periodic_runs(with_periodic_tails(df))).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_rows(rows), key=key)
    assert run_digests(periodic_runs(with_periodic_tails(df.limit(0)))).count() == 0


@pytest.mark.parametrize("q", [1, 2, 5])
def test_exactly_four_periods(q):
    base = list(range(q))
    n = max(6, 4 * q)
    assert got_runs([(base * 8)[:n]]) == [[(0, n, q)]]
    assert got_runs([(base * 8)[: n - 1]]) == [[]]
