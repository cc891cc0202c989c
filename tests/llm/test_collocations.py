import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from docweave.llm import collocations as C
from docweave.llm.collocations import collocations, phrase_counts, slice_counts


def plain_counts(rows, longest=3):
    """{lang: Counter of phrases}."""
    f = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain(rows, longest=3, least=10, top=2000):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        n = sum(c for p, c in f.items() if " " not in p)
        cands = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in cands.items():
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 50 * a for q, b in cands.items()):
                continue
            w = p.split(" ")
            parts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(parts))
            kept.append((-score, -a, p.encode(), p, left, right))
        out += [(lang, i, p, -a, x, y, n, -s) for i, (s, a, _, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "ça", "x\x1cy", "z", *map(str, range(40))]
    rows = []
    for _ in range(n):
        w = [rng.choice(words[: rng.choice([5, 12, 48])]) + rng.choice(["", "", "", ",", ". ", "\n", "\x0b"]) for _ in range(rng.choice([0, 1, 2, 30, 120]))]
        rows.append((rng.choice(["en", "en", "fr", None, ""]), rng.choice([" ", "\t", "  "]).join(w)))
    return [*rows, ("en", None), (None, ""), ("xx", None), rows[5], rows[5], ("en", "new york city " * 2000), ("de", "a" * 30_000 + " b" * 500)]


@pytest.mark.parametrize("parts,shards,longest", [(1, 4, 3), (9, 4, 3), (6, 2, 4), (5, 3, 2)])
def test_equals_a_plain_version(spark, parts, shards, longest):
    rows = texts(parts)
    df = spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, n int, phrase string").repartition(parts)
    got = collocations(df, longest=longest, shards=shards, top=300)
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, top=300)


def test_every_active_phrase_is_counted_in_each_shard_once(spark):
    rows = texts(3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = Counter()
    for r in phrase_counts(df, least=5, shards=3).collect():
        got[r.lang, r.phrase] += r.n
    want = {(lang, p): n for lang, f in plain_counts(rows).items() for p, n in f.items()}
    assert all(want[k] == n for k, n in got.items())
    assert {k for k, n in want.items() if n >= 5 or " " not in k[1]} <= set(got)
    assert len(got) < len(want)  # rare phrases of rare parts never become active


def test_a_phrase_waits_for_both_parts_and_counts_one_cycle():
    never = np.full(1 << C.BITS, 255, np.uint8)
    word, pair = never.copy(), never.copy()
    word[C._entries(b"en\0", [b"a", b"b"])] = 1, 2
    found = {t: {k for k, *_ in slice_counts("en", [b"a b a b c"], t, 3, {1: word, 2: pair}, 3)} for t in range(7)}
    assert found == {0: {1}, 1: {1}, 2: {1, 2}, 3: {2}, 4: {2}, 5: set(), 6: set()}  # "a a" is not there; "a b" starts at 2
    assert {p for k, ps, *_ in slice_counts("en", [b"a b a b c"], 2, 3, {1: word, 2: pair}, 3) if k == 2 for p in ps} == {b"a b", b"b a"}


def test_a_shared_hash_value_does_not_begin_a_cycle_before_its_words():
    never = np.full(1 << C.BITS, 255, np.uint8)
    pair = never.copy()
    pair[C._entries(b"en\0", [b"a a"])] = 2  # another pair with this hash value was told of at step 2
    word = never.copy()
    word[C._entries(b"en\0", [b"a"])] = 3
    found = {t: {k for k, *_ in slice_counts("en", [b"a a a"], t, 3, {1: never if t < 3 else word, 2: pair}, 3)} for t in range(2, 8)}
    assert {t for t, ks in found.items() if 3 in ks} == {3, 4, 5}


def test_counts_are_whole_when_two_pairs_share_a_hash_value(spark):
    words = [b"w%d" % i for i in range(6000)]
    of = {}
    for w, e in zip(words, C._entries(b"en\0", [w + b" " + w for w in words]).tolist(), strict=True):
        of.setdefault(e, []).append(w.decode())
    early, late = next(ws for ws in of.values() if len(ws) > 1)[:2]
    few, many = f"{late} " * 4, f"{late} " * 20  # only the third shard makes the word frequent
    rows = [("en", f"{early} " * 30 + ". " + few), ("en", f"{early} " * 30 + ". " + few), ("en", many)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "lang string, text string")
    assert sorted(map(tuple, collocations(df).collect())) == plain(rows)


def test_hash_values_of_phrases_are_those_of_their_words():
    never = np.full(1 << C.BITS, 0, np.uint8)
    texts = [b"New york city, b new york  City", "ça b ça b c".encode()]
    for length, hashes, _, _, names, which in C._active("fr", texts, 0, 3, {1: never, 2: never}, 3):
        assert C._entry(hashes[which]).tolist() == C._entries(b"fr\0", names(which)).tolist()
        assert all(len(p.split(b" ")) == length for p in names(which))


def test_hash_sums_come_back_whole():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    packed = np.concatenate([values, values[:700]]) & ~np.uint64(255) | np.uint64(4)
    for ranges in (4, 9, 16):
        rest = np.uint64(64 - ranges - C._REST)
        want = Counter((packed >> rest).tolist())
        rows = C.pa.Table.from_batches([C._by_range(2, packed[:3000].copy(), ranges), C._by_range(2, packed[3000:].copy(), ranges)])
        got = {}
        for place in set(rows.column("range").to_pylist()):
            hashes, n = C._summed(rows.filter(C.pa.compute.equal(rows.column("range"), place)))
            got |= {(place << C._REST) + int(h): int(c) for h, c in zip(hashes, n, strict=True)}
        assert got == {h: 4 * c for h, c in want.items()}


def test_a_rare_phrase_sends_no_row_of_its_own(spark):
    rows = [("en", " ".join(f"r{i}x{j} s{j}" for j in range(2000))) for i in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    scan = C._scan(df, 0, 3, {1: np.zeros(1 << C.BITS, np.uint8), 2: np.zeros(1 << C.BITS, np.uint8)}, 3, 4, 10)
    assert scan.count() <= 4 * 3 * 16  # tasks, lengths, ranges


def test_names_are_added_up_over_tasks_and_parts_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(C, "_NAMES", 20)
    rows = [r for r in texts(4) if r[1]]
    every = {k: np.full(1 << (C.FINAL_BITS - 3), 255, np.uint8) for k in (1, 2, 3)}
    df = spark.createDataFrame(rows, "lang string, text string").na.fill("und").repartition(5)
    got = {(r.lang, r.phrase): r.n for r in C._named(df, every, 3, 6, False).collect()}
    want = {(lang, p): n for lang, f in plain_counts(rows).items() for p, n in f.items()}
    totals = {(lang, ""): sum(n for p, n in f.items() if " " not in p) for lang, f in plain_counts(rows).items()}
    assert got == want | {k: n for k, n in totals.items() if n}


def test_scores_are_exact(spark):
    a, left, right = 999_999_999_989, 1_000_000_000_039, 1_000_000_000_061
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (1, 10**12, 10**12)], "a long, l long, r long")
    got = [r[0] for r in df.select(C._score(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * x * x // (y * z) for x, y, z in [(a, left, right), (10, 10, 10), (1, 10**12, 10**12)]]
    assert not isinstance(got[0], Decimal)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
