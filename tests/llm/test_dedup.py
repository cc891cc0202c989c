import random

import numpy as np
import pyarrow as pa
import pytest
from brute import jaccard_components, repeated_bytes, smallest_reachable, substring_dedup

from docweave.llm.common import slices
from docweave.llm.components import components
from docweave.llm import jaccard_join as J
from docweave.llm.jaccard_join import least_difference, near_duplicates, signature
from docweave.llm.substring_dedup import COVER, PERIOD, is_cover, remove_repeated_runs
from docweave.llm.suffix_dedup import Bytes, keep_unrepeated, remove_repeated_bytes
from docweave.llm.vector_dedup import collisions_needed, vector_links

WORDS = [f"w{i}" for i in range(4000)] + ["É", "ñandú", "中文", "A", "a"]


def corpus(seed, n=60, longest=220):
    """Random texts, copies, near copies, shared passages, repeats within a text, and odd cases."""
    rng = random.Random(seed)
    rows, texts = [], []
    passage = " ".join(rng.choices(WORDS, k=70))
    for d in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            t = rng.choice(texts)
        elif texts and kind < 0.45:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            t = " ".join(w)
        else:
            t = " ".join(rng.choices(WORDS, k=rng.randint(1, longest)))
            if kind > 0.75:
                t = f"{t}\n{passage}\t{' '.join(rng.choices(WORDS, k=rng.randint(0, 40)))}"
            if kind > 0.95:
                t += " " + t
        texts.append(t)
        rows.append((d * 7 % n, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "x " * 300), (n + 5, "x " * 300), (n + 6, "a" * 900)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, k1 string")


def test_the_cover_meets_every_difference():
    assert is_cover(COVER, PERIOD) and not is_cover((0, 1), 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_runs(frame(spark, rows)).collect()}
    assert got == substring_dedup(rows)
    small = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_runs(frame(spark, rows), window=9, period=7, cover=(1, 2, 4)).collect()}
    assert small == substring_dedup(rows, 9)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_by_suffixes_and_by_hashes(spark, seed):
    rows = corpus(seed)
    want = repeated_bytes(rows)
    for hot in (100_000, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(frame(spark, rows), hot=hot).collect()}
        assert got == want
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(frame(spark, rows), size=40, kmer=10).collect()}
    assert got == repeated_bytes(rows, 40)


def test_suffix_dedup_behind_16_mib(spark):
    letters = np.random.default_rng(7).integers(97, 123, (17 << 20) + 1000, np.uint8).tobytes().decode()
    long, passage, tail = letters[: 17 << 20], letters[17 << 20 :][:300], letters[17 << 20 :][300:350]
    rows = [(1, long + "É" + passage + tail), (2, "x" + passage), (3, letters[-500:])]
    for hot in (100_000, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated_bytes(frame(spark, rows), hot=hot).collect()}
        assert got == {1: ((17 << 20) + 352, 300, 1), 2: (301, 300, 1), 3: (500, 0, 0)}


def test_anchors_of_parts_are_those_of_the_whole():
    texts = [t.encode() for _, t in corpus(8) if t]
    want = [c.tolist() for c in Bytes(texts).anchors(200, 32)]
    for part in (50, 333, 4096):
        assert [c.tolist() for c in Bytes(texts).anchors(200, 32, part)] == want
    place = np.arange(0, 5000, 3)
    assert (Bytes(texts).hashes_at(place, 200, part=700) == Bytes(texts).hashes(200)[place]).all()


def test_slices_follow_the_running_sum_of_bytes():
    texts = ["a"] * 50 + ["b" * 90] * 5 + [None, "", "c" * 300] + ["é" * 10] * 9
    got = [b.column(0).to_pylist() for b in slices([pa.RecordBatch.from_pydict({"text": texts})], limit=100)]
    assert [t for b in got for t in b] == texts
    assert all(len(b) == 1 or sum(len((t or "").encode()) for t in b) <= 100 for b in got)
    assert list(slices([pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})])) == []


def test_texts_stay_whole_characters(spark):
    same = "ñ" * 150
    rows = [(1, "é" + same), (2, "è" + same + "x"), (3, None), (4, "clean")]
    out = keep_unrepeated(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "component_id", "k1"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "x", 3: None, 4: "clean"} or {r.doc_id: r.text for r in out.collect()}[2].endswith("x")


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_join(spark, seed):
    rows = corpus(seed)
    want = jaccard_components(rows)
    for long_list in (400, 2):  # all pairs of a list, or its smallest first and then the rest
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), long_list=long_list).collect()}
        assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), size=2, percent=50).collect()}
    assert got == jaccard_components(rows, 2, 50)


def test_signatures_bound_the_difference_of_sets_of_any_size():
    rng = np.random.default_rng(1)
    for n, shared in [(1, 0), (3, 2), (900, 700), (1100, 1000), (5000, 4000), (9000, 8900)]:
        for m in (n, n * 9 // 10, 5 * n):
            x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
            y[: min(shared, m)] = x[: min(shared, m)]
            y = np.unique(y)
            least = least_difference(*(np.frombuffer(signature(s), np.uint8) for s in (x, y)))
            assert least <= len(np.setxor1d(x, y))
    x, y = (np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64)) for _ in range(2))
    assert 185 * least_difference(*(np.frombuffer(signature(s), np.uint8) for s in (x, y))) > 15 * 12000  # long sets with nothing in common are told apart
    assert len(signature(x[:0])) == len(signature(x[:1024])) == 128 and len(signature(x[:1025])) == 256


def test_long_texts_that_cannot_link_are_not_compared_whole(spark, monkeypatch):
    same = [f"s{i}" for i in range(1500)]
    rows = [(d, " ".join([*same, *(f"d{d}x{i}" for i in range(4500))])) for d in range(6)]  # a quarter in common, of 6,000 shingles
    rows += [(d + 10, rows[d][1] + " tail") for d in range(2)]
    verified, compared = J._verified, []

    def counted(pairs, *args):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, *args)

    monkeypatch.setattr(J, "_verified", counted)
    monkeypatch.setattr(J, "_levels", lambda docs, size: np.zeros(1 << J.SKETCH_BITS, np.uint8))  # common shingles come first as often as others
    got = {r.doc_id: r.component_id for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 10 for d, _ in rows}
    assert sorted(map(tuple, map(sorted, compared))) == [(0, 10), (1, 11)]


def test_empty_tables_and_repeated_rows(spark):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert remove_repeated_runs(empty).count() == remove_repeated_bytes(empty).count() == near_duplicates(empty).count() == 0
    t = " ".join(WORDS[:60])
    rows = [(1, t), (1, t), (2, t), (None, t), (None, None)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_runs(frame(spark, rows)).collect()) == [(0, 0), (0, 60), (1, 0), (1, 0), (2, 60)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_bytes(frame(spark, rows)).collect()) == [(0, 0), (0, len(t)), (1, len(t)), (1, len(t)), (2, len(t))]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(frame(spark, rows)).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(50, 50), (3, 2), (2, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect()}
    assert got == smallest_reachable({x for e in links for x in e}, links)


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((12, 24))
    for i in range(260):
        v = base[rng.integers(12)] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(300, rows[0][1], rows[0][2]), (301, [2 * x for x in rows[0][1]], rows[0][2]), (302, None, 1), (303, [0.0] * 24, 1), (304, rows[0][1], None)]
    rows += [(305, [float("nan"), *rows[0][1][1:]], rows[0][2]), (306, [None, *rows[0][1][1:]], rows[0][2]), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (309, [], 1), (310, [float("inf"), 1.0], 1)]
    return rows


@pytest.mark.parametrize("blocks", [(1500, 6000), (7, 11)])
def test_vector_links(spark, blocks):
    rows = vectors(9)
    usable = [(i, np.array(v, float), la) for i, v, la in rows if v and la is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, v, la) in enumerate(usable):
        for j, u, lb in usable[n + 1 :]:
            if la == lb and len(u) == len(v) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.98:
                links.append((i, j))
    near = smallest_reachable([r[0] for r in rows], links)
    want = {i: (sum(i in e for e in links), near[i], near[i] == i) for i, _, _ in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(df, base_block=blocks[0], query_block=blocks[1]).collect()}
    assert got == want
    assert vector_links(df.limit(0)).count() == 0


def test_collisions_needed_follows_the_binomial():
    assert collisions_needed(10, 0.5, 1e-9) == 0 and collisions_needed(1, 0.999, 0.01) == 1
