import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm.bin_completion import best_fit, dominated, encoder, fillings, lower_bound, pack_by_completion, plan, ranges

VOCABULARY = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def fewest(items, size):
    """The least number of bins, by trying every place for every item."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                k = bins.index(room)
                place(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, size - items[i]])

    place(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 40).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=9))))
def test_as_few_as_an_exhaustive_search(case):
    size, items = case
    counts = Counter(items)
    chosen = plan(dict(counts), size)
    placed = Counter()
    for filling, n in chosen:
        assert sum(k * c for k, c in filling) <= size
        for k, c in filling:
            placed[k] += c * n
    assert placed == counts
    want = fewest(items, size)
    assert sum(n for _, n in chosen) == want
    assert lower_bound(np.array([counts.get(i, 0) for i in range(size + 1)]), size) <= want


def test_search_improves_on_best_fit():
    rng = random.Random(3)
    better = 0
    for _ in range(200):
        counts = Counter(rng.randint(5, 26) for _ in range(60))
        first, found = (sum(n for _, n in p) for p in (best_fit(dict(counts), 50), plan(dict(counts), 50)))
        assert found <= first
        better += found < first
    assert better > 0


def test_fillings_are_undominated_and_within_the_waste():
    counts = np.zeros(51, np.int64)
    counts[[3, 5, 8, 13, 21]] = [2, 1, 3, 1, 1]
    got = fillings(counts, 29, 4, 50)
    sums = [sum(k * c for k, c in f) for f in got]
    assert sums == sorted(sums, reverse=True) and sums[0] == 29 and min(sums) >= 25
    free = sum(1 << int(k) for k in np.flatnonzero(counts))
    assert dominated(((5, 1), (3, 1)), counts, 8, free)  # an 8 is better
    assert not dominated(((8, 1),), counts, 8, free)
    assert fillings(np.zeros(51, np.int64), 7, 7, 5) == [()] and fillings(np.zeros(51, np.int64), 7, 6, 5) == []


def test_a_node_limit_leaves_a_whole_packing():
    counts = {k: 3 + k % 4 for k in range(200, 900, 7)}
    for limit in (0, 1, 10):
        chosen = plan(counts, 2048, node_limit=limit)
        placed = Counter()
        for filling, n in chosen:
            for k, c in filling:
                placed[k] += c * n
        assert placed == counts
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_ranges_give_each_number_one_place():
    counts = {1: 40, 3: 7, 4: 5, 9: 6}
    r = ranges(plan(counts, 16))
    first, places = 0, set()
    for length, n in sorted(counts.items()):
        for number in range(first, first + n):
            at = np.searchsorted(r["low"], number, "right") - 1
            assert r["length"][at] == length
            inside = number - r["low"][at]
            start = r["offset"][at] + inside % r["copies"][at] * length
            cells = {(int(r["sequence"][at] + inside // r["copies"][at]), int(start + j)) for j in range(length)}
            assert not cells & places and max(c for _, c in cells) < 16
            places |= cells
        first += n
    assert len(places) == sum(k * n for k, n in counts.items())


def test_ids_equal_the_library():
    for text in ["", "It's  a <|endoftext|> test\n\n é中😀 ", " " * 5000 + "x", "<|endoftext|><|endoftext|>", "\x00\x1c\x85"]:
        assert encoder(VOCABULARY).ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_falls_back():
    text = "a<|endoftext|>" + " " * 400_000 + "x"
    ids = encoder(VOCABULARY).ids(text).tolist()
    assert LIBRARY.decode(ids, skip_special_tokens=False) == text and ids[1] == 50256


def test_documents(spark):
    rng = random.Random(5)
    texts = {d: " ".join(rng.choice(["the", "Ünï", "x1", "don't", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 400, 900, 5000]))) for d in range(60)}
    rows = [*((d, t, 1) for d, t in texts.items()), (99, None, None), (7, texts[7], 2), (None, "lost id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = pack_by_completion(df, VOCABULARY, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048
    for d, own in by_doc.items():
        want = [*LIBRARY.encode({**texts, None: "lost id"}.get(d) or "", add_special_tokens=False).ids, 0]
        copies = 2 if d == 7 else 1
        assert Counter((r.piece, r.start, r.length) for r in own) == Counter({k: copies for k in {(r.piece, r.start, r.length) for r in own}})
        own = sorted({(r.piece, r.start, r.length, bytes(r.ids)) for r in own})
        assert np.frombuffer(b"".join(r[3] for r in own), "<u4").tolist() == want
        assert [r[0] for r in own] == list(range(len(own))) and [r[1] for r in own] == np.cumsum([0, *(r[2] for r in own)])[:-1].tolist()
        assert all(r[2] == 2048 for r in own[1:]) and len(own) == -(-len(want) // 2048)
    counts = Counter(r.length for r in got)
    assert len(by_sequence) == sum(n for _, n in plan(dict(counts))) >= lower_bound(np.array([counts.get(i, 0) for i in range(2049)]), 2048)
    assert pack_by_completion(df.limit(0), VOCABULARY).count() == 0
