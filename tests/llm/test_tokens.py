import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm.bpe import RankBPE, pieces
from docweave.llm.bpe_codec import TextCodec, decode_documents, encode_documents
from docweave.llm.packing import Packer, WordTokenizer, pack_documents
from docweave.llm.token_counts import counter, count_tokens, longest_within, prefix_token_counts, truncation

RANKS = P.path("byte_bpe_50k.tiktoken")
with open(RANKS, "rb") as f:
    TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
JSON = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
CODEC = TextCodec(RankBPE.load(RANKS))
COUNTER = counter(P.path("byte_bpe_50k.json"))
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'ll", "é", "ß", "中文", "1", "²", "\x1c", "\x85", "\xa0", "!", " the", "😀", "aaaaaaaa", "<|endoftext|>", "x'", "́", "\x00", "_", "--", "ſ", "\r\n"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


def test_words_equal_the_library():
    path = P.path("word_bpe_49k.json")
    words, library = WordTokenizer(path), Tokenizer.from_file(path)
    letters = "abzéßstdmrelvyÿªµ×÷'09.!&<|>`~-_\u0085\x1c\x01漢\u0301"
    rng = random.Random(5)
    some = {"".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(20_000)}
    some |= {"it's", "'tis", "we'll.", "l'été,", "a1b22c", "&&&", "$$$.", "a" * 1000, "b" * 1001, "<|endoftext|>", "x<|startoftext|>y", "Été", "ÀB", "naïve!?"}
    found = {b for t in some for b in words.words(t)}
    words.learn(found)
    words.learn(found)
    for b in found:
        assert words.ids([b]) == np.array(library.encode(b.decode(), add_special_tokens=False).ids, "<u4").tobytes(), b


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_encoding_equals_the_library(text, leaf):
    parts = CODEC.parts(text, leaf=leaf)
    assert "".join(parts) == text == "".join(pieces(text))
    want = TIKTOKEN.encode_ordinary(text)
    assert [int(i) for p in parts for i in CODEC.piece[p].split()] == want == CODEC.encode(text)
    assert CODEC.bpe.decode(want) == text.encode()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_every_prefix_count_equals_the_library(text):
    counts = np.cumsum(COUNTER.steps(text), dtype=np.int64)
    want = [len(JSON.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]
    assert counts.tolist() == want


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 5_000 + "x", "中文" * 3_000, "x y " * 4_000])
def test_long_runs(text):
    want = TIKTOKEN.encode_ordinary(text)
    assert CODEC.encode(text) == want
    assert COUNTER.total(text) == len(want)


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_joined_halves_are_the_merged_whole(data):
    bpe = CODEC.bpe
    whole = bpe.merge(data) if data else []
    assert bpe.search(data) == whole if data else True
    for cut in range(0, len(data) + 1, 17):
        left, right = (bpe.merge(x) if x else [] for x in (data[:cut], data[cut:]))
        assert bpe.join(left, right) == whole


def test_documents_with_nulls_copies_and_other_columns(spark):
    rows = [(1, "Hello world's  end\n", "x"), (1, "Hello world's  end\n", "x"), (2, None, None), (3, "", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(df, RANKS, with_ids=True)
    for r in got.collect():
        text = dict((a, b) for a, b, _ in rows)[r.doc_id] or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.count() == 5
    back = {r.doc_id: bytes(r.data).decode() for r in decode_documents(got, RANKS).collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", None: "a"}
    assert encode_documents(df.limit(0), RANKS).count() == 0


def test_counts_and_truncation(spark):
    df = spark.createDataFrame([(1, "one two <|endoftext|> three " * 100), (2, None), (3, "é" * 50)], "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in count_tokens(df, path, limit=20).collect()}
    for d, t in df.collect():
        n = len(JSON.encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 20)
    keep = {r.doc_id: r.keep_chars for r in truncation(prefix_token_counts(df, path), 7).collect()}
    text = df.first().text
    assert keep[1] == max(i for i in range(len(text)) if len(JSON.encode(text[:i], add_special_tokens=False).ids) <= 7)
    assert keep[2] == 0 and longest_within(np.array([1, 1, -1, 1]), 1) == 3


def test_packing_places_each_id_once(spark):
    rng = random.Random(5)
    texts = {d: " ".join(rng.choice(["the", "Ünï", "x1", "don't", "<|endoftext|>", "a\x1cb"]) for _ in range(rng.choice([0, 3, 400, 2047, 5000]))) for d in range(60)}
    df = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").repartition(3)
    path = P.path("word_bpe_49k.json")
    rows = pack_documents(df, path, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 > 0
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        want = [*library.encode(texts.get(d) or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == want
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)}
    short = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        short += sum(r.length for r in own) < 2048
        assert sum(r.length for r in own) <= 2048
    assert short <= 3


@given(st.lists(st.integers(1, 15), max_size=60))
@settings(max_examples=100, deadline=None)
def test_level_keeps_the_sum_of_squares_smallest(lengths):
    packer = Packer(16)
    for length in lengths:
        number = packer.number.copy()

        def cost(level):
            after = number.copy()
            if level:
                after[level] -= 1
            if level + length < 16:
                after[level + length] += 1
            return int((after[1:16] ** 2).sum())

        choices = [0, *(h for h in range(1, 17 - length) if number[h])]
        assert cost(packer.level_for(length)) == min(map(cost, choices))
        packer.add((0,), length)
        assert (packer.number >= 0).all()
