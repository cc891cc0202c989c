import random

from brute import jaccard_components, repeated_bytes
from tokenizers import Tokenizer

import corpus_pipeline as p
from docweave.llm.packing import SEQUENCE
from docweave.llm.quality import quality_report
from docweave.llm.secret_scan import redact


def docs(spark):
    rng = random.Random(11)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}rd" for i in range(3000)]
    shared = " ".join(rng.choices(words, k=60))
    texts = []
    for i in range(40):
        t = " ".join(rng.choice(["the", "of", rng.choice(words), rng.choice(words)]) for _ in range(150))
        if i % 5 == 1:
            t = texts[-1] + " end"
        if i % 7 == 3:
            t += "\n" + shared + "\n" + " ".join(rng.choices(words, k=20))
        if i % 9 == 4:
            t += " password=hunter2secret"
        texts.append(t)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(90, None, "en", "s", None), (91, "too short", "en", "s", 9), (92, "##$$%% " * 90, "en", "s", 630)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_plain_versions(spark, tmp_path):
    df = docs(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: r.text for r in df.collect()}
    assert [n for n, _ in p.STAGES] == ["quality rules", "n-gram jaccard join", "suffix-array dedup", "secret scan", "packing"]
    kept = {r.doc_id for r in quality_report(df).where("kept").collect()}
    want = {d: t for d, t in want.items() if d in kept}
    assert {90, 91, 92}.isdisjoint(want) and len(want) == 40
    near = jaccard_components([*want.items()], 5, 80)
    want = {d: t for d, t in want.items() if near[d][1] == d}
    assert 30 < len(want) < 40
    removed = repeated_bytes([*want.items()])
    assert any(r[1] for r in removed.values())
    stage = df
    for _, f in p.STAGES[:3]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == df.columns
    cut = {r.doc_id: r.text for r in stage.collect()}
    assert {d: len(t) for d, t in cut.items()} == {d: r[0] - r[1] for d, r in removed.items()}
    want = {d: redact(t) for d, t in cut.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in p.secret_scan(spark, stage, str(tmp_path)).collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()} and any("[REDACTED]" in t for t in want.values())
    library = Tokenizer.from_file(p.public_tokenizers.path("word_bpe_49k.json"))
    rows = p.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert 0 < r.offset + r.length <= SEQUENCE
    assert tokens == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_repeated_and_null_id_rows_stay_once(spark, tmp_path):
    rng = random.Random(12)
    text = {k: " ".join(f"{rng.randrange(10**6)}w" for _ in range(60)) for k in "abcdef"}
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (None, "c"), (3, "d"), (4, "d"), (None, "d"), (5, "e"), (5, "e"), (6, "e"), (None, "f")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(d, text[k], "en", f"s{i}", len(text[k])) for i, (d, k) in enumerate(rows)], schema)
    stage = p.ngram_jaccard_join(spark, df, str(tmp_path))
    want = sorted((d or 0, text[k]) for d, k in [(1, "a"), (2, "b"), (None, "c"), (3, "d"), (5, "e"), (None, "f")])
    assert stage.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in stage.collect()) == want
    cut = p.suffix_array_dedup(spark, stage, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in cut.collect()) == want
    assert [tuple(r) for r in p.one_row_each(df.where("source = 's0'")).collect()] == [(1, text["a"], "en", "s0", len(text["a"]))]


def test_empty_table(spark, tmp_path):
    docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
