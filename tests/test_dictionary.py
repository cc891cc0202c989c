import random

from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.text import expand_query
from docweave.operators.dictionary import expand_by_dictionary, with_terms

ENTRIES = "ord long, term string, value string"


def _synonyms(spark):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(C.SYNONYMS)], ENTRIES)


def test_ten_thousand_terms_equal_a_plain_search(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcde é漢", k=n))
    terms = [(i, word(rng.randint(2, 5)), f"v{i % 3}") for i in range(10_000)]
    texts = [(i, word(rng.randint(0, 60)).upper()) for i in range(60)] + [(100, None), (101, ""), (102, word(200_000))]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame(terms, ENTRIES)
    want = {i: sorted(e for e in set(terms) if t and e[1] in t.lower()) for i, t in texts}
    for block_bytes in (1 << 24, 100_000):  # one block, several blocks
        got = {r["id"]: [tuple(e) for e in r["terms"]] for r in with_terms(df, table, block_bytes=block_bytes).collect()}
        assert got == want


def test_null_and_empty_terms_ties_and_repeated_entries(spark):
    table = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (1, "ab", None), (2, "ab", "y"), (3, "", "z"), (4, None, "z"), (0, "b", "w"), (5, "AB", "never")], ENTRIES)
    df = spark.createDataFrame([("AbAB", "kept", 9), (None, "kept", 9)], "text string, term string, ord int")
    rows = with_terms(df, table).orderBy(F.col("text").isNull()).collect()
    assert [(e["ord"], e["term"], e["value"]) for e in rows[0]["terms"]] == [(0, "b", "w"), (1, "ab", None), (1, "ab", "x"), (2, "ab", "y")]
    assert rows[1]["terms"] == [] and rows[0]["term"] == "kept" and rows[0]["ord"] == 9
    assert [r["terms"] for r in with_terms(df, table.limit(0)).collect()] == [[], []]
    assert with_terms(df.limit(0), table).count() == 0


def test_expansion_equals_the_fixed_chain(spark):
    terms = [t for t, _ in C.SYNONYMS]
    texts = [(t,) for t in [*terms, " ".join(terms), "  Password \n MAIL  ", "", None, "nothing"]]
    df = spark.createDataFrame(texts, "text string")
    rows = expand_by_dictionary(df, _synonyms(spark)).select("expanded", expand_query("text").alias("chain")).collect()
    assert all(r["expanded"] == r["chain"] for r in rows)
