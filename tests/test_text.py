from pyspark.sql import functions as F

from conftest import one
from docweave import config as C
from docweave.functions import text as T


def ev(spark, fn, v):
    return one(spark, fn(F.col("t")), v)


def test_normalize_ws(spark):
    assert ev(spark, T.normalize_ws, "  a \t\n b c\x1fd  ") == "a b c d"
    assert ev(spark, T.normalize_ws, " \n ") == ""


def test_split_sentences(spark):
    assert ev(spark, lambda c: T.split_sentences(T.normalize_ws(c)), "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert ev(spark, lambda c: T.split_sentences(T.normalize_ws(c)), "a. . b") == ["a.", ".", "b"]
    assert ev(spark, lambda c: T.split_sentences(T.normalize_ws(c)), "   ") == []


def test_file_type(spark):
    assert ev(spark, T.file_type, "a.pdf") == "PDF"
    assert ev(spark, T.file_type, "a.b.TXT") == "TXT"
    assert ev(spark, T.file_type, "noext") == "TXT"
    assert ev(spark, lambda c: T.file_type(c, "FILE"), "noext") == "FILE"


def test_snippet(spark):
    for n, want in [(399, 399), (400, 400), (401, 403)]:
        assert len(ev(spark, T.snippet, "x" * n)) == want
    assert ev(spark, T.snippet, "x" * 401).endswith("...")


def test_title(spark):
    assert ev(spark, T.title_of, "my_file.pdf") == "my file"
    assert ev(spark, T.title_of, "x.docx_v2.pdf") == "x v2"
    assert ev(spark, T.title_of, "A.PDF") == "A.PDF"
    assert ev(spark, T.title_of, None) == "Document"


def test_title_prefix(spark):
    df = spark.createDataFrame([("Guide", "The guide says hi"), ("Guide", "nothing here"), ("", "body")], "ti string, tx string")
    got = [r[0] for r in df.select(T.title_prefixed(F.col("ti"), F.col("tx"))).collect()]
    assert got == ["The guide says hi", "**Guide**\n\nnothing here", "body"]


def test_expand_query(spark):
    got = ev(spark, T.expand_query, "  reset   my password ")
    assert got == "reset my password Microsoft Word password change reset update reset restart reboot"
    assert ev(spark, T.expand_query, "my email") == "my email email outlook"
    assert ev(spark, T.expand_query, "hello there") == "hello there"


def test_classify_domain(spark):
    cases = {"": ("unknown", False), "  ": ("unknown", False), "2+2": ("math", False), "2024-01-02": ("math", False),
             "my notebook": ("non_it", False), "password help": ("it", True), "weather": ("unknown", True),
             "what is 5 percentage of 20": ("math", False)}
    for q, (d, it) in cases.items():
        r = ev(spark, T.classify_domain, q)
        assert (r["domain"], r["is_it"]) == (d, it), q


def test_validate_query(spark):
    assert ev(spark, T.validate_query, " ")["message"] == C.EMPTY_QUERY_MESSAGE
    assert ev(spark, T.validate_query, "a" * 2000)["is_valid"] is True
    assert ev(spark, T.validate_query, "a" * 2001)["message"] == C.LONG_QUERY_MESSAGE
    assert ev(spark, T.validate_query, "best cooking recipe")["message"] == C.NON_IT_MESSAGE
