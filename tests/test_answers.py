from pyspark.sql import functions as F

from conftest import one
from docweave import config as C
from docweave.functions import answers as A


def parse(spark, t):
    r = one(spark, A.parse_source_marker(F.col("t")), t)
    return r["text"], r["source"]


def test_source_marker(spark):
    assert parse(spark, "[SOURCE:0] Hello\nworld") == ("Hello\nworld", 0)
    assert parse(spark, "\n\n  [SOURCE:1]\nBody") == ("Body", 1)
    assert parse(spark, "**[SOURCE:0]** Answer") == ("Answer", 0)
    assert parse(spark, "Intro\n[SOURCE:1] later") == ("Intro\n[SOURCE:1] later", None)
    assert parse(spark, "[SOURCE:2] no") == ("[SOURCE:2] no", None)
    assert parse(spark, "[SOURCE:0]\n**bold** line") == ("**bold** line", 0)
    assert parse(spark, "") == ("", None)


def test_truncate_context(spark):
    assert one(spark, A.truncate_context(F.col("t")), "x" * 4000) == "x" * 4000
    assert one(spark, A.truncate_context(F.col("t")), "x" * 4001) == "x" * 4000 + C.TRUNCATION_SUFFIX
    assert "CONTEXT: [None]" in one(spark, A.system_prompt(F.col("t")), "")


def test_demo_answer(spark):
    r = one(spark, A.demo_answer(F.col("t")), "  ")
    assert (r["text"], r["source"]) == (C.NO_CONTEXT_ANSWER, None)
    r = one(spark, A.demo_answer(F.col("t")), "a\n\n\n\nb\n\nWindows c\n\nd")
    assert r["text"] == "[SOURCE:1]\na\n\nb\n\nWindows c" and r["source"] == 1
    body = one(spark, A.demo_answer(F.col("t")), "y" * 800)["text"]
    assert body == "[SOURCE:0]\n" + "y" * 800
    body = one(spark, A.demo_answer(F.col("t")), "y" * 796 + "   z" * 3)["text"]
    assert body == "[SOURCE:0]\n" + "y" * 796 + "..."


def test_classify_error(spark):
    df = spark.createDataFrame([("ContentFilter content_filter hit", 500), ("boom", 400), ("boom", 500)], "m string, s int")
    got = [r[0] for r in df.select(A.classify_error(F.col("m"), F.col("s"))).collect()]
    assert got == [C.CONTENT_FILTER_MARKER, C.CONTENT_FILTER_MARKER, C.GENERIC_FAILURE_ANSWER]


def test_generation_hook(spark):
    from docweave.operators.generation import generate
    from docweave.functions.answers import system_prompt

    sp = one(spark, system_prompt(F.col("t")), "Alpha block\n\nBeta block")
    prompts = spark.createDataFrame([(1, 0, "system", sp), (1, 1, "user", "question?")], "conv_id long, msg_index long, role string, content string")
    demo = generate(prompts).first().raw_response
    assert demo == "[SOURCE:0]\nAlpha block\n\nBeta block"
    echo = generate(prompts, lambda msgs: f"[SOURCE:1] {len(msgs)} messages, last: {msgs[-1]['content']}").first().raw_response
    assert echo == "[SOURCE:1] 2 messages, last: question?"
    assert parse(spark, echo) == ("2 messages, last: question?", 1)


def test_bounded_context_edges(spark):
    from docweave.operators.conversation import bounded_context

    def direct(blocks):
        ctx = "\n\n".join(blocks)
        return (ctx[:4000] + C.TRUNCATION_SUFFIX) if len(ctx) > 4000 else ctx

    cases = {
        1: [""] * 3000,                       # separators only: needs exactly max/2 + 1 blocks
        2: ["x"] * 3000,
        3: ["a" * 3999, "b"],                 # prefix ends one short of the cut
        4: ["a" * 3998, "b" * 10],
        5: ["a" * 1000, "b" * 1000],          # no truncation
        6: ["a" * 4000],
        7: ["a" * 4001],
    }
    rows = [(k, i, t) for k, bl in cases.items() for i, t in enumerate(bl)]
    df = spark.createDataFrame(rows, "k long, i long, t string")
    got = {r.k: r.context for r in bounded_context(df, "k", "i", "t").collect()}
    for k, bl in cases.items():
        assert got[k] == direct(bl), k


def test_marker_line_ends_and_wide_spaces(spark):
    from docweave.functions.answers import parse_source_marker

    for raw, want in {"[SOURCE:0]\r\nA\r\nB": ("A\nB", 0), "\u00a0[SOURCE:1]\u00a0x": ("x", 1), "A\r\nB": ("A\r\nB", None)}.items():
        r = one(spark, parse_source_marker(F.col("t")), raw)
        assert (r["text"], r["source"]) == want
