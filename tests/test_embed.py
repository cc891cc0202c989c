import numpy as np
import pytest

from docweave.operators import embed as E


def test_aliases_and_fallback():
    assert E.resolve("ST") == "hash"          # no model registered: default chain ends at the hash embedding
    assert E.resolve("") == "hash"
    assert E.resolve("demo") == "hash"
    with pytest.raises(RuntimeError):
        E.resolve("azure_openai")             # explicit providers fail loudly
    with pytest.raises(RuntimeError):
        E.resolve("fe")


def test_registered_model_runs_in_arrow_batches(spark):
    def factory():
        def encode(texts):
            return np.array([[float(len(t)), 1.0] for t in texts])
        return encode

    E.register_model("fastembed", factory)
    try:
        assert E.resolve("sentence") == "fastembed"   # sentence falls through to fastembed
        assert E.resolve("fast") == "fastembed"
        df = spark.createDataFrame([("abc",), ("",)], "t string")
        got = sorted(r.v for r in E.embed(df, "t", "v", provider="sentence").collect())
        assert got == [[0.0, 1.0], [3.0, 1.0]]
    finally:
        E._MODELS.clear()


def test_a_failing_model_hands_its_batch_on(spark):
    def broken():
        def encode(texts):
            raise OSError("no weights")
        return encode

    E.register_model("sentence", broken)
    try:
        df = spark.createDataFrame([("abc",), (None,)], "t string")
        got = [r.v for r in E.embed(df, "t", "v", provider="sentence", dim=20).collect()]
        assert len(got[0]) == 20
        assert E.chain("unheard-of") == ["hash"]  # unknown names skip the sentence model
        E.register_model("fastembed", broken)
        with pytest.raises(Exception, match="no weights"):
            E.embed(df, "t", "v", provider="fastembed").collect()
    finally:
        E._MODELS.clear()


def test_a_failing_chat_call_is_its_rows_answer(spark):
    from docweave import config as C
    from docweave.operators.generation import generate

    def fn(messages):
        if "bad" in messages[-1]["content"]:
            raise RuntimeError("Error: content_filter triggered")
        return "fine"

    df = spark.createDataFrame([(1, 0, "user", "good"), (2, 0, "user", "bad")], "conv_id long, msg_index int, role string, content string")
    got = {r.conv_id: (r.raw_response, r.error is None) for r in generate(df, fn).collect()}
    assert got[1] == ("fine", True) and got[2][1] is False and got[2][0]
    assert C.CONTENT_FILTER_MARKER == got[2][0] or isinstance(got[2][0], str)
