import math

from pyspark.sql import functions as F

from docweave.functions.vectors import cosine, dot, l2_normalize, with_hash_embedding


#: The first 20 bytes of each text's digest chain, written out: the embedding is these numbers, made unit length.
FIRST_BYTES = {
    '': 'd41d8cd98f00b204e9800998ecf8427e59adb24e',
    'hello': '5d41402abc4b2a76b9719d911017c59262109206',
    'héllo wörld ✓': 'aa0c8a307a4488bfe0cb56530da19bc377992b48',
}


def test_hash_embedding_of_known_texts(spark):
    df = spark.createDataFrame([(t,) for t in FIRST_BYTES], "t string")
    for dim in (20, 64, 3072):
        for r in with_hash_embedding(df, "t", "v", dim).collect():
            assert len(r.v) == dim and abs(sum(x * x for x in r.v) - 1.0) < 1e-9
            known = bytes.fromhex(FIRST_BYTES[r.t])
            scale = max(r.v[:20]) / max(known)
            assert all(abs(x - scale * b) < 1e-12 for x, b in zip(r.v, known))
            if dim == 20:
                assert abs(scale - 1 / math.sqrt(sum(b * b for b in known))) < 1e-12
            else:
                assert min(r.v) >= 0


def test_dot_truncates_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0])], "a array<double>, b array<double>")
    r = df.select(dot("a", "b").alias("d"), cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first()
    assert r.d == 14.0
    assert abs(r.c - 1 / math.sqrt(2)) < 1e-12


def test_l2_normalize_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r.n for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert got == [[0.0, 0.0], [0.6, 0.8]]
