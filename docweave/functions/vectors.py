"""Vector Column functions: hash embedding, dot, cosine, L2 normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest_chain_hex(text, dim: int = C.HASH_DIM_DEFAULT) -> Column:
    """Hex of md5(text) || md5(md5(text)) || ... - enough digests for ``dim`` bytes.

    The chain runs on raw digest bytes (``md5(unhex(hex))``). The accumulator is
    an array of digests (each step appends one reference), joined once at the end.
    """
    n_digests = (dim + 15) // 16
    first = F.md5(_col(text))
    if n_digests == 1:
        return first
    chain = F.aggregate(
        F.sequence(F.lit(2), F.lit(n_digests)),
        F.array(first),
        lambda acc, _i: F.concat(acc, F.array(F.md5(F.unhex(F.element_at(acc, -1))))),
    )
    return F.array_join(chain, "")


def hash_embed_raw(text, dim: int = C.HASH_DIM_DEFAULT) -> Column:
    """Un-normalised F4 values: the first ``dim`` digest-chain bytes, each / 255.

    The chain is split into byte pairs once (``regexp_extract_all``) so no
    per-element lambda re-evaluates it.
    """
    pairs = F.regexp_extract_all(digest_chain_hex(text, dim), F.lit("([0-9a-f]{2})"), 1)
    return F.transform(F.slice(pairs, 1, dim), lambda p: F.conv(p, 16, 10).cast("double") / F.lit(255.0))


def l2_normalize(v) -> Column:
    """divide by the L2 norm; a zero norm leaves the vector unchanged.

    The norm is the ``aggregate`` accumulator, handed to the finish function,
    so it is computed once per vector.
    """
    v = _col(v)
    zero = F.lit(0.0).cast("double")
    return F.aggregate(
        v,
        zero,
        lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(F.sqrt(s), zero), F.lit(1.0))),
    )


def sum_squares(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))


def with_hash_embedding(df: DataFrame, text_col: str, out_col: str = "vector", dim: int = C.HASH_DIM_DEFAULT) -> DataFrame:
    """Add the F4 hash embedding of ``text_col`` (unit length) as ``out_col``."""
    raw = f"__{out_col}_raw"
    keep = [c for c in df.columns if c != out_col]
    staged = df.select(*keep, hash_embed_raw(F.col(text_col), dim).alias(raw))
    return staged.select(*keep, l2_normalize(raw).alias(out_col))


def dot(a, b) -> Column:
    """plain dot product, truncated to the shorter vector (missing terms add 0)."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, p: s + F.coalesce(p, F.lit(0.0)))


def cosine(a, b) -> Column:
    """true cosine similarity; null when either norm is zero."""
    den = F.sqrt(sum_squares(a)) * F.sqrt(sum_squares(b))
    return dot(a, b) / F.nullif(den, F.lit(0.0))
