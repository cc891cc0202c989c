"""Embedding providers (K1, K2).

``embed(df, text_col, out_col, provider)`` resolves the provider alias the way
the service does: explicit ``azure`` / ``fastembed`` requests fail loudly when
the backend is missing; the default ``sentence`` chain falls through to
fastembed and finally to the 64-dim hash embedding. ``hash`` / ``demo`` use the
hash embedding directly (JVM-only). A model backend is a factory registered
with ``register_model``; it runs in an iterator ``pandas_udf`` so each Python
worker loads the model once and encodes Arrow batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.vectors import with_hash_embedding

# fixed values: provider aliases
ALIASES = {
    "azure": "azure", "azure_openai": "azure",
    "fastembed": "fastembed", "fast": "fastembed", "fe": "fastembed",
    "sentence": "sentence", "sentence-transformers": "sentence", "sentence_transformers": "sentence", "st": "sentence", "": "sentence",
    "hash": "hash", "demo": "hash",
}

_MODELS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_model(kind: str, factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """Register a backend: ``factory()`` (called once per Python worker) returns ``encode(texts) -> (n, dim)``."""
    _MODELS[kind] = factory


def chain(provider: str | None) -> list[str]:
    """Backends to try in order, the hash embedding last; an explicit provider stands alone."""
    kind = ALIASES.get((provider or "").strip().lower(), "other")
    if kind in ("azure", "fastembed"):
        if kind not in _MODELS:
            raise RuntimeError(f"{kind} embeddings requested but not available")
        return [kind]
    wanted = {"sentence": ["sentence", "fastembed"], "other": ["fastembed"], "hash": []}[kind]
    return [*(k for k in wanted if k in _MODELS), "hash"]


def resolve(provider: str | None) -> str:
    """The backend that is tried first."""
    return chain(provider)[0]


def _model_udf(kinds: list[str], strict: bool):
    factories = [_MODELS[k] for k in kinds]

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models: dict[int, Callable] = {}
        for texts in batches:
            given = texts.fillna("").tolist()
            for i, factory in enumerate(factories):
                try:
                    if i not in models:
                        models[i] = factory()  # once per worker
                    yield pd.Series(list(np.asarray(models[i](given), dtype=np.float64)))
                    break
                except Exception:
                    if strict:
                        raise
                    logging.getLogger(__name__).exception("embedding backend %s failed on a batch", kinds[i])
            else:
                yield pd.Series([None] * len(given))

    return encode


def embed(df: DataFrame, text_col: str, out_col: str = "vector", provider: str | None = "hash",
          dim: int = C.HASH_DIM_DEFAULT) -> DataFrame:
    """Add ``out_col``. In the default chain a backend that fails on a batch hands it to
    the next one, at last to the hash embedding of ``dim`` places; explicit providers raise."""
    kinds = chain(provider)
    if kinds == ["hash"]:
        return with_hash_embedding(df, text_col, out_col, dim)
    models = [k for k in kinds if k != "hash"]
    made = df.withColumn(out_col, _model_udf(models, strict=kinds[-1] != "hash")(F.col(text_col)))
    if kinds[-1] != "hash":
        return made
    spare = with_hash_embedding(made.withColumnRenamed(out_col, "__made"), text_col, "__spare", dim)
    return spare.withColumn(out_col, F.coalesce("__made", "__spare")).drop("__made", "__spare")
