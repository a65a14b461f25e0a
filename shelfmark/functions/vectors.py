"""Vector expressions, and passages as embedding input."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

PASSAGE_CHARS = 2000


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def normalize(vec: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm == 0, vec.cast("array<double>")).otherwise(
        F.transform(vec, lambda x: x.cast("double") / norm)
    )


def passage() -> Column:
    """Embedding input of a chunk: title, heading and content, the empty ones left out."""
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "heading", "content")]
    return F.substring(F.concat_ws("\n", *filled), 1, PASSAGE_CHARS)


@dataclass(frozen=True)
class ModelProfile:
    pooling: str = "mean"
    query_prefix: str = ""
    min_score: float | None = None
    batch: int | None = None


# What is known of embedding models, by a pattern of the model name.
QWEN3_PREFIX = (
    "Instruct: Given a question, retrieve passages from technical documents and notes that answer it\nQuery:"
)
MODEL_PROFILES = [
    ("qwen3-embedding-0\\.6b", ModelProfile("last_token", QWEN3_PREFIX, 0.43)),
    ("qwen3-embedding", ModelProfile("last_token", QWEN3_PREFIX)),
    ("granite-embedding-97m-multilingual-r2", ModelProfile("cls", "", 0.84, 1)),
    ("bge-m3", ModelProfile("cls", "", 0.51)),
]


def profile_for(model: str) -> ModelProfile:
    for pattern, profile in MODEL_PROFILES:
        if re.search(pattern, model, re.I):
            return profile
    return ModelProfile()


def model_key(provider: str, model: str, url: str = "") -> str:
    """Name of a vector space: vectors of different spaces are never compared."""
    return f"api:{url}|{model}" if provider == "api" else f"local:{model}#{profile_for(model).pooling}"
