"""Pluggable models behind batch functions; the defaults are deterministic and need no download."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in, vectors (rows) out.
Embedder = Callable[[list[str]], np.ndarray]
#: Question and passages in, scores out.
Reranker = Callable[[str, list[str]], list[float]]
#: Prompts in, answers out.
Generator = Callable[[list[str]], list[str]]


def hash_embedder(dimension: int = 384) -> Embedder:
    """Signed feature hashing of words, unit length; equal texts have equal vectors."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h & 0x10000 else -1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out

    return embed


def overlap_reranker(question: str, passages: list[str]) -> list[float]:
    """The part of the question's words that a passage has."""
    asked = set(question.lower().split())
    return [len(asked & set(p.lower().split())) / max(1, len(asked)) for p in passages]


def template_generator(prompts: list[str]) -> list[str]:
    """Says only what the prompt holds."""
    return [f"Based on the information given: {p.strip().splitlines()[-1] if p.strip() else ''}" for p in prompts]


def embed_column(text: Column, make: Callable[[], Embedder], batch: int = 32) -> Column:
    """Vectors of texts; the model is made once a worker. Blank and null texts give null (their rows stay with their keys)."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in batches:
            out: list = [None] * len(series)
            full = [i for i, t in enumerate(series) if isinstance(t, str) and t.strip()]
            for start in range(0, len(full), batch):
                part = full[start:start + batch]
                for i, vec in zip(part, model([series.iloc[i] for i in part]), strict=True):
                    out[i] = vec.astype("float32")
            yield pd.Series(out)

    return run(text)


def rerank_column(question: Column, passage: Column, model: Reranker = overlap_reranker) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([model(a or "", [b or ""])[0] for a, b in zip(q, p, strict=True)], dtype="float64")

    return run(question, passage)


def generate_column(prompt: Column, model: Generator = template_generator) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model([p or "" for p in prompts]))

    return run(prompt)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has no built-in for it."""
    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)

    return run(text)


def guarded_rewrite(query: Column, rewritten: Column, factor: int = 3, least: int = 0) -> Column:
    """The rewritten query, unless it is empty, shorter than ``least`` or over ``factor`` times as long as the original."""
    said = F.regexp_replace(F.coalesce(rewritten, F.lit("")), r"^\s+|\s+$", "")
    return F.when((said == "") | (F.char_length(said) < least) | (F.char_length(said) > factor * F.char_length(query)), query).otherwise(said)


def query_variations(query: Column, reply: Column, most: int) -> Column:
    """Distinct variations from a numbered reply, first spelling wins; the original comes first unless it is among them."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+[.):\-]\s*", ""), r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", ""), r"^\s+|\s+$", ""))
    good = F.filter(plain, lambda x: F.char_length(x) > 5)
    lower = F.transform(good, lambda x: F.lower(x))
    first = F.transform(F.filter(F.transform(good, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lower, F.lower(s["x"])) == s["i"] + 1), lambda s: s["x"])
    whole = F.when(F.array_contains(lower, F.lower(query)), first).otherwise(F.concat(F.array(query), first))
    return F.slice(whole, 1, most + 1)


def embedded(chunks: DataFrame, make: Callable[[], Embedder], *, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Chunks with vectors; rows without text are dropped together with their keys."""
    return chunks.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").withColumn(out, embed_column(F.col(text_col), make))
