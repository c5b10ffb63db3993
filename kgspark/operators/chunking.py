"""Chunks of documents: packing of sentences, and splitting at drops of similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import chunk_id, doc_id
from kgspark.storage import spread


def rule_sentences(text: Column) -> Column:
    """Sentences by rule: what ends in . ! ? or at a line break."""
    return F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def pack(sentences: Column, size: int, overlap: int = 0) -> Column:
    """Sentences packed greedily into chunks of at most ``size`` characters, inside the JVM.

    Each sentence is followed by a space and chunks are stripped; a sentence longer than
    ``size`` stays whole. With ``overlap`` a chunk begins with that many last
    characters of the one before.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) <= size
        closed = (acc["cur"] != "") & ~fits
        tail = F.concat(F.substring(F.trim(acc["cur"]), -overlap, overlap), F.lit(" ")) if overlap else F.lit("")
        head = F.when(closed, tail).otherwise(acc["cur"])
        return F.struct(
            F.when(closed, F.array_append(acc["done"], F.trim(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.concat(head, s, F.lit(" ")).alias("cur"),
        )

    return F.aggregate(sentences, start, step, lambda acc: F.filter(F.array_append(acc["done"], F.trim(acc["cur"])), lambda c: c != ""))


def simple_chunks(documents: DataFrame, size: int, overlap: int = 0, sentences: Callable[[Column], Column] = rule_sentences) -> DataFrame:
    """``(id, content, chunk_order_idx, doc_id, num_tokens)`` of ``documents(text)``; empty texts give none. No shuffle, no Python."""
    packed = spread(documents.select("text")).select(doc_id(F.col("text")).alias("doc_id"), F.posexplode_outer(pack(sentences(F.col("text")), size, overlap)).alias("chunk_order_idx", "content")).where("content IS NOT NULL")  # outer: no inferred filter packs again
    return packed.select(chunk_id(F.col("content")).alias("id"), "content", "chunk_order_idx", "doc_id", F.size(F.split("content", r"\s+")).alias("num_tokens"))


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic embedding without a model: signed word counts in hashed places."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h & 1024 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def semantic_split(sentences: list[str], most_tokens: int, embed: Callable[[list[str]], np.ndarray]) -> list[str]:
    """Sentences split where neighbours are least alike until each part has at most ``most_tokens`` words."""
    if not sentences:
        return []
    v = embed(sentences)
    alike = (v[:-1] * v[1:]).sum(axis=1)
    out, work = [], [(0, len(sentences))]
    while work:
        a, b = work.pop()
        if b - a == 1 or sum(len(s.split()) for s in sentences[a:b]) <= most_tokens:
            out.append((a, " ".join(sentences[a:b])))
            continue
        cut = a + 1 + int(np.argmin(alike[a : b - 1]))
        work += [(a, cut), (cut, b)]
    return [t for _, t in sorted(out)]


def semantic_chunks(documents: DataFrame, most_tokens: int, embed: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """Like simple_chunks, splitting at the lowest similarity of neighbouring sentences. One document is one unit of work."""

    @F.pandas_udf("array<string>")
    def split(parts: pd.Series) -> pd.Series:
        return parts.map(lambda s: semantic_split(list(s) if s is not None else [], most_tokens, embed))

    packed = spread(documents.select("text")).select(doc_id(F.col("text")).alias("doc_id"), F.posexplode_outer(split(rule_sentences(F.col("text")))).alias("chunk_order_idx", "content")).where("content IS NOT NULL")
    return packed.select(chunk_id(F.col("content")).alias("id"), "content", "chunk_order_idx", "doc_id", F.size(F.split("content", r"\s+")).alias("num_tokens"))
