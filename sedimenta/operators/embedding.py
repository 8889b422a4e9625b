"""Embedding: chunk, embed, pool. The model is a function from texts to vectors; the default hashes words, so that everything runs offline."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedimenta.operators import retrieval as R

Model = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Model:
    """Signed word counts by checksum, at unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed


def embed_documents(docs: DataFrame, id_: str, text: str, model: Model | None = None, size: int = 24_370, overlap: int = 2_000) -> DataFrame:
    """(id, embedding): the mean of the chunks' vectors at unit length; a text of one chunk keeps its vector. Null texts are empty."""
    embed = model or hashed_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            cuts = [R.chunks(t, size, overlap) for t in texts]
            vectors = embed([t[a:z] for t, own in zip(texts, cuts, strict=True) for a, z in own]) if texts else np.zeros((0, 1))
            at, out = 0, []
            for own in cuts:
                v = vectors[at : at + len(own)].mean(axis=0)
                at += len(own)
                n = np.linalg.norm(v)
                out.append((v / n if n and len(own) > 1 else v).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return docs.selectExpr(f"cast(`{id_}` AS long) AS id", f"`{text}` AS text").mapInArrow(run, "id long, embedding array<float>")


def missing_embeddings(docs: DataFrame, vectors: DataFrame, id_: str, text: str, model: Model | None = None) -> DataFrame:
    """Vectors for the documents that have none."""
    todo = docs.withColumnRenamed(id_, "id").join(vectors.select("id"), "id", "left_anti")
    return embed_documents(todo, "id", text, model)
