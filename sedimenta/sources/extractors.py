"""Text out of binary files; libraries that aren't installed make their kind unavailable, not an error at import."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_CHARS, MARK = 200_000, "\n[text cut here]"


def pdf_text(content: bytes) -> str:
    from pypdf import PdfReader

    parts, n = [], 0
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            t = page.extract_text() or ""
        except Exception:  # noqa: BLE001  one broken page says nothing, the others do
            continue
        parts.append(t)
        n += len(t)
        if n >= MOST_CHARS:  # with the page that reaches it
            return "\n\n".join(parts) + MARK
    return "\n\n".join(parts)


def plain_text(content: bytes) -> str:
    t = content.decode("utf-8", "replace")
    return t if len(t) <= MOST_CHARS else t[:MOST_CHARS] + MARK


#: Functions by modality; callers add their own for images and audio.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "other": plain_text}


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files (path, modality, content) -> (path, text, error): text null and error set where a file can't be read."""
    known = extractors or EXTRACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    texts.append(known[kind](content or b""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a broken file is a result here
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "modality", "content").mapInArrow(run, "path string, text string, error string")
