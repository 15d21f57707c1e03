"""Encoding a corpus with a public byte-level BPE.

The vocabulary is a local rank file (a parameter; never copied). Each Python worker loads it once. Long texts are cut at safe
boundaries - places where the pre-splitting pattern always cuts - so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANKS = "byte_bpe_50k.tiktoken"
LONG = 20_000  # characters from which a text is cut into pieces before encoding
_loaded: dict[tuple[str, str], object] = {}


def vocabulary_path(name: str = RANKS, folder: str | None = None) -> str:
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


#: Fixed value: the pre-splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a rank file, once per process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cuts where a non-space is followed by a space or newline: the pattern always ends a piece there, and what is left of the cut
    ends in a non-space, so no look-ahead crosses it. A run without such a place stays whole."""
    i, n = 0, len(text)
    while n - i > size:
        j = i + size
        while j < n and not (text[j] in " \n" and not text[j - 1].isspace()):
            j += 1
        if j >= n:
            break
        yield text[i:j]
        i = j
    yield text[i:]


def encode(text: str | None, enc) -> list[int]:
    """ids of one text; null and '' have no tokens and give []."""
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [t for piece in safe_pieces(text) for t in enc.encode_ordinary(piece)]


def decode(ids: list[int], enc) -> str:
    """Back to text through raw bytes, as a token can end within a character."""
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encode_column(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The kept columns of df plus ids array<int>. Every row comes out once; null and '' give an empty list; white space,
    repeated rows and very long texts are encoded whole. Only keep and text are read from df; no shuffle."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids)]
    path = path or vocabulary_path()
    columns = df.select(*keep, df[text].cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1]), f"`{ids}` array<int>"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for b in it:
            rows = [np.asarray(encode(t, enc), dtype=np.int32) for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], ids])

    return columns.mapInArrow(batches, schema)
