"""Byte-level BPE encoding and decoding (operator 3).

The vocabulary is a file of byte ranks.  The tokenizers library writes every byte
as one printable character (the byte table), so its tokens are strings of table
characters; encoding runs over Arrow batches and decoding reverses the table.
Token boundaries can fall inside a character, so bytes are joined over the whole
document before they are read as UTF-8.

Nulls and empty texts have no tokens.  Repeated rows and ids are encoded each on
its own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents, gather, keyed_text, slices


def token_bytes(path: str) -> list[bytes]:
    """Id -> bytes of the token."""
    ranks = bpe.read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


def character_offsets(texts: pa.Array, ids: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token in its text.

    A token that starts or ends inside a character counts that character in full, as the library does."""
    texts = pc.fill_null(texts, "")
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    starts_char = (data & 0xC0) != 0x80
    char = np.cumsum(starts_char) - 1  # character that each byte belongs to
    ends = np.cumsum(sizes[ids])
    begins = ends - sizes[ids]
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    base = (np.cumsum(lengths) - lengths)[rows]
    return (char[begins] - base, char[ends - 1] + 1 - base) if len(ids) else (begins, ends)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with offsets also starts and ends (characters) of every token."""
    src = keyed_text(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if with_offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, pattern=pattern)
        sizes = np.array([len(t) for t in token_bytes(path)], np.int64) if with_offsets else None
        for b in slices(batches):
            ids, offsets = enc.encode(b.column("text"))
            lists = [ids]
            if with_offsets:
                lists += character_offsets(b.column("text"), ids, offsets, sizes)
            arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "ids", "starts", "ends"][:1 + len(arrays)])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data binary (the exact bytes), text (those bytes as UTF-8, broken sequences replaced)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            data = [b"".join([table[i] for i in ids or ()]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())],
                ["doc_id", "data", "text"])

    return src.mapInArrow(run, f"doc_id {kind}, data binary, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests only (ids of a large corpus need not leave the task)."""
    src = keyed_text(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, pattern=pattern)
        table = token_bytes(path)
        flat = np.frombuffer(b"".join(table), np.uint8)
        sizes = np.array([len(t) for t in table], np.int64)
        starts = np.cumsum(sizes) - sizes
        shown = [str(i) for i in range(len(table))]
        for b in slices(batches):
            ids, offsets = enc.encode(b.column("text"))
            data = flat[gather(starts[ids], sizes[ids])].tobytes() if len(ids) else b""
            at = np.concatenate([[0], np.cumsum(sizes[ids])])[offsets].tolist()
            words = [shown[i] for i in ids.tolist()]
            o = offsets.tolist()
            sha = [hashlib.sha256(" ".join(words[o[i]:o[i + 1]]).encode()).hexdigest() for i in range(b.num_rows)]
            back = [hashlib.sha256(data[at[i]:at[i + 1]]).hexdigest() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab
    return digests(documents(spark, sf_dir), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
