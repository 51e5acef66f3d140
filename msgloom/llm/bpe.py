"""Operator 2: byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file. A text of over LONG characters is cut before it is
encoded, at places where the pattern cannot match across: in front of white space that
follows a character that is not white space. No alternative of the pattern goes on from
other characters to white space, none looks back, and the piece before the cut does not
end in white space, so the matches on both sides are those of the whole text. A piece
that has no such place (one huge word or gap) is split into the pattern's own matches,
each of which is encoded by itself.

Cases: null text counts as empty and gives no ids; null ids decode to empty bytes; row
order, repeated rows and extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = 1 << 16
PIECE = 1 << 14

_SAFE = regex.compile(r"(?<=\S)\s")
_MATCH = regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str = RANK_FILE) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Consecutive parts of the text that encode independently; about PIECE characters where that is possible."""
    start = 0
    while len(text) - start > LONG:
        cut = _SAFE.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def encode_text(text: str | None, enc: tiktoken.Encoding) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        if len(piece) <= LONG:
            ids += enc.encode_ordinary(piece)
        else:
            for match in _MATCH.finditer(piece):
                ids += enc.encode_ordinary(match.group())
    return ids


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` with the ids of each whole text as ``ids_col`` (array of int)."""

    def make():
        enc = encoding(rank_file)
        return lambda texts: [[np.array(encode_text(t, enc), np.int32) for t in texts]]

    return append_columns(df, [text_col], f"`{ids_col}` array<int>", make)


def decode(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` with the bytes that the ids stand for as ``bytes_col``; they need not be valid UTF-8 for any ids."""

    def make():
        enc = encoding(rank_file)
        return lambda rows: [[enc.decode_bytes(ids or []) for ids in rows]]

    return append_columns(df, [ids_col], f"`{bytes_col}` binary", make)


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", same_col: str = "decodes", rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` with the ids and whether they decode to the text's bytes again, in one Python pass."""

    def make():
        enc = encoding(rank_file)

        def step(texts):
            ids = [encode_text(t, enc) for t in texts]
            same = [enc.decode_bytes(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts, strict=True)]
            return [[np.array(i, np.int32) for i in ids], same]

        return step

    return append_columns(df, [text_col], f"`{ids_col}` array<int>, `{same_col}` boolean", make)


def encode_and_decode(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded", rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` with the ids of each whole text and the bytes that these ids stand for, in one Python pass."""

    def make():
        enc = encoding(rank_file)

        def step(texts):
            ids = [encode_text(t, enc) for t in texts]
            return [[np.array(i, np.int32) for i in ids], [enc.decode_bytes(i) for i in ids]]

        return step

    return append_columns(df, [text_col], f"`{ids_col}` array<int>, `{bytes_col}` binary", make)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the count of ids and digests of the ids and of the decoded bytes."""
    coded = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
