"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every task loads the rank file once per Python worker. Texts are cut at safe boundaries before they reach the
library: between a character that is not white space and the white space after it. No match of the pattern has white
space behind another character, so every match ends there and the pieces encode to what the whole text encodes to.
A run of white space is one match however long it is (its last character goes to the next match if something
follows); long runs would overflow the stack of the library's pattern engine and are merged directly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
# Characters given to the library at once, and the shortest run of white space that is merged directly.
PIECE_CHARS = 65_536
RUN_CHARS = 1_000

_RUN = regex.compile(r"\p{White_Space}{%d,}" % RUN_CHARS)
_CUT = regex.compile(r"(?<=[^\p{White_Space}])(?=\p{White_Space})")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of ``text`` as unsigned 32-bit integers, special tokens taken as ordinary text."""
    if len(text) <= RUN_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    ids, start = [], 0
    for run in _RUN.finditer(text):
        # The run's last character belongs to the next match unless the text ends here.
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text[start : run.start()])]
        ids.append(np.array(enc._encode_single_piece(text[run.start() : end]), dtype=np.uint32))
        start = end
    ids += [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text[start:])]
    return np.concatenate(ids)


def encode_whole(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=())


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    ``ranks`` is a rank file that every executor can read, by default the one of the tokenizer package. A null text
    counts as empty and has no ids; a null doc_id and repeated rows are passed on; other columns are left out. Long
    texts are cut for the pattern of the package only, whose matches are known to end there; with any other ``pattern``
    the library gets every text whole.
    """
    to_ids = encode_text if pattern == public_tokenizers.PATTERN else encode_whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks or public_tokenizers.path(RANKS), pattern)
        for batch in batches:
            ids = [to_ids(enc, text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with the raw bytes its ids stand for as ``decoded``; null ids give no bytes.

    The bytes of single ids need not be valid UTF-8, so nothing is turned into text here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks or public_tokenizers.path(RANKS), pattern)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"]
            )

    tokens = tokens.select("doc_id", "n_tokens", "ids")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of ids and digests of its ids and of what they decode to."""
    return decode(encode(docs)).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
