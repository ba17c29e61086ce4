"""Byte-level BPE with a rank file: encoding of whole texts, decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from reelgauge.llm.common import map_rows

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Characters handed to the encoder at once; longer texts are cut at safe boundaries.
CHUNK = 65_536

# A letter followed by a plain space, line end or sentence mark always ends a match of the
# pattern: no branch holds both, and no branch looks back.  Cutting there changes nothing.
_SAFE = re.compile("[A-Za-zぁ-ヿ一-鿿](?=[ \n.,;:!?、。])")
# White space this long is one or two matches; backtracking over it would exhaust the stack.
_LONG_SPACE = re.compile(r"[ \n\t\r]{10000,}")


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """The encoder of a rank file, built once per worker."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANK_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(
        "rank_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def split_safely(text: str, size: int = CHUNK) -> list[str]:
    """Cut a text into pieces of about ``size`` whose ids concatenate to the text's ids."""
    pieces, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        pieces.append(text[start : found.end()])
        start = found.end()
    pieces.append(text[start:])
    return pieces


def _encode_piece(enc, text: str) -> list[int]:
    long = _LONG_SPACE.search(text) if len(text) >= 10_000 else None
    if not long:
        return enc.encode_ordinary(text)
    # the run goes before the last white space, if anything but white space follows
    begin, end = long.span()
    while begin and text[begin - 1].isspace():
        begin -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    stop = end if end == len(text) else end - 1
    run = enc._encode_single_piece(text[begin:stop].encode())
    head = enc.encode_ordinary(text[:begin]) if begin else []
    return head + list(run) + (_encode_piece(enc, text[stop:]) if stop < len(text) else [])


def encode(text: str | None, path: str | None = None) -> list[int]:
    """Ids of a whole text; null counts as empty."""
    enc = encoder(path)
    if not text:
        return []
    if len(text) <= CHUNK:
        return _encode_piece(enc, text)
    return [i for piece in split_safely(text) for i in _encode_piece(enc, piece)]


def decode(ids: list[int], path: str | None = None) -> bytes:
    """The bytes behind ids; they need not be valid text when the ids were cut."""
    return encoder(path).decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, ids: the ids of every whole text, in place, no row moves.

    Null and empty texts give an empty list, repeated rows repeated results; other
    columns are ignored.  Equal texts of a batch are encoded once.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def make():
        def run(batch):
            seen: dict = {}
            ids = []
            for t in batch.column(1).to_pylist():
                if t not in seen:
                    seen[t] = encode(t, path)
                ids.append(seen[t])
            return {keep: batch.column(0), "ids": ids}

        return run

    return map_rows(docs.select(keep, text), f"`{keep}` {kind}, ids array<int>", make)


def decode_ids(frame: DataFrame, path: str | None = None, keep: str = "doc_id") -> DataFrame:
    """``keep``, bytes: the raw bytes behind each row's ``ids`` (null ids: empty)."""
    kind = frame.schema[keep].dataType.simpleString()

    def make():
        def run(batch):
            return {
                keep: batch.column(0),
                "bytes": [decode(x or [], path) for x in batch.column(1).to_pylist()],
            }

        return run

    return map_rows(frame.select(keep, "ids"), f"`{keep}` {kind}, bytes binary", make)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    One pass encodes, decodes and digests, so that ids never leave the worker.
    Null and empty texts have no ids and the digest of nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        enc = encoder(path)
        names = [str(i) for i in range(enc.n_vocab)]

        def digests(text):
            ids = encode(text, path)
            joined = ",".join([names[i] for i in ids]).encode()
            return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()

        def run(batch):
            seen: dict = {}
            rows = []
            for t in batch.column(1).to_pylist():
                if t not in seen:
                    seen[t] = digests(t)
                rows.append(seen[t])
            return {
                "doc_id": batch.column(0),
                "n_tokens": [r[0] for r in rows],
                "ids_sha256": [r[1] for r in rows],
                "decoded_sha256": [r[2] for r in rows],
            }

        return run

    return map_rows(
        docs.select("doc_id", "text"),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        make,
    )
