"""Packing by binary lengths: every document falls into pieces of power-of-two length.

Sequences of one length form a bucket, no sequence crosses documents, and none needs
padding.  Dataset decomposition, as published for variable-length training.
"""

from __future__ import annotations

import array
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import map_rows

TOKENIZER_FILE = "word_bpe_49k.json"
MAX_LENGTH = 4096
END_ID = 2
#: Most words a worker remembers the ids of.
CACHE_WORDS = 600_000
#: Longer words are encoded each time; they hardly repeat.
CACHED_LENGTH = 64

# The tokenizer drops white space and never joins a letter to a mark, so words can be
# encoded one by one, and marks between a letter and white space on their own: behind these
# letters, that is, as some others end in a combining mark once they are in lower case.
_MARKS = re.compile(r"([!-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)[!-/:-@\[-`{-~]*)(?=\s|\Z)")
# Letters whose lower case and composition are beyond doubt: the quick path below.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER_FILE))


@lru_cache(maxsize=2)
def _whole_texts(path: str | None) -> re.Pattern:
    """What a text must not hold to be cut into words: added tokens, and white space of Python's alone.

    The library finds added tokens before it cuts anything, so such a text is its own.
    """
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join([*map(re.escape, added), "[\x1c-\x1f]"]), re.I)


@lru_cache(maxsize=2)
def _plain_words(path: str | None):
    """The same merges on bytes, for words of plain letters; None if the file isn't of that kind.

    The file's word end is a suffix of the last byte; here it is the byte 255, which no
    text holds, joined to the last byte before any other merge.  A merge by the rank of
    the joined bytes equals a merge by the file's pairs: bytes that end up in one token
    met no merge across their ends, so they were merged as if they stood alone.
    """
    import json

    import tiktoken

    file = json.loads(_tokenizer(path).to_str())
    model = file["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    vocab = model["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(other)}

    def raw(token: str) -> bytes:
        ended = token.endswith("</w>")
        return bytes(byte_of[c] for c in token.removesuffix("</w>")) + b"\xff" * ended

    name_of = {b: c for c, b in byte_of.items()}
    ranks = {bytes([b]): b for b in range(256)}
    ids = [vocab[name_of[b]] for b in range(256)]
    for b in range(255):
        ranks[bytes([b, 255])] = len(ids)
        ids.append(vocab[name_of[b] + "</w>"])
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        joined = raw(left) + raw(right)
        if joined not in ranks:
            ranks[joined] = len(ids)
            ids.append(vocab[left + right])
    made = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    coded = [i.to_bytes(4, "little") for i in ids]
    one = made._encode_single_piece

    def encode(word: str) -> bytes:
        return b"".join([coded[i] for i in one(word.lower().encode() + b"\xff")])

    return encode


_words: dict[str | None, dict[str, bytes]] = {}


def _by_library(words: list[str], path: str | None) -> list[bytes]:
    encode = _tokenizer(path).encode_batch_fast
    return [
        array.array("I", e.ids).tobytes() for e in encode(words, add_special_tokens=False)
    ]


def _learn(words: list[str], known: dict[str, bytes], path: str | None) -> None:
    plain, rest = _plain_words(path), []
    for w in words:
        if plain and _PLAIN.fullmatch(w):
            known[w] = plain(w)
        else:
            rest.append(w)
    for at in range(0, len(rest), 10_000):
        part = rest[at : at + 10_000]
        known.update(zip(part, _by_library(part, path), strict=True))


def encode_texts(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """Little-endian 32-bit ids of each whole text, with the end id; null counts as empty."""
    known, whole = _words.setdefault(path, {}), _whole_texts(path)
    end = END_ID.to_bytes(4, "little")
    out = []
    for text in texts:
        if not text:
            out.append(end)
            continue
        if whole.search(text):
            out.append(_by_library([text], path)[0] + end)
            continue
        words = _MARKS.sub(r" \1", text).split()
        try:
            out.append(b"".join(map(known.__getitem__, words)) + end)
        except KeyError:
            distinct = set(words)
            if len(known) > CACHE_WORDS:
                known.clear()
            missing = [w for w in distinct if w not in known]
            _learn([w for w in missing if len(w) <= CACHED_LENGTH], known, path)
            long = [w for w in missing if len(w) > CACHED_LENGTH]
            here = dict(zip(long, _by_library(long, path), strict=True)) if long else {}
            out.append(b"".join([here[w] if w in here else known[w] for w in words]) + end)
    return out


def binary_lengths(total: int, largest: int = MAX_LENGTH) -> list[int]:
    """``total`` as pieces of ``largest`` followed by falling powers of two."""
    pieces = [largest] * (total // largest)
    rest = total % largest
    return pieces + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, path: str | None = None, largest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and ids.

    One row per piece; a piece is a whole sequence of its bucket (its length), at
    offset 0.  ``sequence_id`` is unique and follows from a row's place in the input,
    so a task that runs again gives the same.  Null and empty texts are the end id
    alone, repeated rows are packed again, other columns are ignored.  ``with_ids``
    adds the ids themselves as an array.  ``largest`` is a power of two.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError("largest must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        import numpy as np

        def run(batch):
            out: dict[str, list] = {
                k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
            }
            coded = encode_texts(batch.column(1).to_pylist(), path)
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                start, total = 0, len(ids) // 4
                for length in binary_lengths(total, largest):
                    piece = ids[4 * start : 4 * (start + length)]
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(total)
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, "<i4"))
                    start += length
            return out

        return run

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = map_rows(docs.select("doc_id", "text"), schema + ", ids array<int>" * with_ids, make)
    pieces = pieces.withColumn("sequence_id", F.monotonically_increasing_id())
    return pieces.withColumn("offset", F.lit(0).cast("bigint")).withColumn(
        "bucket", F.col("length")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences into one folder per length, as a trainer draws its batches."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
