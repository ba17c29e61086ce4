"""Alignment of the ids that two tokenizers give to the same text.

The ends of the tokens, in bytes, are keys of a dictionary from end to index.  The ends
that both have are the intersection of the keys; in order, they slice both id lists into
groups.  Two tokens are linked when their bytes overlap: between any two
neighbouring ends, of whichever side, one token of each side lies, so each end of a
slice gives one link.  Texts of a slice of rows lie one behind the other in one stream
of bytes, as a text's end is an end on both sides.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.common import Tables, small_batches, text_slices
from reelgauge.operators.scaling import lookup_join, materialise

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of the texts that are aligned at once; characters of a piece of a longer text.
SLICE_BYTES, PIECE_CHARS = 100_000, 50_000
#: Id pairs that may travel to all tasks, beside the limit in bytes.
COUNT_ROWS = 2_000_000

# Before a space behind one of these, both end a token: no branch of A's pattern holds a
# space behind a visible character, and no piece of B holds a space inside.
_CUT = re.compile("(?<=[!-~À-ɏ])(?= )")
# Characters whose classes are the same to all libraries.
_UNPLAIN = re.compile("[^\t\n\r -~¡-ɏ]")


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; built once per worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(shown))
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [self._entry(entries.get(i, ""), byte) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [self._piece(p) for p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        names = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.inner, self.last_a, self.last_b = (np.array([n + mark for n in names], object) for mark in ",|;")
        self.quick = self._quick(path_a)

    @staticmethod
    def _entry(entry: str, byte: dict[str, int]) -> bytes:
        return bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _quick(self, path: str):
        """An encoder of plain texts that gives A's ids sooner; None if A's file isn't of its kind.

        Ids must be the ranks of the merges, behind the 256 bytes, and the pattern the usual one.
        """
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        ranked = all(vocab.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        bytes_first = sorted(len(x) for x in self.bytes_a[:256]) == [1] * 256
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        if not (ranked and bytes_first and plain and model.get("type", "BPE") == "BPE"):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the quick encoder is there and knows all characters of a text."""
        return self.quick is not None and not _UNPLAIN.search(text)

    def ids_a(self, text: str, plain: bool) -> np.ndarray:
        """Ids of space + text by A."""
        if plain:
            return self.quick.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Texts whose ids, one after the other, are those of the whole; B adds the space that is left out."""
        out, start = [], 0
        while self.cuts and len(text) - start > PIECE_CHARS:
            found = _CUT.search(text, start + PIECE_CHARS)
            if not found or found.end() + 1 > len(text):
                break
            out.append(text[start : found.end()])
            start = found.end() + 1
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each whole text by A and by B; none where the joined bytes of one differ from space + text."""
        cut = [self.pieces(t) for t in texts]
        by_b = iter(self.b.encode([p for pieces in cut for p in pieces], num_threads=1))
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            plain, data = self.plain(text), (" " + text).encode()
            a = self.ids_a(text, plain) if len(pieces) == 1 else np.concatenate([self.ids_a(p, plain) for p in pieces])
            b = next(by_b) if len(pieces) == 1 else [i for _ in pieces for i in next(by_b)]
            # the quick encoder loses no byte, so their number tells
            same = text and (self.size_a[a].sum() == len(data) if plain else b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data)
            same = same and b"".join(map(self.bytes_b.__getitem__, b)) == data
            out.append((a, np.array(b, np.int64)) if same else (_NONE, _NONE))
        return out


_NONE = np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def tokenizers(path_a: str | None = None, path_b: str | None = None) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    return Tokenizers(path_a or public_tokenizers.path(FILE_A), path_b or public_tokenizers.path(FILE_B))


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before the end of each group; both sides end alike.

    B's ends are the keys of a dictionary; A's ends, already in order, are looked up there.
    """
    at_b = dict(zip(ends_b, count(1)))
    upto_b = np.array(list(map(at_b.get, ends_a, repeat(0))), np.int64)
    common = np.flatnonzero(upto_b)
    return common + 1, upto_b[common]


class Aligned:
    """The alignment of several texts: per text the counts, the groups as text, the linked id pairs."""

    def __init__(self, tok: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]):
        a, b = (np.concatenate([x[side] for x in ids]) if ids else _NONE for side in (0, 1))
        edge_a, edge_b = (np.cumsum([0, *(len(x[side]) for x in ids)]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
        upto_a, upto_b = slices(ends_a.tolist(), ends_b.tolist())
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        # the ids in the order of the text of the groups: a group's A ids, then its B ids
        out = np.empty(len(a) + len(b), object)
        place_a = np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(upto_a, size_b)
        out[place_a], out[place_b] = tok.inner[a], tok.inner[b]
        out[place_a[upto_a - 1]], out[place_b[upto_b - 1]] = tok.last_a[a[upto_a - 1]], tok.last_b[b[upto_b - 1]]
        out = out.tolist()
        # each end closes one link, with the token of the other side that lies there
        inner = np.ones(len(b), bool)
        inner[upto_b - 1] = False
        inner = np.flatnonzero(inner)
        of_a = a << 32 | b[np.searchsorted(ends_b, ends_a)]
        of_b = a[np.searchsorted(ends_a, ends_b[inner])] << 32 | b[inner]
        edge_inner = np.searchsorted(inner, edge_b)
        self.n_a, self.n_b = np.diff(edge_a), np.diff(edge_b)
        self.n_links = self.n_a + np.diff(edge_inner)
        self.n_groups = self.n_a + self.n_b - self.n_links
        at_a, at_b, at = edge_a.tolist(), edge_inner.tolist(), (edge_a + edge_b).tolist()
        self.groups, self.pairs, self.times = [], [], []
        for i in range(len(ids)):
            self.groups.append("".join(out[at[i] : at[i + 1]])[:-1])
            pairs, times = np.unique(np.concatenate((of_a[at_a[i] : at_a[i + 1]], of_b[at_b[i] : at_b[i + 1]])), return_counts=True)
            self.pairs.append(pairs)
            self.times.append(times)


def align(texts: list[str | None], path_a: str | None = None, path_b: str | None = None) -> Aligned:
    """Align whole texts; a text that is null, empty or not given back by both has no tokens."""
    tok = tokenizers(path_a, path_b)
    return Aligned(tok, tok.encode([t or "" for t in texts]))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, groups, pairs, times of every whole text, in place.

    ``groups`` has the ids of both tokenizers as ``a1,a2|b1;a3|b2,b3``.  ``pairs`` are the
    distinct linked id pairs as ``a << 32 | b``, ascending, and ``times`` how often each is
    linked in the text.  A text that is null or empty, or which one of the tokenizers does
    not give back byte by byte, has no tokens.  Repeated rows give repeated results; other
    columns are ignored.  A task holds one slice of texts at a time.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                x = align(part.column(1).to_pylist(), path_a, path_b)
                edge = np.cumsum([0, *map(len, x.pairs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *(pa.array(n, pa.int64()) for n in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.groups, pa.string()),
                    pa.ListArray.from_arrays(edge, np.concatenate(x.pairs)), pa.ListArray.from_arrays(edge, np.concatenate(x.times).astype(np.int32)),
                ], [keep, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    schema = f"`{keep}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"
    return docs.select(keep, text).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count, best: how many rows hold each id pair, and whether no pair of its A id is in more.

    Pairs are summed in the tasks before they move.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    most = counts.groupBy(_id_a().alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, _id_a() == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _id_a():
    return F.shiftright("pair", 32)


def align_corpus(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    The count of an id pair is the number of rows of ``docs`` that hold it linked, each
    repeated row counted; ``n_best`` are the links whose count is the highest of their A
    id, ``count_sum`` sums the counts of all links.  Both are 0 and the digest is empty
    where a text has no tokens.  The counts travel to all tasks if their size allows it;
    else rows and counts meet by a shuffle that hot pairs don't stop.
    """
    spark = docs.sparkSession
    with Tables(spark) as tables:
        digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
        plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        aligned = align_documents(docs, path_a, path_b).select(F.monotonically_increasing_id().alias("row"), *plain, digest, "pairs", "times")
        aligned = tables.keep(aligned, compression="zstd")
        counts = tables.keep(pair_counts(aligned))
        linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        met = lookup_join(linked, counts, ["pair"], "inner", max_rows=COUNT_ROWS)
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        sums = met.groupBy("row").agg(best.cast("long").alias("n_best"), F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum"))
        out = aligned.join(sums, "row", "left").select(*plain, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
        return materialise(out)
