"""Latent topics for every (period, entity) at once.

The usual route, one ``pyspark.ml`` LDA model per group, needs a driver loop over
channels and a vocabulary-by-topics matrix in the driver.  Here the documents of all
groups lie in blocks of bounded size, some blocks in a shard with the terms they use.
Terms that several shards have lie in buckets, those of one shard in a bucket of its own,
where terms that a document has alone, and as often, are one.  In every pass a shard gets
one array from each bucket, the weights of its terms there; its blocks are fitted to them
to the end, and it sends each bucket one array back, the expected counts, which the bucket
sums.  Only these arrays and the shards' numbers move, neither texts nor names, and no
group is ever in one place.
The variational bound of each group is summed along the way; a group whose bound no
longer rises leaves the passes.  Groups are fitted in a few batches, one after the other,
so that the arrays of a pass never lie on disk for all groups at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import text as X
from reelgauge.operators.engagement import group_sizes, topic_count, with_entities
from reelgauge.operators.ngrams import top_per_group, with_tokens
from reelgauge.operators.picks import argmax_per_group
from reelgauge.operators.scaling import Tables, fits, materialise, sized_join
from reelgauge.schemas import METRICS

GROUP = ["period", "entity"]
MAX_TOPICS = 5
#: Documents of a block, on average.
BLOCK_DOCS = 512
#: Blocks of a shard.  Terms move once a shard, and those of one shard only as that shard's numbers.
SHARD_BLOCKS = 4
#: Steps in which a block's documents are fitted at most, and the mean change that ends them.
STEPS, STEP_CHANGE = 40, 1e-3
#: Documents of a block, neighbours in length, that are fitted as one padded array.
ALIKE = 16
#: Batches that the groups are dealt to, about, and documents (once for each of their groups) that a batch has room for at least.
BATCHES, BATCH_DOCS = 6, 40_000
_P = [f"p{i}" for i in range(MAX_TOPICS)]
_T = [f"t{i}" for i in range(MAX_TOPICS)]
#: share of a document that its starting topic gets
_START = 0.9


@dataclass(frozen=True)
class TopicModel:
    """Result tables; ``topics`` counts from 0 in each (period, entity).

    ``documents``: group, videoId, k, p0..p4 (topic shares, sum 1, NULL from k on).
    ``terms``: group, term, topic, weight, place (from 1, among the terms that share a
    bucket: the n heaviest terms of a topic all have a place up to n).  ``bounds``: group, pass, bound of every pass
    that the group took part in.
    """

    documents: DataFrame
    terms: DataFrame
    bounds: DataFrame


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive values: the recurrence leads to x + 6, then the asymptotic series."""
    y = x + 6
    f = 1 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240))) - sum(1 / (x + i) for i in range(6))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive values, the same way."""
    y = x + 6
    f = 1 / (y * y)
    series = (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(x + i) for i in range(6))


# --- blocks of documents, shards of blocks and buckets of terms ---------------------------

_BLOCK = (
    "g bigint, block int, k int, ids array<string>, terms array<string>, buckets array<int>, begins array<int>, sizes array<int>, "
    "lengths binary, term binary, times binary, start binary"
)
#: Which terms of a block are in several shards.
_SEVERAL = "g bigint, shard int, block int, bucket int, several binary"
#: ``docs``: documents of each block.  ``own``: terms of this shard alone; ``many``: how many of them, one after the other, are one.
_SHARD = (
    "g bigint, shard int, k int, ids array<string>, terms array<string>, buckets array<int>, begins array<int>, sizes array<int>, "
    "own array<string>, many binary, docs binary, lengths binary, term binary, times binary, start binary"
)
#: What the passes need of a shard, and of a bucket.
_NUMBERS = ["g", "shard", "k", "buckets", "sizes", "many", "docs", "lengths", "term", "times"]
_PLACES = ["g", "bucket", "k", "n", "shards", "sizes", "place", "many"]
_BUCKET = "g bigint, bucket int, k int, n int, terms array<string>, shards binary, sizes binary, place binary, many binary"
#: Number of the bucket of shard 0's own terms; the other shards' follow.
_OWN = 1 << 30
#: From shards to buckets: expected counts, term by topic.  Bucket -1 gets the shards' parts of the bound.
_UP = "g bigint, shard int, bucket int, sums binary, bound double"
#: From buckets to shards: the same counts of the whole group, prior included.  Shard -1 gets a bucket's totals.
_DOWN = f"g bigint, shard int, bucket int, k int, sums binary, bound double, part double, n bigint, {', '.join(f'{p} double' for p in _P)}"
_SHARES = f"g bigint, videoId string, {', '.join(f'{p} double' for p in _P)}"
#: Terms that have all their weights alike, in order; ``places`` are those of the first one.
_WEIGHTS = "g bigint, terms array<string>, weights array<double>, places array<int>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _table(schema: str, rows: Sequence[dict] = ()) -> pa.Table:
    return pa.Table.from_pylist(list(rows), _arrow(schema))


def _bytes(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(rows: pa.Table) -> pa.Table:
    """One row for the documents of a block, shortest first: their ids, its terms by bucket, and who has which how often."""
    first = {c: rows.column(c)[0].as_py() for c in ("g", "block", "k", "buckets")}
    ids = rows.column("videoId").combine_chunks().dictionary_encode()
    tokens = rows.column("tokens").combine_chunks()
    words, owner = tokens.flatten(), pc.list_parent_indices(tokens)
    if words.null_count:
        words, owner = words.filter(words.is_valid()), owner.filter(words.is_valid())
    if not len(words):
        return _table(_BLOCK)
    coded = words.dictionary_encode()
    bucket = np.array([zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()]) % first["buckets"]
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc_of_row = ids.indices.to_numpy().astype(np.int64)
    pairs, times = np.unique(doc_of_row[owner.to_numpy()] * len(order) + place[coded.indices.to_numpy()], return_counts=True)
    used, lengths = np.unique(pairs // len(order), return_counts=True)
    by_length = np.argsort(lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[by_length]
    used, lengths = used[by_length], lengths[by_length]
    own = np.arange(len(pairs)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    pairs, times = pairs[own], times[own]
    start = np.zeros(len(ids.dictionary), np.int32)
    start[doc_of_row] = rows.column("start").to_numpy()
    buckets, sizes = np.unique(bucket, return_counts=True)
    lists = (buckets, np.cumsum(sizes) - sizes + 1, sizes)
    return pa.table(
        [
            pa.array([first["g"]]), pa.array([first["block"]]), pa.array([first["k"]]), _one(ids.dictionary.take(pa.array(used))),
            _one(coded.dictionary.take(pa.array(order))), *(_one(pa.array(v, pa.int32())) for v in lists),
            *(pa.array([_bytes(v, np.int32)]) for v in (lengths, pairs % len(order), times, start[used])),
        ],
        names=_arrow(_BLOCK).names,
    ).cast(_arrow(_BLOCK))


def _several(rows: pa.Table) -> pa.Table:
    """For the blocks' terms of a bucket, in the blocks' order, whether another shard has the term too."""
    terms = rows.column("terms").combine_chunks()
    codes, sizes = terms.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), pc.list_value_length(terms).to_numpy()
    shard = rows.column("shard").to_numpy()
    own = np.unique(codes * (int(shard.max()) + 1) + np.repeat(shard, sizes)) // (int(shard.max()) + 1)
    several = (np.bincount(own) > 1)[codes]
    parts = [_bytes(v, np.uint8) for v in np.split(several, np.cumsum(sizes)[:-1])]
    return rows.drop_columns(["terms"]).append_column("several", pa.array(parts, pa.binary())).select(_arrow(_SEVERAL).names).cast(_arrow(_SEVERAL))


def _merge(blocks: pa.Table, several: pa.Table) -> pa.Table:
    """The blocks of a shard as one row, by block and then shortest document first.

    A term that one document has alone gets the same counts as all others that this document
    has alone and as often, so they are one; ``times`` is their sum.
    """
    if not blocks.num_rows:
        return _table(_SHARD)
    blocks = blocks.sort_by("block")
    named, ids = blocks.column("terms").combine_chunks(), blocks.column("ids").combine_chunks()
    coded = named.flatten().dictionary_encode()
    codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    rows = blocks.drop_columns(["terms", "ids"]).to_pylist()
    bucket, own = np.empty(n, np.int64), np.ones(n, bool)
    bucket[codes] = np.concatenate([np.repeat(r["buckets"], r["sizes"]) for r in rows])
    if several.num_rows:
        order = [("block", "ascending"), ("bucket", "ascending")]
        own[codes[np.frombuffer(b"".join(several.sort_by(order).column("several").to_pylist()), bool)]] = False
    ends = np.cumsum(pc.list_value_length(named).to_numpy())
    lengths, begins, times, start = (np.concatenate([_ints(r, c)[0] for r in rows]) for c in ("lengths", "term", "times", "start"))
    entries = [len(r["term"]) // 4 for r in rows]
    term = codes[begins + np.repeat(ends - np.diff(ends, prepend=0), entries)]
    docs = np.array([len(r["start"]) // 4 for r in rows])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    alone = own & (np.bincount(term, minlength=n) == 1)
    single = np.flatnonzero(alone[term])
    _, one, kind, alike = np.unique(doc[single] * (int(times.max()) + 1) + times[single], return_index=True, return_inverse=True, return_counts=True)
    shared, rest = np.flatnonzero(~own), np.flatnonzero(own & ~alone)
    shared = shared[np.argsort(bucket[shared], kind="stable")]
    number = np.empty(n, np.int64)
    number[shared], number[rest] = np.arange(len(shared)), len(shared) + np.arange(len(rest))
    number[term[single]] = len(shared) + len(rest) + kind
    names = np.concatenate([rest, term[single][np.argsort(kind, kind="stable")]])
    many = np.concatenate([np.ones(len(rest), np.int64), alike])
    kept = ~alone[term]
    kept[single[one]] = True
    doc, term, times = doc[kept], number[term[kept]], times[kept]
    inside = term >= len(shared)
    times = times.astype(np.int64)
    times[inside] *= many[term[inside] - len(shared)]
    lengths = np.bincount(doc, minlength=len(lengths))
    by_length = np.lexsort((lengths, np.repeat(np.arange(len(docs)), docs)))
    rank = np.empty(len(by_length), np.int64)
    rank[by_length] = np.arange(len(by_length))
    order = np.lexsort((term, rank[doc]))
    buckets, sizes = np.unique(bucket[shared], return_counts=True)
    lists = (buckets, np.cumsum(sizes) - sizes + 1, sizes)
    numbers = (many, docs, lengths[by_length], term[order], times[order], start[by_length])
    return pa.table(
        [
            pa.array([rows[0]["g"]]), pa.array([rows[0]["shard"]]), pa.array([rows[0]["k"]]), _one(ids.flatten().take(pa.array(by_length))),
            _one(coded.dictionary.take(pa.array(shared))), *(_one(pa.array(v, pa.int32())) for v in lists),
            _one(coded.dictionary.take(pa.array(names))), *(pa.array([_bytes(v, np.int32)]) for v in numbers),
        ],
        names=_arrow(_SHARD).names,
    ).cast(_arrow(_SHARD))


def _gather(rows: pa.Table) -> pa.Table:
    """One row for a bucket: its terms in order, and which of them each shard has, in the shard's order."""
    rows = rows.sort_by("shard")
    terms = rows.column("terms").combine_chunks()
    coded = terms.flatten().dictionary_encode()
    first = {c: rows.column(c)[0].as_py() for c in ("g", "bucket", "k")}
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    lists = {"shards": rows.column("shard").to_numpy(), "sizes": pc.list_value_length(terms).to_numpy(), "place": rank[coded.indices.to_numpy()]}
    own = {c: pa.array([v]) for c, v in {**first, "n": len(order)}.items()}
    own |= {"terms": _one(coded.dictionary.take(pa.array(order)))} | {c: pa.array([_bytes(v, np.int32)]) for c, v in lists.items()}
    return pa.table(own | {"many": pa.array([_bytes(np.ones(len(order)), np.int32)])}).cast(_arrow(_BUCKET))


def _own_bucket(shard: pa.Table) -> pa.Table:
    """The bucket of a shard's own terms."""
    row = shard.drop_columns(["own"]).to_pylist()[0]
    many = _ints(row, "many")[0]
    if not len(many):
        return _table(_BUCKET)
    numbers = ([row["shard"]], [len(many)], np.arange(len(many)), many)
    first = [pa.array([v]) for v in (row["g"], _OWN + row["shard"], row["k"], len(many))]
    lists = [_one(shard.column("own").combine_chunks().flatten()), *(pa.array([_bytes(v, np.int32)]) for v in numbers)]
    return pa.table([*first, *lists], names=_arrow(_BUCKET).names).cast(_arrow(_BUCKET))


def _ints(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[name], np.int32) for name in names]


class _Fitted:
    """The documents of a block fitted to the weights of its terms (term by topic)."""

    def __init__(self, block: dict, weights: np.ndarray):
        k = block["k"]
        # by document, shortest first; each document of a block has a term
        length, term, times = _ints(block, "lengths", "term", "times")
        n, prior, end = len(length), 1 / k, np.cumsum(length)
        self.gamma = np.ones((n, k))
        # documents, topics, terms: neighbours are padded with terms of no weight that occur no time
        alike = []
        for at in range(0, n, ALIKE):
            own, width = slice(at, min(at + ALIKE, n)), length[min(at + ALIKE, n) - 1]
            inside = np.arange(width) < length[own, None]
            span = slice(end[at] - length[at], end[own.stop - 1])
            often, weight = np.zeros(inside.shape), np.zeros((k, *inside.shape))
            often[inside] = times[span]
            for i in range(k):
                weight[i][inside] = weights[term[span], i]
            alike.append((own, inside, often, np.ascontiguousarray(weight.transpose(1, 0, 2))))

        def total(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
            return (share[:, None, :] @ weight)[:, 0] + 1e-300

        for _ in range(STEPS):
            share = np.exp(digamma(self.gamma) - digamma(self.gamma.sum(1))[:, None])
            new = np.empty((n, k))
            for own, _, often, weight in alike:
                new[own] = (weight @ (often / total(share[own], weight))[:, :, None])[:, :, 0]
            new = prior + share * new
            change, self.gamma = np.abs(new - self.gamma).mean(), new
            if change < STEP_CHANGE:
                break
        log_share = digamma(self.gamma) - digamma(self.gamma.sum(1))[:, None]
        share = np.exp(log_share)
        sums = np.concatenate([total(share[own], weight)[inside] for own, inside, _, weight in alike])
        parts = times / sums
        dealt = [np.bincount(term, np.repeat(share[:, i], length) * parts, len(weights)) for i in range(k)]
        self.sums = weights * np.stack(dealt, 1)
        own = (prior - self.gamma) * log_share + log_gamma(self.gamma)
        constant = log_gamma(np.array(1.0)) - k * log_gamma(np.array(prior))
        self.bound = float((times * np.log(sums)).sum() + own.sum() - log_gamma(self.gamma.sum(1)).sum() + n * constant)


def _columns(values: np.ndarray) -> dict[str, pa.Array]:
    """Topic columns, zero from k on."""
    full = np.zeros((len(values), MAX_TOPICS))
    full[:, : values.shape[1]] = values
    return {p: pa.array(full[:, i]) for i, p in enumerate(_P)}


class _FittedShard:
    """The blocks of a shard, each fitted on its own; ``sums`` are those of one term where many are one."""

    def __init__(self, shard: dict, weights: np.ndarray):
        docs, lengths, many = _ints(shard, "docs", "lengths", "many")
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.sums, self.bound, gammas, doc = np.zeros(weights.shape), 0.0, [], 0
        for size in docs.tolist():
            entries = slice(4 * ends[doc], 4 * ends[doc + size])
            block = {"k": shard["k"], "lengths": shard["lengths"][4 * doc : 4 * (doc + size)], "term": shard["term"][entries], "times": shard["times"][entries]}
            found, doc = _Fitted(block, weights), doc + size
            self.sums += found.sums
            self.bound += found.bound
            gammas.append(found.gamma)
        self.gamma = np.concatenate(gammas)
        self.sums[len(weights) - len(many) :] /= many[:, None]


def _fitted(shard: pa.Table, down: pa.Table) -> tuple[dict, _FittedShard] | None:
    """A shard and its fit; a topic's weight of a term is the exponential of its expected logarithm."""
    if not shard.num_rows or not down.num_rows:
        return None
    row = shard.to_pylist()[0]
    sums = np.frombuffer(b"".join(down.sort_by("bucket").column("sums").to_pylist())).reshape(-1, row["k"])
    return row, _FittedShard(row, np.exp(digamma(sums) - np.array([row[t] for t in _T[: row["k"]]])))


def _sent(row: dict, sums: np.ndarray, bound: float | None = None) -> pa.Table:
    """A shard's counts to its buckets, and its part of the bound."""
    key = {"g": row["g"], "shard": row["shard"]}
    out, at = [], 0
    for bucket, size in zip([*row["buckets"], _OWN + row["shard"]], [*row["sizes"], len(sums) - sum(row["sizes"])], strict=True):
        if size:
            out.append({**key, "bucket": bucket, "sums": _bytes(sums[at : at + size], float)})
        at += size
    return _table(_UP, out if bound is None else [*out, {**key, "bucket": -1, "bound": bound}])


def _start_counts(shard: pa.Table) -> pa.Table:
    """Most of each document on one topic chosen by its id."""
    row = shard.to_pylist()[0]
    lengths, term, times, start, many = _ints(row, "lengths", "term", "times", "start", "many")
    k, n = row["k"], sum(row["sizes"]) + len(many)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    shares = np.full((len(start), k), (1 - _START) / k)
    shares[np.arange(len(start)), start] += _START
    sums = np.stack([np.bincount(term, shares[doc, i] * times, n) for i in range(k)], 1)
    sums[n - len(many) :] /= many[:, None]
    return _sent(row, sums)


def _expected_counts(shard: pa.Table, down: pa.Table) -> pa.Table:
    if (met := _fitted(shard, down)) is None:
        return _table(_UP)
    row, found = met
    return _sent(row, found.sums, found.bound)


def _document_shares(shard: pa.Table, down: pa.Table) -> pa.Table:
    """The documents' topic counts, prior included."""
    if (met := _fitted(shard, down)) is None:
        return _table(_SHARES)
    row, found = met
    return pa.table({"g": pa.array([row["g"]] * len(row["ids"])), "videoId": pa.array(row["ids"], pa.string()), **_columns(found.gamma)})


def _term_weights(bucket: pa.Table, down: pa.Table) -> pa.Table:
    """Terms of a bucket with their counts in the group, by topic, and their places among them."""
    if not bucket.num_rows or not down.num_rows:
        return _table(_WEIGHTS)
    terms = bucket.column("terms").combine_chunks().flatten()
    row = bucket.drop_columns(["terms"]).to_pylist()[0]
    k = row["k"]
    sums = np.empty((row["n"], k))
    # all shards of a term bring the same counts
    at, many = _ints(row, "place", "many")
    sums[at] = np.frombuffer(b"".join(down.sort_by("shard").column("sums").to_pylist())).reshape(-1, k)
    # terms that are one number lie one after the other
    number = np.repeat(np.arange(row["n"]), many)
    order, n = pc.sort_indices(terms).to_numpy(), len(terms)
    by_name, place = sums[number[order]], np.empty((n, k), np.int32)
    for i in range(k):
        place[order[np.argsort(-by_name[:, i], kind="stable")], i] = np.arange(1, n + 1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    listed = np.lexsort((rank, number))
    begin = np.cumsum(many) - many
    place, inside = place[listed], np.arange(n) - np.repeat(begin, many)
    # where terms of another number come between, each has a row of its own
    apart = np.repeat(np.logical_or.reduceat((place - inside[:, None] != place[begin][number]).any(1), begin), many)
    first = np.flatnonzero((inside == 0) | apart)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(first) * k + 1, k, np.int32)), pa.array(v.ravel())) for v in (sums[number[first]], place[first])]
    named = pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), terms.take(pa.array(listed)))
    return pa.table([pa.array(np.full(len(first), row["g"])), named, *lists], names=_arrow(_WEIGHTS).names).cast(_arrow(_WEIGHTS))


def _group_counts(bucket: pa.Table, up: pa.Table) -> pa.Table:
    """Shards' counts summed for the terms of a bucket: to the shards, and in total."""
    if not up.num_rows:
        return _table(_DOWN)
    if not bucket.num_rows:
        return _table(_DOWN, [{"g": up.column("g")[0].as_py(), "shard": -1, "bucket": -1, "bound": float(np.sort(up.column("bound").to_numpy()).sum())}])
    row, up = bucket.to_pylist()[0], up.sort_by("shard")
    shards, sizes, place, many = _ints(row, "shards", "sizes", "place", "many")
    k, prior = row["k"], 1 / row["k"]
    sums = np.frombuffer(b"".join(up.column("sums").to_pylist())).reshape(-1, k)
    x = np.stack([np.bincount(place, sums[:, i], row["n"]) for i in range(k)], 1) + prior
    key, n = {"g": row["g"], "bucket": row["bucket"], "k": k}, int(many.sum())
    part = float((((prior - x) * digamma(x) + log_gamma(x)).sum(1) * many).sum() - n * k * log_gamma(np.array(prior)))
    out = [{**key, "shard": -1, "part": part, "n": n, **dict(zip(_P, (x * many[:, None]).sum(0).tolist(), strict=False))}]
    at = x[place]
    for shard, begin, size in zip(shards.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        out.append({**key, "shard": shard, "sums": at[begin : begin + size].tobytes()})
    return _table(_DOWN, out)


def _state(down: DataFrame) -> DataFrame:
    """g, found, part, t0..t4: the shards' and the terms' part of the bound, and the expected logarithm of each topic's total."""
    summed = down.filter("shard = -1").groupBy("g").agg(
        F.max("k").alias("k"), F.sum("n").alias("n"), F.sum("bound").alias("found"), F.sum("part").alias("part"),
        *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in _P],
    )
    names = ["g", "found", "part", *_T]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = batch.column("k").to_numpy()[:, None], batch.column("n").to_numpy()[:, None]
            used, prior = np.arange(MAX_TOPICS) < k, 1 / k
            total = np.where(used, np.stack([batch.column(p).to_numpy() for p in _P], 1), 1)
            log = digamma(total)
            own = log_gamma(n * prior) - log_gamma(total) - log * (n * prior - total)
            part = batch.column("part").to_numpy() + np.where(used, own, 0).sum(1)
            log = np.where(used, log, 0)
            logs = [pa.array(log[:, i]) for i in range(MAX_TOPICS)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("found"), pa.array(part), *logs], names)

    return summed.mapInArrow(run, f"g bigint, found double, part double, {', '.join(f'{t} double' for t in _T)}")


def fit_topics(
    in_period: DataFrame,
    stopwords: Iterable[str],
    max_iter: int = 12,
    seed: int = 42,
    tolerance: float = 1e-4,
    tokenised: DataFrame | None = None,
) -> TopicModel:
    """Topics of every (period, entity), priors 1/k, k from the group's size.

    A document without tokens keeps equal shares.  A group in which no document
    has a token has no vocabulary and is left out; rows without an id take no part.  A
    group leaves the passes once its bound rises by less than ``tolerance`` of itself.
    ``tokenised`` hands in period, channelId, videoId and tokens where they exist already.
    """
    key = ["period", "channelId", "videoId"]
    spark = in_period.sparkSession
    narrow = in_period.select(*key)
    source = in_period.select(*key, "videoTranscript") if tokenised is None else tokenised.select(*key, "tokens")

    def cut(rows: DataFrame) -> DataFrame:
        return rows if tokenised is not None else with_tokens(rows, stopwords)

    with Tables(spark) as tables:
        # groups get a number, which is shorter to send and compare than their names
        groups = tables.keep(group_sizes(narrow).select(*GROUP, topic_count(F.col("n")).cast("int").alias("k"), "n", F.monotonically_increasing_id().alias("g")))
        few_groups, batches = fits(groups), _batches(groups)
        blocks_of = F.ceil(F.col("n") / BLOCK_DOCS)
        # both the terms of a bucket and the arrays that a shard sends grow with the root of the blocks
        numbered = groups.select(*GROUP, "g", "k", blocks_of.alias("blocks"), F.ceil(4 * F.sqrt(blocks_of)).cast("int").alias("buckets"))
        parts = []
        for batch in batches:
            own = numbered.filter(batch)
            texts = with_entities((cut(source) if len(batches) == 1 else source).filter("videoId is not null")).drop("channelId")
            texts = sized_join(texts, own, GROUP, "inner", few_groups)
            members = sized_join(with_entities(narrow.filter("videoId is not null")).select(*GROUP, "videoId"), own.select(*GROUP, "g", "k"), GROUP, "inner", few_groups)
            # a text of several batches is cut once for each of them
            parts.append(_fit_batch(texts if len(batches) == 1 else cut(texts), members, own, few_groups, max_iter, seed, tolerance))
        documents, stored, bounds = (_together(tables) for tables in zip(*parts, strict=True))
    rows = stored.select(*GROUP, "topics", F.posexplode("terms").alias("_at", "term"))
    topics = rows.select(*GROUP, "term", "_at", F.posexplode("topics").alias("topic", "_t"))
    terms = topics.select(*GROUP, "term", "topic", F.col("_t.weights").alias("weight"), (F.col("_t.places") + F.col("_at")).alias("place"))
    return TopicModel(documents, terms, bounds)


def _together(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for part in tables[1:]:
        out = out.unionByName(part)
    return out


def _batches(groups: DataFrame) -> list[Column]:
    """Conditions on the groups that deal them to batches of bounded size; a larger group is one alone.

    Only large groups, of which there are few by construction, come to the driver; the others go by a hash.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    room = max(BATCH_DOCS, -(-total // BATCHES))
    if total <= room:
        return [F.lit(True)]
    large = groups.filter(F.col("n") * 2 > room).select("g", "n").orderBy(F.desc("n"), "g").collect()
    dealt: list[tuple[int, list[int]]] = []
    for row in large:
        at = next((i for i, (n, _) in enumerate(dealt) if n + row["n"] <= room), len(dealt))
        n, own = dealt[at] if at < len(dealt) else (0, [])
        dealt[at : at + 1] = [(n + row["n"], [*own, row["g"]])]
    named = [F.col("g").isin(own) for _, own in dealt]
    rest = total - sum(n for n, _ in dealt)
    times = -(-rest // room)
    others = ~F.col("g").isin([row["g"] for row in large])
    return named + [others & (F.pmod(F.xxhash64("g"), F.lit(times)) == i) for i in range(times)]


def _fit_batch(
    texts: DataFrame, members: DataFrame, numbered: DataFrame, few_groups: bool, max_iter: int, seed: int, tolerance: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, stored terms and bounds of some groups; ``texts`` are their documents' tokens, ``members`` their documents."""
    with Tables(texts.sparkSession) as tables:
        block = F.pmod(F.xxhash64("videoId"), F.col("blocks")).cast("int").alias("block")
        start = F.pmod(F.xxhash64("videoId", F.lit(seed)), F.col("k")).cast("int").alias("start")
        placed = texts.select("g", "k", "buckets", block, start, "videoId", "tokens")
        shard = F.floor(F.col("block") / SHARD_BLOCKS).cast("int").alias("shard")
        blocks = tables.keep(placed.groupBy("g", "block").applyInArrow(_pack, _BLOCK).select("*", shard))

        def by_bucket(rows: DataFrame, *columns: str) -> DataFrame:
            own = F.transform(
                F.arrays_zip("buckets", "begins", "sizes"),
                lambda x: F.struct(x.buckets.alias("bucket"), F.slice("terms", x.begins, x.sizes).alias("terms")),
            )
            return rows.select("g", *columns, F.explode(own).alias("own")).select("g", *columns, "own.*")

        # a group of one shard has all its terms there
        large = numbered.filter(F.col("blocks") > SHARD_BLOCKS).select("g")
        pieces = by_bucket(sized_join(blocks, large, ["g"], "left_semi", few_groups), "shard", "block")
        several = pieces.groupBy("g", "bucket").applyInArrow(_several, _SEVERAL)
        whole = tables.keep(blocks.groupBy("g", "shard").cogroup(several.groupBy("g", "shard")).applyInArrow(_merge, _SHARD))
        tables.drop(blocks)
        shared = by_bucket(whole, "shard", "k").groupBy("g", "bucket").applyInArrow(_gather, _BUCKET)
        alone = whole.select("g", "shard", "k", "own", "many").groupBy("g", "shard").applyInArrow(_own_bucket, _BUCKET)
        buckets = tables.keep(shared.unionByName(alone))
        # the terms' names are with the buckets now
        shards = tables.keep(whole.select(*_NUMBERS, "ids", "start"))
        tables.drop(whole)

        def at_shards(columns: Sequence[str], down: DataFrame, state: DataFrame, act, schema: str) -> DataFrame:
            known = sized_join(shards.select(*columns), state.select("g", *_T), ["g"], "inner", few_groups)
            sums = down.filter("shard >= 0").select("g", "shard", "bucket", "sums")
            return known.groupBy("g", "shard").cogroup(sums.groupBy("g", "shard")).applyInArrow(act, schema)

        def at_buckets(left: DataFrame, up: DataFrame) -> DataFrame:
            return left.groupBy("g", "bucket").cogroup(up.groupBy("g", "bucket")).applyInArrow(_group_counts, _DOWN)

        settled, bounds, theirs = [], [], buckets.select(*_PLACES)
        begun = shards.select(*_NUMBERS, "start").groupBy("g", "shard").applyInArrow(_start_counts, _UP)
        down = last = tables.keep(at_buckets(theirs, begun))
        state = tables.keep(_state(down).withColumn("bound", F.lit(None).cast("double")))
        for number in range(max_iter):
            down, past = tables.keep(at_buckets(theirs, at_shards(_NUMBERS, down, state, _expected_counts, _UP))), last
            tables.drop(past)
            last = down
            before = state.select("g", F.col("part").alias("own"), F.col("bound").alias("was"))
            bound, rise = F.col("found") + F.col("own"), F.col("bound") - F.col("was")
            now = sized_join(_state(down), before, ["g"], "inner", few_groups).withColumn("bound", bound)
            still = F.coalesce(rise > tolerance * F.abs("was"), F.lit(True))
            state = tables.keep(now.select("g", "part", *_T, "bound", still.alias("open"), F.lit(number).alias("pass")))
            bounds.append(state.select("g", "pass", "bound"))
            opened, every = state.agg(F.count_if("open"), F.count("*")).first()
            if number == max_iter - 1 or not opened:
                settled.append(down)
                break
            if opened < every:
                settled.append(tables.keep(sized_join(down, state.filter("not open").select("g"), ["g"], "left_semi", few_groups)))
                state = state.filter("open")
                down, theirs = (sized_join(x, state.select("g"), ["g"], "left_semi", few_groups) for x in (down, buckets.select(*_PLACES)))
        down = _together(settled)
        shares = at_shards([*_NUMBERS, "ids"], down, tables.keep(_state(down)), _document_shares, _SHARES)
        filled = sized_join(members, shards.select("g").distinct(), ["g"], "left_semi", few_groups)
        total = sum((F.col(p) for p in _P[1:]), F.col(_P[0]))
        own = [F.when(F.lit(i) < F.col("k"), F.coalesce(F.col(p) / total, 1 / F.col("k"))).alias(p) for i, p in enumerate(_P)]
        documents = materialise(filled.join(shares, ["g", "videoId"], "left").select(*GROUP, "videoId", "k", *own))
        names = numbered.select("g", *GROUP)
        sums = down.filter("shard >= 0").select("g", "shard", "bucket", "sums")
        by_topic = buckets.select("g", "bucket", "k", "n", "terms", "place", "many").groupBy("g", "bucket").cogroup(sums.groupBy("g", "bucket"))
        weights = sized_join(by_topic.applyInArrow(_term_weights, _WEIGHTS), names, ["g"], "inner", few_groups)
        # a row for each term and topic on reading
        stored = materialise(weights.select(*GROUP, "terms", F.arrays_zip("weights", "places").alias("topics")))
        every = materialise(sized_join(_together(bounds), names, ["g"], "inner", few_groups).select(*GROUP, "pass", "bound"))
    return documents, stored, every


def topic_terms(model: TopicModel, n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms of each topic; only those that are so in their bucket are ranked."""
    order = [F.col("weight").desc(), F.col("term")]
    return top_per_group(model.terms.filter(F.col("place") <= n).drop("place"), [*GROUP, "topic"], n, order)


def topic_label(topic: Column, terms: Column, shown: int = 3) -> Column:
    """Number of the topic and its first terms, or a mark for an empty topic."""
    listed = F.array_join(F.slice(terms, 1, shown), ", ")
    tail = F.when(F.size(terms) > 0, listed).otherwise(F.lit("[vazio]"))
    return F.concat(F.lit("Tópico "), topic.cast("string"), F.lit(": "), tail)


def topic_labels(model: TopicModel, n: int = 10) -> DataFrame:
    """One label per topic; at most ``n`` terms are put together."""
    terms = topic_terms(model, n)
    listed = terms.groupBy(*GROUP, "topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_t")
    )
    return listed.select(
        *GROUP, "topic", topic_label(F.col("topic"), F.col("_t.term")).alias("topic_label")
    )


def _shares() -> Column:
    return F.array(*[F.coalesce(p, F.lit(-1.0)) for p in _P])


def dominant_topics(model: TopicModel) -> DataFrame:
    """Topic with the largest share of each document, the lowest number on ties."""
    best = F.array_max(_shares())
    return model.documents.select(
        *GROUP,
        "videoId",
        (F.array_position(_shares(), best) - 1).cast("int").alias("topic"),
        best.alias("share"),
    )


def representative_documents(
    model: TopicModel, videos: DataFrame, length: int = 200
) -> DataFrame:
    """Per topic the document with the largest share of it, with an excerpt.

    A video that comes several times, as in overlapping periods, is one document; where
    ``videos`` lacks it the excerpt is NULL.  Only excerpts of chosen documents move.
    """
    long = model.documents.select(
        *GROUP, "videoId", F.posexplode(F.slice(F.array(*_P), F.lit(1), F.col("k"))).alias("topic", "share")
    )
    keyed = long.withColumn("_none", F.lit(""))
    top = argmax_per_group(keyed, [*GROUP, "topic"], "share", "videoId", "_none")
    top = materialise(top.drop("example"))
    chosen = top.select("videoId").distinct()
    shown = videos.select("videoId", X.excerpt(F.col("videoTranscript"), length).alias("example"))
    shown = sized_join(shown, chosen, ["videoId"], "left_semi", small=fits(chosen))
    return top.join(shown.groupBy("videoId").agg(F.min("example").alias("example")), "videoId", "left")


def topic_engagement(
    model: TopicModel,
    videos: DataFrame,
    examples: bool = False,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Mean metrics, size and label of every dominant topic, most viewed first.

    ``examples`` adds the excerpt of the topic's representative document; all
    parts are joined by topic number.  A video that is in several periods counts once
    in each of them; of rows that differ in metrics the greatest counts.
    """
    key = [*GROUP, "topic"]
    once = videos.groupBy("videoId").agg(F.max(F.struct(*metrics)).alias("_m")).select("videoId", "_m.*")
    placed = dominant_topics(model).join(once, "videoId")
    stats = placed.groupBy(*key).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("num_videos")
    )
    table = stats.join(topic_labels(model), key, "left")
    if examples:
        shown = representative_documents(model, videos).select(*key, "example")
        table = table.join(shown, key, "left")
    return table.orderBy(*GROUP, F.col(metrics[0]).desc(), "topic")
