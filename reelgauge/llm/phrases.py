"""Phrases that stand together more often than their parts explain, from sorted count streams.

Texts are read once per level: words, pairs of words, then longer phrases.  A phrase can
only be frequent if the pairs in it are, so a map of fixed size, made of the frequent
phrases of the level before, leaves out nearly all others before anything is counted;
what it lets through by chance is dropped by its count.  Inside a task words are numbers
and a phrase is the number of its beginning beside that of its last word, so that some
megabytes of text are counted by sorting arrays.  Counts are summed in the tasks
before they move.  The frequent phrases then are two streams, one in the order of their
first words and one in that of their last ones; sort-merge joins walk these and the
stream of counts in step, which gives the counts of all left and right parts and of the
longer phrases around, without a table of all phrases anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.llm.common import Tables, small_batches
from reelgauge.operators.scaling import materialise

#: Words of a phrase at most, occurrences it must have, phrases reported for each language.
MOST_WORDS, LEAST, TOP = 5, 100, 2000
#: Bits of the map of the phrases that were frequent one level before.
MAP_BITS = 24
#: Distinct words a task holds before it hands its counts on.
HELD = 400_000
#: Bytes of texts whose phrases are counted at once.
CHUNK_BYTES = 8 << 20

# A-Z in lower case, marks that end a piece, and the two blanks between words.
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


class Frequent:
    """Which phrases of a language may be frequent: surely not those whose bits are not in the map."""

    def __init__(self, bits: np.ndarray, lang: str):
        self.bits, self.start = bits, zlib.crc32(lang.encode() + b" ")

    def __call__(self, phrases: pa.Array) -> np.ndarray:
        start = self.start
        at = np.array([zlib.crc32(p, start) for p in phrases.to_pylist()], np.uint32) >> np.uint32(32 - MAP_BITS)
        return (self.bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def numbered(texts: list[bytes], frequent: Frequent) -> tuple[np.ndarray, pa.Array]:
    """The words of texts in lower case as numbers, and the numbered words; -1 stands for one
    that isn't frequent or for the end of a piece."""
    text = pa.array([b"\n".join(texts).replace(b"\n", b" \n ")], pa.large_binary())
    coded = pc.split_pattern(text, b" ").flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    number = np.where(frequent(words), np.arange(len(words)), -1)
    for word, value in ((b"\n", -1), (b"", -2)):
        if (at := pc.index(words, pa.scalar(word, pa.binary())).as_py()) >= 0:
            number[at] = value
    ids = number[coded.indices.to_numpy()]
    return ids[ids != -2], words


def phrase_counts(ids: np.ndarray, words: pa.Array, pairs: Frequent | None, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct phrases with their counts: pairs of numbered words, or, where it is known which
    ``pairs`` may be frequent, phrases of three words and more all of whose pairs may be."""

    def extended(begin: np.ndarray, names: pa.Array, last: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        code, number, count = np.unique(begin << 32 | last, return_inverse=True, return_counts=True)
        longer = pc.binary_join_element_wise(names.take(pa.array(code >> 32)), words.take(pa.array(code & 0xFFFFFFFF)), b" ")
        return longer, number, count

    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    names, number, count = extended(ids[at], words, ids[at + 1])
    if pairs is None:
        yield names, count
        return
    used = pairs(names)[number]
    at, number = at[used], number[used]
    good = np.zeros(len(ids) + most, bool)
    good[at] = True
    for size in range(3, most + 1):
        used = good[at + size - 2]
        at, number = at[used], number[used]
        names, number, count = extended(number, names, ids[at + size - 1])
        yield names, count


def _counted(docs: DataFrame, maps: Sequence[np.ndarray], most: int) -> DataFrame:
    """lang, phrase, n of the phrases of one level: words, pairs by a map of the words, all longer ones by that and one of the pairs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held: dict[str, list[bytes]] = {}
        size = 0

        def row(lang: str, phrases: pa.Array, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), phrases.cast(pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield row(lang, pa.array(list(found), pa.binary()), np.fromiter(found.values(), np.int64, len(found)))
            for lang, texts in held.items():
                words, *pairs = (Frequent(bits, lang) for bits in maps)
                for phrases, count in phrase_counts(*numbered(texts, words), pairs[0] if pairs else None, most):
                    if len(count):
                        yield row(lang, phrases, count)
            counts.clear()
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                text = text.translate(_TABLE)
                if maps:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                else:
                    counts.setdefault(lang, Counter()).update(text.split())
                if size > CHUNK_BYTES or sum(map(len, counts.values())) > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    by_task = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, phrase string, n bigint")
    return by_task.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _map_of(phrases: DataFrame) -> np.ndarray:
    """The map of the phrases' hashes: as large for any input."""
    at = F.shiftright(F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")), 32 - MAP_BITS)
    words = phrases.select(at.alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("word"))
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    found = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(31).cast("int"))).alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out.astype("<u4").view(np.uint8)


def frequent_phrases(docs: DataFrame, tables: Tables, most: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of every phrase with ``least`` occurrences; and lang, n of all words."""
    words = tables.keep(_counted(docs, [], most))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found, maps = [tables.keep(words.filter(F.col("n") >= least))], []
    for _ in range(2, min(most, 3) + 1):
        maps.append(_map_of(found[-1]))
        counted = _counted(docs, tuple(maps), most)
        found.append(tables.keep(counted.filter(F.col("n") >= least)))
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    return tables.keep(every.select("lang", "phrase", size.cast("int").alias("size"), F.col("n").alias("f"))), totals


def _scores(cuts: DataFrame) -> DataFrame:
    """``cuts`` with score = floor(1000 a n / (l r)), in whole numbers of any size."""
    names = ["lang", "phrase", "k", "a", "l", "r", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, left, right, n = (batch.column(i).to_pylist() for i in range(3, 7))
            score = [1000 * w * x // (y * z) for w, x, y, z in zip(a, n, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.int64())], [*names, "score"])

    kinds = "lang string, phrase string, k int, a bigint, l bigint, r bigint, n bigint, score bigint"
    return cuts.select(*names).mapInArrow(run, kinds)


def _head(k: Column) -> Column:
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k.cast("int"))


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks,
    A-Z in lower case; a null language is ``und``, a null text has no words, and every
    row counts, repeated ones too.  Phrases of 2 to ``most`` words with ``least``
    occurrences are candidates; one that stands only inside a longer candidate of the
    same count is dropped.  Of all cuts of a phrase in two the one with the lowest score
    counts, of equal ones the first.  Other columns are ignored.
    """
    with Tables(docs.sparkSession) as tables:
        stream, totals = frequent_phrases(docs, tables, most, least)
        phrases = stream.filter("size >= 2")
        # a phrase is inside a longer one of the same count if it is so in one by a word longer
        first, last = _head(F.lit(1)), F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(-1))
        without_last = F.left("phrase", F.length("phrase") - F.length(last) - 1)
        without_first = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
        longer = phrases.filter("size >= 3")
        around = longer.select("lang", without_last.alias("phrase"), "f").union(longer.select("lang", without_first, "f"))
        around = around.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
        kept = phrases.join(around.hint("merge"), ["lang", "phrase"], "left").filter("around is null or 100 * around < 100 * f")
        cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        cuts = cuts.withColumn("head", _head(F.col("k"))).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
        # in the order of first words, then in that of last ones, each in step with the counts
        heads = stream.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")).hint("merge")
        tails = stream.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")).hint("merge")
        met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals) if totals.limit(TOTALS + 1).count() <= TOTALS else totals, "lang")
        scored = tables.keep(_scores(met.withColumn("k", F.col("k").cast("int"))))
        best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("x"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return materialise(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


#: Languages whose totals may travel to all tasks.
TOTALS = 10_000

#: The same rows in DuckDB: all phrases of all lengths are counted.
SQL = """
with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from docs
), words as (
  select lang, [w for w in regexp_split_to_array(piece, '[ \\x09]+') if w <> ''] as w from pieces
), grams as (
  select lang, m.size, unnest([array_to_string(w[i : i + m.size - 1], ' ') for i in range(1, len(w) - m.size + 2)]) as phrase
  from words, (select unnest([1, 2, 3, 4, 5]) as size) m where len(w) >= m.size
), counts as (
  select lang, size, phrase, count(*) as f from grams group by all
), totals as (
  select lang, sum(f)::bigint as n from counts where size = 1 group by lang
), candidates as (
  select *, string_split(phrase, ' ') as w from counts where size >= 2 and f >= 100
), around as (
  select lang, phrase, max(f) as f from (
    select lang, array_to_string(w[1 : size - 1], ' ') as phrase, f from candidates
    union all select lang, array_to_string(w[2 : size], ' '), f from candidates) group by all
), kept as (
  select c.* from candidates c left join around x on x.lang = c.lang and x.phrase = c.phrase where x.f is null or x.f < c.f
), cuts as (
  select lang, phrase, w, size, f as a, unnest(range(1, size)) as k from kept
), scored as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, t.n, ((1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f))::bigint as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : c.k], ' ') and l.size = c.k
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ') and r.size = c.size - c.k
  join totals t on t.lang = c.lang
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best qualify rank <= 2000
"""
