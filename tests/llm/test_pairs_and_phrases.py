"""Phrases, near copies, groups of any size and aligned tokenizers against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgauge.llm import alignment, bm25, centred, minhash, ngram_join, phrases
from reelgauge.llm.common import Tables
from reelgauge.llm.components import components
from reelgauge.llm.shingles import shingle_sets
from reelgauge.llm.text_classes import SLICE_BYTES
from reelgauge.operators import scaling
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "!!"), (5, "x"), (5, "x"), (6, "the cat sat on the mat and ran " * 300),
    (7, "Straße İstanbul Σας ﬁ 한국어 中文 ́ \x1c\x85"), (8, "word" * 500), (9, "<|endoftext|> <s> don't"), (None, "no id here at all"),
    (10, "a  b\n  c \t d▁e"), (None, "no id here at all"), (11, "two   blanks ▁"), (6, "another text of the same id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.selectExpr("*", "cast(null as string) as lang", "1 as score", "2 as n", "3 as cls", "4 as row", "5 as phrase").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# --- phrases --------------------------------------------------------------------


def brute_phrases(rows, most, least, top):
    import re

    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + most, len(words)) + 1):
                    key = (lang, tuple(words[i:j]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = any(
            other == lang and len(longer) > len(words) and f >= a and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), f in found.items()
        )
        if not inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((" ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    return {
        (lang, rank, *row)
        for lang, rows in out.items()
        for rank, row in enumerate(sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top], 1)
    }


def as_set(frame):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def test_phrases_against_brute_force(docs):
    small = docs.limit(60).cache()
    rows = [(r.lang, r.text) for r in small.collect()]
    assert as_set(phrases.collocations(small, least=4, top=50)) == brute_phrases(rows, 5, 4, 50)


def test_phrases_of_odd_rows(spark, odd, docs):
    assert as_set(phrases.collocations(odd, least=2)) == brute_phrases([(None, t) for _, t in ODD], 5, 2, 2000)
    assert phrases.collocations(odd.limit(0)).count() == 0
    tied = spark.createDataFrame([("x", "a b. a b. c d. c d. Ä b, Ä b"), ("x", "e f g. e f g"), (None, "a b a b a b")], "lang string, text string")
    assert as_set(phrases.collocations(tied, least=2)) == brute_phrases([tuple(r) for r in tied.collect()], 5, 2, 2000)


def test_phrases_pass_64_bits(spark):
    big = spark.createDataFrame([("x", "a b", 1, 9 * 10**17, 10**18, 10**18, 9 * 10**18)], "lang string, phrase string, k int, a long, l long, r long, n long")
    assert phrases._scores(big).first().score == 1000 * 9 * 10**17 * 9 * 10**18 // 10**36


def test_phrases_of_a_chunk_are_counted_as_numbers():
    texts = ["a b c a b c d. a b", "x\x00 a  b\tc d\nb c", "", "d d d d d", "é a b c"]
    lowered = [t.encode().translate(phrases._TABLE) for t in texts]
    every = phrases.Frequent(np.full(1 << (phrases.MAP_BITS - 3), 255, np.uint8), "en")
    ids, words = phrases.numbered(lowered, every)
    brute = {size: {} for size in range(2, 6)}
    for text in lowered:
        for piece in text.split(b"\n"):
            own = piece.split()
            for size in brute:
                for i in range(len(own) - size + 1):
                    phrase = b" ".join(own[i : i + size])
                    brute[size][phrase] = brute[size].get(phrase, 0) + 1
    counted = lambda pairs: [dict(zip(p.to_pylist(), n.tolist(), strict=True)) for p, n in phrases.phrase_counts(ids, words, pairs, 5)]
    assert counted(None) == [brute[2]]
    assert counted(every) == [brute[3], brute[4], brute[5]]
    # only what the map has is counted: without the pair of b and c nothing goes on over it
    bits = np.zeros(1 << (phrases.MAP_BITS - 3), np.uint8)
    for pair in (b"a b", b"c a", b"d d"):
        at = zlib.crc32(b"en " + pair) >> (32 - phrases.MAP_BITS)
        bits[at >> 3] |= 1 << (at & 7)
    assert counted(phrases.Frequent(bits, "en")) == [{b"c a b": 1, b"d d d": 3}, {b"d d d d": 2}, {b"d d d d d": 1}]



def test_phrases_statement(docs):
    assert not differences(phrases.collocations(docs), connect(SF), phrases.SQL)


# --- groups of any size -----------------------------------------------------------


def brute_components(sets, percent, groups):
    root = {c: c for c in sets}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    for members in groups.values():
        members = sorted(members)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {c: top(c) for c in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_links_in_large_groups(spark, monkeypatch, percent):
    # bounds so small that groups are centred again and again, and halves meet at last
    monkeypatch.setattr(centred, "WHOLE", 6)
    monkeypatch.setattr(centred, "CENTRED", 8)
    monkeypatch.setattr(centred, "BLOCKS", 4)
    monkeypatch.setattr(centred, "ROUNDS", 3)
    rng = np.random.default_rng(percent)
    sets, groups = {}, {}
    base = set(range(1000, 1100))
    for c in range(160):
        gone = set(rng.choice(sorted(base), rng.integers(0, 22), replace=False).tolist())
        sets[c] = (base - gone) | set(rng.integers(0, 40, rng.integers(0, 12)).tolist())
    for c in range(160, 220):  # another centre, and copies of copies
        sets[c] = set(sets[rng.integers(0, c)]) ^ set(rng.integers(0, 900, rng.integers(0, 10)).tolist())
    for c in range(220, 260):
        sets[c] = set(range(1000, 1040)) | set(rng.integers(5000, 9000, 60).tolist())
    groups = {7: set(range(200)), 8: set(range(180, 260)), 9: {3, 250}, 10: {5}}
    frame = spark.createDataFrame([(g, c) for g, m in groups.items() for c in m], "grp long, cls long")
    values = spark.createDataFrame([(c, len(s), sorted(s)) for c, s in sets.items()], "cls long, n long, v array<long>")
    with Tables(spark) as tables:
        links = centred.links_of(frame, values, percent, tables)
        roots = {r.node: r.root for r in components(links, tables).collect()}
    assert {c: roots.get(c, c) for c in sets} == brute_components(sets, percent, groups)


def test_labels_keep_classes_together(spark):
    rng = np.random.default_rng(3)
    tokens = {(int(t), int(c)) for t, c in zip(rng.integers(0, 60, 200), rng.integers(0, 80, 200), strict=True)}
    with Tables(spark) as tables:
        rows = centred.labelled(spark.createDataFrame(sorted(tokens), "token long, cls long"), tables).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cls, set()).add(r.grp)
    assert all(groups[a] & groups[b] for t, a in tokens for u, b in tokens if t == u)


# --- near copies --------------------------------------------------------------------


def brute_copies(rows, percent):
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in rows])]
    root = brute_components(dict(enumerate(sets)), percent, {0: {i for i, s in enumerate(sets) if s}})
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root[i], []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in ids.items()}
    return Counter((d, len(sets[i]), least[root[i]] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_against_brute_force(docs, percent):
    found = minhash.near_copies(docs, percent=percent).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_copies(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len({r.component_id for r in found}) < len(found)


def test_near_copies_of_odd_rows(odd):
    found = minhash.near_copies(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_copies(ODD, 85)
    assert minhash.near_copies(odd.limit(0)).count() == 0


def test_estimate_of_the_union():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 40, 1000))
    sets = [a, np.sort(np.concatenate([a[:900], a[900:] + 1])), np.unique(rng.integers(0, 1 << 40, 50)), a[:100]]
    guess = minhash.estimates(sets, 64)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            low = sorted(set(x[:64].tolist()) | set(y[:64].tolist()))[:64]
            both = set(x[:64].tolist()) & set(y[:64].tolist())
            if i != j:
                assert guess[i, j] == sum(v in both for v in low) / len(low)


def test_blocks_of_long_texts(monkeypatch):
    from reelgauge.llm import shingles

    texts = ["One two three four five six seven " * 50, "a b", " ".join(f"w{i}" for i in range(900)), "x" * 700 + " y z"]
    whole = [s.tolist() for s in shingle_sets(texts)]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert [s.tolist() for s in shingle_sets(texts)] == whole
    assert SLICE_BYTES > 64


# --- aligned tokenizers ---------------------------------------------------------------


def brute_alignment(text):
    tok = alignment.tokenizers()
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    data = (" " + text).encode()
    if b"".join(tok.bytes_a[i] for i in a) != data or b"".join(tok.bytes_b[i] for i in b) != data:
        return none

    def spans(ids, by):
        ends = np.cumsum([len(by[i]) for i in ids]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    at_a, at_b = spans(a, tok.bytes_a), spans(b, tok.bytes_b)
    groups, i, j = [], 0, 0
    for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
        k, m = i, j
        while k < len(a) and at_a[k][1] <= end:
            k += 1
        while m < len(b) and at_b[m][1] <= end:
            m += 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    links = Counter(a[p] << 32 | b[q] for p, x in enumerate(at_a) for q, y in enumerate(at_b) if x[0] < y[1] and y[0] < x[1])
    return len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links


def check_alignment(rows, found):
    own = [(d, brute_alignment(t)) for d, t in rows]
    holders = Counter(p for _, x in own for p in x[5])
    most = {}
    for p, n in holders.items():
        most[p >> 32] = max(n, most.get(p >> 32, 0))
    wanted = Counter()
    for d, x in own:
        best = sum(n for p, n in x[5].items() if holders[p] == most[p >> 32])
        digest = hashlib.sha256(x[4].encode()).hexdigest() if x[0] else ""
        wanted[d, *x[:4], best, sum(n * holders[p] for p, n in x[5].items()), digest] += 1
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in found.collect()) == wanted


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_against_brute_force(docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(alignment, "COUNT_ROWS", 0)
    small = docs.filter(F.length("text") < 1500).limit(60).cache()
    check_alignment([(r.doc_id, r.text) for r in small.collect()], alignment.align_corpus(small))


def test_alignment_of_odd_rows(odd):
    check_alignment([(d, t if t is None or len(t) < 3000 else t) for d, t in ODD], alignment.align_corpus(odd))
    assert alignment.align_corpus(odd.limit(0)).count() == 0


def test_alignment_of_long_texts_in_pieces(docs, monkeypatch):
    texts = [r.text for r in docs.limit(40).collect()]
    whole = alignment.align(texts)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 40)
    assert alignment.align(texts).groups == whole.groups


def test_quick_ids_are_the_librarys(docs):
    tok = alignment.tokenizers()
    assert tok.quick is not None
    for text in [r.text or "" for r in docs.collect()] + ["don't  'll it's\t\n x", "¡¿ 12ab ÀÉ·x ɏ", "a\r\n\r\nb   ", "<|endoftext|>"]:
        assert tok.ids_a(text, tok.plain(text)).tolist() == tok.a.encode(" " + text, add_special_tokens=False).ids


def test_tables_leave_no_shuffle_files_and_drop(spark):
    import os
    import time

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(scaling.SHUFFLE_CLEANUP)
    with Tables(spark) as tables:
        # Every key moves
        kept = tables.keep(spark.range(0, 50_000, 1, 4).groupBy((F.col("id") * 7).alias("k")).agg(F.max("id").alias("m")))
        assert kept.agg(F.sum("m")).first()[0] == 50_000 * 49_999 // 2
        for _ in range(50):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        assert shuffled() <= before
        other = tables.keep(spark.range(3).toDF("x"))
        tables.drop(kept)
        assert os.listdir(tables.path.removeprefix("file:")) == ["2"] and other.count() == 3
    assert spark.conf.get(scaling.SHUFFLE_CLEANUP) == setting


def test_sketch_parts_add_up():
    rng = np.random.default_rng(8)
    keys = [np.unique(rng.integers(0, 5000, 900)).astype(np.int32) for _ in range(3)]
    counts = [rng.integers(1, 70_000, len(k)).astype(np.uint32) for k in keys]
    whole, found = np.zeros(5000, np.int64), np.zeros(5000, np.int64)
    for k, c in zip(keys, counts, strict=True):
        whole[k] += c
    ngram_join._add(found, ngram_join._pack(*ngram_join._merged(keys[:2], counts[:2])))
    ngram_join._add(found, ngram_join._pack(*ngram_join._merged(keys[2:], counts[2:])))
    assert (found == whole).all()
    bits = ngram_join.Bits(np.packbits(whole[:4992] >= 60_000))
    place = rng.integers(0, 4992, 300)
    assert (bits[place] == (whole[place] >= 60_000)).all()


def test_shards_are_read_one_at_a_time(spark, monkeypatch):
    read, seen, keep = "spark.sql.parquet.columnarReaderBatchSize", [], Tables.keep
    before = spark.conf.get(read)

    def watched(self, df, *compression):
        seen.append((df.columns, spark.conf.get(read), compression))
        return keep(self, df, *compression)

    monkeypatch.setattr(bm25.Tables, "keep", watched)
    # One word in common, one of each document alone.
    docs = spark.createDataFrame([(i, f"common own{i}") for i in range(40)], "doc_id long, text string").repartition(3)
    found = bm25.top_k(docs, docs.filter("doc_id < 5"), 1).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(i, i) for i in range(5)}
    assert [c for columns, _, c in seen if "owner" in columns] == [("zstd",)]
    assert [size for columns, size, _ in seen if columns in (["term", "df"], ["query_id", "doc_id", "score"])] == ["1"] * 3
    assert spark.conf.get(read) == before


def test_few_queries_meet_a_shard_of_many_common_terms():
    rng = np.random.default_rng(4)
    docs, words = 64, 4000
    owner, term = np.repeat(np.arange(docs, dtype=np.int32), words), np.tile(np.arange(1, words + 1).astype(np.uint64), docs)
    shard = bm25.Shard(np.arange(docs), owner, term, rng.integers(1, 9, docs * words).astype(np.int32), np.full(docs, 9000, np.int32), 9000.0, np.arange(1, words + 1))
    held, near = [], shard._near
    shard._near = lambda sizes, *more: held.append(len(sizes)) or near(sizes, *more)
    asked = 300
    found = list(shard.search(np.arange(asked + 1) * 5, rng.integers(0, words, 5 * asked), np.ones(5 * asked), 3, np.zeros(asked)))
    assert len(found) == asked and max(held) * len(shard.common) <= bm25.CELLS
