"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelgauge.llm import bm25, bpe, html_text, langid, licenses, ngram_join, packing, pii, sampling, spotsigs, text_classes, toxicity
from reelgauge.llm.common import Tables
from reelgauge.llm.components import components
from reelgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "!!"), (5, "x"), (5, "x"), (6, "the cat sat on the mat and ran " * 3000),
    (7, "Straße İstanbul Σας ﬁ 한국어 中文 ́ \x1c\x85"), (8, "word" * 5000), (9, "<|endoftext|> don't"), (None, "no id here at all"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # names that clash with what operators use inside
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as score", "2 as n", "3 as ids").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- 1 language ---------------------------------------------------------------


def test_language_held_out(docs):
    found = by_id(langid.identify_documents(docs))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if found[i].held_out]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_ignores_labels_of_held_out(docs):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert by_id(langid.identify_documents(other)) == by_id(langid.identify_documents(docs))


def test_every_label_is_learned(spark):
    rows = [(i, f"word{i % 70} text{i % 70} more{i % 70}", f"l{i % 70:02d}") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    taken = sampling.labelled_sample(frame, frame, 3, 70, 100)
    assert len({label for _, label in taken}) == 70 and len(taken) <= 210
    with pytest.raises(ValueError, match="labels to learn"):
        sampling.labelled_sample(frame, frame, 3, 69, 100)


def test_language_odd(odd, empty):
    found = langid.identify_documents(odd).collect()
    assert len(found) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id and r.doc_id < 5} == dict.fromkeys([1, 2, 3, 4], "und")
    assert langid.identify_documents(empty).count() == 0
    assert langid.keep_known(odd, None).count() == 7


# --- 2 near duplicates --------------------------------------------------------


def brute_components(rows, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # chains of drifting copies, a frequent passage, short texts
    words = [f"w{k}" for k in range(200)]
    for step in range(12):
        words[rng.integers(0, 200)] = f"new{step}"
        rows.append((1000 + step, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(2000 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(40 if k % 2 else 5))) for k in range(60)]
    rows += [(3000 + k, "a b c" if k % 2 else "A  b\tc d") for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_odd(odd, empty):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert Counter((r.n_shingles, r.component_id) for r in rows if r.doc_id == 5) == {(1, 5): 2}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(300)]
    text = lambda a, b, *more: " ".join([*words[a:b], *more])
    rows = [
        (None, text(0, 60)), (None, text(0, 60, "end")), (None, text(70, 100)), (None, text(70, 100)), (None, text(110, 140)), (1, text(110, 140)),
        (2, text(150, 180)), (5, text(150, 180)), (5, text(200, 230)), (7, text(240, 270)), (7, text(240, 270)), (None, ""), (None, "!"), (9, None),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = ngram_join.near_duplicates(frame, classed=True).collect()
    assert len({r.root for r in found if r.root is not None}) == 7 and len(found) == len(rows)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, frame, SF).collect()]
    assert len(kept) == len(set(kept)) == 9
    assert {(None, text(70, 100)), (1, text(110, 140)), (2, text(150, 180)), (5, text(200, 230)), (7, text(240, 270)), (None, ""), (None, "!"), (9, None)} < set(kept)
    assert len({(None, text(0, 60)), (None, text(0, 60, "end"))} & set(kept)) == 1


def test_sets_come_from_the_text_of_the_class(spark):
    near = " ".join(f"x{i}" for i in range(60))
    rows = [(1, near), (1, "one two three four five six"), (1, near), (None, "a b"), (None, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with Tables(spark) as tables:
        sets = [s for s in ngram_join.shingle_sets([t for _, t in rows], 5)]
        marked = [(d, len(s), *ngram_join.signature(s)) for (d, _), s in zip(rows, sets, strict=True)]
        classes = text_classes.classes_of(spark.createDataFrame(marked, "doc_id long, n long, s1 long, s2 long"), tables)
        found = text_classes.sets_of(docs, classes, classes, tables, 5).collect()
    assert sorted(tuple(r.v) for r in found) == sorted({tuple(sorted(s.view(np.int64).tolist())) for s in sets})
    assert len({r.cls for r in found}) == len(found) == 4


def test_prefix_counts_never_lose_a_pair():
    rng = np.random.default_rng(1)
    late = rng.random(1 << ngram_join.SKETCH_BITS) < 0.1
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.unique(base[:n])
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], base[n : n + int(rng.integers(0, 1 + n // 5))]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            for order in range(3):
                common = len(np.intersect1d(ngram_join.prefix(a, late, order), ngram_join.prefix(b, late, order)))
                needed = math.ceil(80 * (len(a) + len(b)) / 180)
                assert ngram_join.enough(80)(np.array([len(a), len(b)]), [ngram_join.prefix(x, late, order) for x in (a, b)])[0, 1]
                assert common >= 1 and common + (80 * max(len(a), len(b)) + 99) // 100 - 1 >= needed


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (105, 103), (7, 7)]
    with Tables(spark) as tables:
        found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), tables).collect()}
        assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 103, 105], 100)}


# --- 3 licenses ---------------------------------------------------------------


def test_base_phrases_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [
        (9001, "MIT License"), (9002, "mit  license,mit-LICENSE x"), (9003, "mit licenses; admit license"), (9004, "émit license apache\nlicense"),
        (9005, "The GNU General Public License mit license\n"), (9006, None), (9007, "KMIT license K general public\x00license"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for i, r in by_id(licenses.scan_licenses(frame)).items():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[i] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = sorted(k for k, _ in places)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), *((starts[0], starts[-1]) if starts else (None, None)))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_rules_brute_force(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "licensed under the GNU Lesser General Public License, version 2.1", "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: BSD-3-Clause", "the Mozilla Public License", "License: ISC", "see https://opensource.org/license/mit and MIT License " * 40,
        "nothing here", "",
    ]
    table = licenses.rules()
    assert len(table) > 300
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, r in by_id(licenses.scan_licenses(frame)).items():
        low = texts[i].lower()
        found = []
        for rule in table:
            gate = re.search(r"licen[cs]e\s*[:=]", low) if rule["keyword"] == "license" else rule["keyword"] in low
            pattern = rule["pattern"].replace(r"\p{L}\p{N}", "a-zA-Z0-9À-ÿ")
            if gate:
                found += [(m.start(), m.end(), rule["priority"], rule["label"]) for m in re.finditer(pattern, texts[i])]
        kept = set()
        for a in found:
            over = [b for b in found if b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and b != a]
            over = [b for b in over if b[:3] != a[:3] or b[3] < a[3]]
            if not over:
                kept.add(a[3])
        assert set(filter(None, r.labels.split(","))) == kept | set(filter(None, r.base_labels.split(","))), texts[i]


def examples(parsed, space):
    """Texts a parsed pattern matches: each branch once, each option with and without, ``space`` for white space."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            kinds = [(str(k), v) for k, v in arg]
            some = [space] if any(v == re._constants.CATEGORY_SPACE for k, v in kinds if k == "CATEGORY") else [chr(v) for k, v in kinds if k == "LITERAL"] or ["1" if kinds[0][0] == "RANGE" else "x"]
        elif op == "SUBPATTERN":
            some = examples(arg[3], space)
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in examples(branch, space)]
        elif op == "MAX_REPEAT":
            some = ([""] if arg[0] == 0 else []) + examples(arg[2], space)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
            some = [""]
        out = [a + b for a in out for b in some]
    return out


def ungated(text):
    """Labels of the rules' matches that no other detection covers, with no keyword and no gate asked for."""
    found = []
    for rule in licenses.rules():
        pattern = rule["pattern"].replace(r"\p{L}\p{N}", "a-zA-Z0-9À-ÿ")
        found += [(m.start(), m.end(), rule["priority"], rule["label"]) for m in re.finditer(pattern, text)]
    covers = lambda b, a: b != a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:3] != a[:3] or b[3] < a[3])
    return {a[3] for a in found if not any(covers(b, a) for b in found)}


def test_license_gates_hold_in_every_match():
    words = licenses.gate_words()
    for rule in licenses.rules():
        parsed = re._parser.parse(rule["pattern"].replace(r"\p{L}\p{N}", "a-zA-Z0-9"))
        for space in (" ", "\n", "\r\n  "):
            for text in examples(parsed, space):
                low = text.lower()
                assert re.search(r"licen[cs]e\s*[:=]", low) if rule["keyword"] == "license" else rule["keyword"] in low, (rule, text)
                assert any(g in low for g in rule["gates"]) and any(w in low for w in words), (rule, text)


def test_license_rules_without_gates(spark):
    texts = [
        "Common\nDevelopment and Distribution License", "SIL Open\nFont License", "released into the public\n domain", "the Business\n  Source License 1.1",
        "the Server\nSide Public License", "the European\nUnion Public Licence", "Universal\tPermissive License", "Open\nDatabase License", "Open\nSoftware License",
        "Public\nDomain Dedication and License", "Open Data\nCommons Attribution License", "all rights\nreserved, proprietary", "do what the f you want\nto public license",
        "Common\nPublic License", "Expat License", "licensed under the X11\nLicense", "Creative Commons Attribution 4.0", "Creative\nCommons\nAttribution", "CC BY 4.0, CC-BY-SA 3.0",
        "http://www.cecill.info/licences", "https://joinup.ec.europa.eu/collection/eupl", "www.elastic.co/licensing/elastic-license", "curl.se/docs/copyright", "unlicense.org", "plain words",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, r in by_id(licenses.scan_licenses(frame)).items():
        assert set(filter(None, r.labels.split(","))) == ungated(texts[i]) | set(filter(None, r.base_labels.split(","))), texts[i]
        assert bool(r.labels) == (texts[i] != "plain words"), texts[i]


def test_licenses_odd(odd, empty):
    assert licenses.scan_licenses(odd).count() == len(ODD)
    assert licenses.scan_licenses(empty).count() == 0


# --- 4 personal data ----------------------------------------------------------


def test_pii(spark):
    text = "a.b@mail.example.com 42.144.35.254 card 4041894974608795 (4041-8949-7460-8795) +1 (988) 555-2485 2000-02-29 31.12.1999 DE89 3704 0044 0532 0130 00"
    keep = "2001-02-29 999.1.1.1 4041894974608796 000-12-3456 v1.2.3.4.5 10-20"
    frame = spark.createDataFrame([(1, text), (2, "x " + text), (3, keep), (4, None), (5, "")], "doc_id int, text string")
    found = by_id(pii.pseudonymise(frame))
    kinds = [p.kind for p in found[1].pii]
    assert kinds == ["email", "ip", "card", "card", "phone", "date", "date", "iban"]
    assert [p.pseudonym for p in found[1].pii] == [p.pseudonym for p in found[2].pii]
    assert found[2].text == "x " + found[1].text and not any(p.value in found[1].text for p in found[1].pii)
    first, second = (p.pseudonym for p in found[1].pii if p.kind == "card")
    assert re.sub(r"\D", "", second) == first and re.fullmatch(r"(\d{4}-){3}\d{4}", second)
    digits = [int(d) for d in reversed(first)]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    iban = next(p.pseudonym for p in found[1].pii if p.kind == "iban").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert found[3].text == keep and (found[4].text, found[5].text) == (None, "")
    assert by_id(pii.pseudonymise(frame, key="other"))[1].text != found[1].text


def test_pii_before_and_after_other_text(spark):
    card, amex, at, be = "4111 1111 1111 1111", "3782 822463 10005", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034"
    gb = "GB82 WEST 1234 5698 7654 32"
    texts = [
        (f"{card} 12/26", [card]), (f"{card} 123", [card]), (f"{card} 1 2 3 4", [card]), (f"12 {card}", [card]), (f"{amex} 1234 x", [amex]), ("4111111111111111 07", ["4111111111111111"]),
        ("4111-1111-1111-1111-2026", ["4111-1111-1111-1111"]), (f"{card} 5555 5555 5555 4444", [card, "5555 5555 5555 4444"]), (f"{at} BIC GIBAATWW", [at]), (f"{be} 2024", [be]),
        (f"{be} {card}", [be, card]), (f"{at} {be} {gb} THE END", [at, be, gb]), (f"REF AT12 {be} OK", [be]), (f"{gb} {card} 2030-01-31", [gb, card, "2030-01-31"]),
        (f"é😀 {be} 2024 😀 {card} 99", [be, card]), ("12/31/1899 and 0001-01-01, 9999-12-31 or 2099-10-05", ["12/31/1899", "0001-01-01", "9999-12-31", "2099-10-05"]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    pseudonyms = defaultdict(set)
    for i, r in by_id(pii.pseudonymise(frame)).items():
        text, values = texts[i]
        assert [p.value for p in r.pii] == values, text
        for p in r.pii:
            assert p.pseudonym != p.value and len(p.pseudonym) == len(p.value)
            text = text.replace(p.value, p.pseudonym)
            pseudonyms[p.value].add(p.pseudonym)
        assert r.text == text
    assert all(len(p) == 1 for p in pseudonyms.values())


def test_pii_dates_are_a_permutation(spark):
    for first, n in (("0001-01-01", 95 * 389), ("9890-04-23", 64 * 626)):
        days = spark.range(n).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
        moved = days.select(pii._date(F.col("d"), "k").alias("p"), "d").cache()
        assert moved.select("p").distinct().count() == n and moved.select("p").exceptAll(days.select("d")).count() == 0, first


def test_feistel_is_a_permutation(spark):
    four = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d")).select(pii.feistel_digits(F.col("d"), "k", "t").alias("p"))
    assert four.distinct().count() == 10_000 and four.filter("length(p) <> 4").count() == 0
    days = spark.range(256 * 285).select(pii.feistel_numbers(F.floor(F.col("id") / 285), F.col("id") % 285, F.lit(256), F.lit(285), "k", "date").alias("p"))
    assert days.distinct().count() == 256 * 285


def test_pii_query_counts_kinds(spark, docs):
    rows = by_id(QUERIES["op4_pii_pseudonyms"](spark, SF))
    found = by_id(pii.pseudonymise(docs))
    assert len(rows) == docs.count() and any(r.n_values for r in rows.values())
    for i, r in rows.items():
        kinds = Counter(p.kind for p in found[i].pii or [])
        assert r.text == found[i].text and {k: r[f"n_{k}"] for k in pii.FORMS} == {k: kinds[k] for k in pii.FORMS}


def test_pii_odd(odd, empty):
    assert pii.pseudonymise(odd).count() == len(ODD) and pii.pseudonymise(empty).count() == 0
    with pytest.raises(ValueError, match="exists"):
        pii.pseudonymise(odd, found="ids")


# --- 5 and 6 tokens -----------------------------------------------------------


def test_bpe_equals_library(docs, odd, empty):
    enc = bpe.encoder()
    for frame in (docs, odd):
        digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(frame).collect())
        expected = Counter()
        for r in frame.collect():
            ids = enc.encode_ordinary(r.text or "")
            expected[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert digests == expected
    back = by_id(bpe.decode_ids(bpe.encode_documents(odd)))
    assert bytes(back[7].bytes).decode() == dict(ODD)[7]
    assert bpe.token_digests(empty).count() == 0


def test_bpe_splits_where_nothing_changes():
    enc = bpe.encoder()
    text = "Ab, c.d  e\n\nf; 中文。x " * 200 + " " * 300 + "'ll 12"
    assert [i for p in bpe.split_safely(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    space = "a b" + " " * 20_000 + "c"
    assert bpe.decode(bpe.encode(space)) == space.encode()


def test_many_values_in_one_text(spark):
    days = [f"{1 + i % 28:02d}.{1 + i % 12:02d}.{1950 + i % 70}" for i in range(4000)]
    frame = spark.createDataFrame([(1, " and ".join(days)), *((2 + i, d) for i, d in enumerate(days[:40]))], "doc_id long, text string")
    found = by_id(pii.pseudonymise(frame))
    values = found[1].pii
    assert [v.value for v in values] == days
    assert found[1].text == " and ".join(v.pseudonym for v in values)
    assert all(found[2 + i].text == values[i].pseudonym for i in range(40))


def test_pages_that_never_close():
    import time

    started = time.perf_counter()
    story = "<p>The main text of a page, long enough to count, ends here.</p>" * 5
    assert html_text.main_text("<p>" + "x<" * 1_000_000) is not None
    assert "main text" in html_text.main_text("<div>" * 30_000 + story + "</section>" * 30_000 + "<li>x" * 30_000)
    assert time.perf_counter() - started < 20


def test_all_of_an_article_in_parts():
    part = lambda n: " ".join(f"Sentence {i} of this part, which goes on for a while." for i in range(n))
    page = f"<body><section><p>{part(14)}</p><p>{part(13)}</p></section><div><p>{part(3)}</p><p>A closing line, at last.</p></div></body>"
    assert html_text.main_text(page).endswith("A closing line, at last.")


def fresh_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER_FILE))


def test_ids_equal_the_library():
    tokenizer = fresh_tokenizer()
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "don't", "'s", "ÀÉ", "ﬁ", "İ", "ß", "e\u0301", "中文", "한국", "a1b22", "...!?", "\x1c", "\x85", "\u00a0", "\u2028", "_a_", "🙂"]
    texts = [f"{a}{gap}{b} x" for a in marks for b in marks for gap in ("", " ", "\t\n")]
    for text, ids in zip(texts, packing.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_packing(docs, odd, empty):
    tokenizer = fresh_tokenizer()
    for frame in (docs, odd):
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        rows = packing.pack(frame).collect()
        assert len({r.sequence_id for r in rows}) == len(rows)
        pieces = defaultdict(list)
        for r in rows:
            assert r.length == len(r.ids) <= 4096 and r.length & (r.length - 1) == 0 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            pieces[r.doc_id].append(r)
        for (i, text), times in texts.items():
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            if sum(n for (j, _), n in texts.items() if j == i) == times == 1:
                own = sorted(pieces[i], key=lambda r: r.start)
                assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack(empty).count() == 0
    assert packing.binary_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    with pytest.raises(ValueError, match="power"):
        packing.pack(odd, largest=100)


# --- 7 pages ------------------------------------------------------------------


def test_page_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    for r in html_text.extract_pages(pages).join(pages, ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_page_clutter(spark):
    page = (
        "<html><head><title>t</title></head><body><div id='top-menu'><a href=x>Home</a></div><div class='cookie-notice'>We use cookies, ok?</div>"
        "<div class=content><h1>Title</h1><p>Hello &amp; world,&nbsp; this\n is <b>long</b>.<p>Second<br>one.<script>x</p></script>"
        "<section id='comments'><p>I hate it, really.</p></section></div><aside><p>Other, things, here.</p></aside><form><p>Name, please.</p></form><footer>(c)"
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>"), (4, "u", "plain &lt; text <"), (5, "u", "<div " + "<" * 50_000)]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "Title\n\nHello & world, this is long.\n\nSecond one." and texts[2] == texts[3] == ""
    assert len(found) == 6


def test_page_names_that_hold_a_clutter_word():
    story = "<p>The first part, told at length; it goes on and on, as stories do.</p><p>The second part, told too; and then, at last, it ends.</p>"
    first, second = "The first part, told at length; it goes on and on, as stories do.", "The second part, told too; and then, at last, it ends."
    whole = f"{first}\n\n{second}"
    nav = "<div class='nav'><a href=x>Home</a></div>"
    for opening in (
        "<div class='content has-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='post with-comments'>", "<section id='discussion'>", "<div data-id='comment-5'>",
        "<div data-hidden='false'>", "<div title='The hidden cost'>", "<div data-class='ad'>", "<article class='post sidebar'>", "<div class='sidebar'><article>",
        "<div id='widget'><main>", "<form id='aspnet'><div><article>", "<div class='sidebar'><div role='main'>", "<div class='widget'>",
    ):
        assert html_text.main_text(f"<html><body>{nav}{opening}{story}") == whole, opening
    for other in (
        "<div class='comments-area'>", "<div id='comment-5'>", "<div class='box cookie-notice'>", "<div class='related-posts'>", "<div class='sidebar'><article>", "<div id=comments><article class=comment>",
        "<div hidden>", "<div role=complementary>", "<div style='display: none'>", "<div class=ad>", "<aside>", "<form>",
    ):
        page = f"<html><body>{nav}<article>{story}</article>{other}<p>Something else, said by someone else; it is not, at all, part of it.</p>"
        assert html_text.main_text(page) == whole, other


# --- 8 toxicity ---------------------------------------------------------------


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.arange(5, dtype=np.uint32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.normal(size=(toxicity.WINDOW, 3, toxicity._INPUT)), np.array([1.0, 0, 1]), np.ones(3)
    mask = (np.arange(toxicity.WINDOW)[:, None] < np.array([32, 20, 1])).astype(float)
    loss, grads, _ = net.gradients(x, mask, y, w)
    for k, grad in grads.items():
        at = tuple(rng.integers(0, d) for d in grad.shape)
        value, out = net.p[k][at], []
        for e in (1e-4, -1e-4):
            net.p[k][at] = value + e
            out.append(net.gradients(x, mask, y, w)[0])
        net.p[k][at] = value
        assert abs((out[0] - out[1]) / 2e-4 - grad[at]) < 1e-5, k


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxic_documents(d, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03


def test_toxicity_windows_and_odd(spark, odd, empty):
    first, size, owner = toxicity.windows_of(np.repeat([0, 2, 3], [1, 100, 33]), 4)
    covered = Counter(w for a, n in zip(first, size, strict=True) for w in range(a, a + n))
    assert set(covered) == set(range(134)) and set(owner) == {0, 2, 3} and max(size) <= toxicity.WINDOW
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxic_documents(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.score < toxicity.THRESHOLD for r in rows)
    assert toxicity.toxic_documents(empty, labels).count() == 0


# --- 9 fingerprints -----------------------------------------------------------


def brute_spots(text):
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        later = [k for k in range(i + 1, len(words)) if words[k] not in anchors][:2]
        if w in anchors and len(later) == 2 and later[0] == i + 1:
            out.add(tuple(words[i : later[1] + 1]))
    return out


def test_spotsigs_brute_force(docs):
    ordered = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    found = by_id(spotsigs.fingerprint_documents(docs))
    alike = lambda a, b: len(a & b) / len(a | b)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        a, b, c = brute_spots(text), brute_spots(other), brute_spots(following)
        if a and b and c:
            assert len(r.fingerprint.split()) == len(a)
            assert abs(r.near_edited - alike(a, b)) < 1e-9 and abs(r.near_next - alike(a, c)) < 1e-9


def test_spotsigs_odd(spark, odd, empty):
    rows = spotsigs.fingerprint_documents(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert spotsigs.fingerprint_documents(empty).count() == 0
    one = spotsigs.fingerprint_documents(odd.filter("doc_id = 6")).first()
    assert one.near_next == 1


def test_spotsigs_pairs(docs):
    sets = docs.select("doc_id", spotsigs.spots(F.col("text")).alias("spots"))
    found = {(r.a, r.b) for r in spotsigs.near_pairs(sets).collect()}
    first = {}
    for r in sorted(sets.collect()):
        first.setdefault(tuple(r.spots), r.doc_id)
    items = [(i, set(s)) for s, i in first.items() if s]
    assert found == {(min(i, j), max(i, j)) for k, (i, a) in enumerate(items) for j, b in items[k + 1 :] if len(a & b) >= 0.8 * len(a | b)}


# --- 10 search ----------------------------------------------------------------


def test_search_brute_force(monkeypatch, docs):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 20)
    monkeypatch.setattr(bm25, "FIRST", 3)
    rows = docs.collect()
    counts = {r.doc_id: Counter(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in rows}
    n, lengths = len(rows), {i: sum(c.values()) for i, c in counts.items()}
    mean = sum(lengths.values()) / n
    df = Counter(t for c in counts.values() for t in c)
    found = defaultdict(list)
    for r in sorted(bm25.top_k(docs.repartition(3), docs.filter("doc_id % 20 = 0"), 7).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.doc_id, r.score))
    for q in (i for i in counts if i % 20 == 0):
        scores = {}
        for i, c in counts.items():
            terms = [t for t in counts[q] if t in c]
            if terms:
                scores[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for t in terms)
        best = sorted(scores.values(), reverse=True)[:7]
        assert np.allclose([s for _, s in found[q]], best, atol=1e-9)
        assert all(abs(scores[i] - s) < 1e-9 for i, s in found[q])


def test_search_repeated_rows(spark):
    rows = [(100, "a b c"), (100, "a b c"), (100, "b z"), (1, "a x"), (2, "a x"), (3, "c")]
    found = bm25.top_k(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[:3], "doc_id long, text string"), 4).collect()
    once = bm25.top_k(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[:1], "doc_id long, text string"), 4).collect()
    # one query for an id, its repeated rows are each found, equal scores go to the smaller id
    assert [tuple(r) for r in sorted(found)] == [tuple(r) for r in sorted(once)]
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"])] == [100, 100, 3, 100]


def test_search_odd(odd, empty):
    rows = bm25.top_k(odd, odd.filter("doc_id in (2, 6)")).collect()
    assert {r.query_id for r in rows} == {6} and all(r.doc_id is not None for r in rows)
    assert bm25.top_k(empty, empty).count() == 0 and bm25.top_k(odd, empty).count() == 0


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == corpus_pipeline.COLUMNS
        rows = by_id(kept)
        assert set(rows) <= before and len(rows) == kept.count(), name
        if name == "toxicity":
            toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
            assert len(before - set(rows) - toxic) <= 0.03 * len(before)
        if name == "language":
            assert set(rows) == before
        if name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in before])
            assert set(rows) == {i for i, (_, c) in groups.items() if i == c}
        if name == "pii":
            assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in rows.values())
    packed = corpus_pipeline.packing_stage(spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_odd(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, odd, SF).count() > 0, name


def test_common_terms_are_scored_by_a_matrix_and_summed_anew():
    rng = np.random.default_rng(4)
    # 300 documents in three blocks: common terms, rare ones, an exact copy, one without asked terms
    words = [np.unique(np.concatenate([rng.integers(0, 12, 9), rng.integers(12, 900, 20)])) for _ in range(300)]
    words[7], words[200] = words[250], np.zeros(0, np.int64)
    hashes = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 900))
    terms = [np.sort(hashes[w].view(np.uint64)) for w in words]
    owner, term = np.repeat(np.arange(300, dtype=np.int32), [len(t) for t in terms]), np.concatenate(terms)
    count, lengths, ids = rng.integers(1, 4, len(term)).astype(np.int32), rng.integers(20, 60, 300).astype(np.int32), rng.permutation(300)
    same = [np.flatnonzero(owner == d) for d in (7, 250)]
    count[same[0]], lengths[7] = count[same[1]], lengths[250]
    asked = hashes[::2]
    shard = bm25.Shard(ids, owner, term, count, lengths, 40.0, asked)
    assert 3 <= len(shard.common) < 40 and shard.blocks == 3
    queries = [np.unique(np.concatenate([rng.integers(0, 6, 4), rng.integers(6, len(asked), 30)])) for _ in range(40)]
    weights = [rng.random(len(q)) for q in queries]
    impact = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * lengths[owner] / 40.0))
    edge, known = np.cumsum([0, *map(len, queries)]), np.zeros(40)
    for _ in range(2):
        found = {q: (places, scores) for q, places, scores in shard.search(edge, np.concatenate(queries), np.concatenate(weights), 5, known)}
        for q, (own, weight) in enumerate(zip(queries, weights, strict=True)):
            idf = dict(zip(asked[own].tolist(), weight.tolist(), strict=True))
            scores = np.bincount(owner, impact * [idf.get(t, 0.0) for t in term.view(np.int64).tolist()], 300)
            best = sorted(np.flatnonzero(scores > 0), key=lambda d: (-round(scores[d], 9), ids[d]))[:5]
            assert found[q][0].tolist() == best
            assert found[q][1] == pytest.approx(scores[best])
            known[q] = found[q][1][-1] * (1 - 1e-9)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and len(QUERIES) == 10
