"""Text, time and status functions on hand-written rows."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from reelgauge.functions import clock, status
from reelgauge.functions import text as X
from reelgauge.functions.stopwords import VIDEO_TALK, stopword_set
from reelgauge.plans import export


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("sim,nao casa/carro", ["sim", "nao", "casa", "carro"]),
        ("a,b,c: d<e>f=g", ["a", "b", "c", "d", "e", "f", "g"]),
        ("guarda-chuva 3,5 (olá)", ["guarda-chuva", "3,5", "olá"]),
    ],
)
def test_word_pieces(spark, text, pieces):
    assert one(spark, text, X.word_pieces) == pieces


@pytest.mark.parametrize(
    "text, cleaned",
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("[00:10] Oi\n[01:02:33] Tudo bem", "oi tudo bem"),
        ("[100:05] fica", "[100:05] fica"),
        ("9:59 fica", "9:59 fica"),
        ("veja https://a.b/c?d=1", "veja"),
        ("veja www.a.b/c agora", "veja agora"),
        ("[Música] Ação", "[música] ação"),
        ("a b\r\nc", "a b c"),
    ],
)
def test_clean_basic(spark, text, cleaned):
    assert one(spark, text, X.clean_basic) == cleaned


@pytest.mark.parametrize(
    "text, cleaned",
    [
        (None, ""),
        ("[00:10]Oi 9:59 e 1:02:33 Fim", "Oi e Fim"),
        ("às 9:59h", "às 9:59h"),
        ("é9:59 x", "é9:59 x"),
        ("Mantém A CAIXA\nalta", "Mantém A CAIXA alta"),
    ],
)
def test_clean_export(spark, text, cleaned):
    assert one(spark, text, X.clean_export) == cleaned


@pytest.mark.parametrize("text, blank", [("", True), (" \n ", True), (" a ", False)])
def test_blank(spark, text, blank):
    assert one(spark, text, X.is_blank) is blank


def test_words_and_stopwords(spark):
    stop = ["não", "de"]
    assert one(spark, "Não há  DE facto", lambda c: X.remove_stopwords(c, stop)) == "há facto"
    strict = one(spark, "[Não] 12 casa2 DE", lambda c: X.remove_stopwords_strict(c, stop))
    assert strict == "casa"
    assert one(spark, "de não", lambda c: X.remove_stopwords(c, stop)) == ""


def test_tokens(spark):
    text = "Ação, d'água e_9 x 42 çé-ab"
    expected = re.findall(r"(?u)\b\w\w+\b", text.lower())
    assert one(spark, text, X.tokenize) == expected


def test_bigrams(spark):
    kind = "array<string>"
    assert one(spark, ["a", "b", "c"], X.bigrams, kind) == ["a b", "b c"]
    assert one(spark, ["a"], X.bigrams, kind) == []
    assert one(spark, [], X.bigrams, kind) == []
    closed = one(spark, "casa de praia", lambda c: X.bigrams(X.content_tokens(c, ["de"])))
    assert closed == ["casa praia"]
    raw = one(
        spark,
        "casa de praia bela",
        lambda c: X.bigrams_without_stopwords(X.tokenize(c), ["de"]),
    )
    assert raw == ["praia bela"]


def test_strip_accents(spark):
    letters = "".join(map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])) + "ﬁﬂaé漢"
    plain = unicodedata.normalize("NFKD", letters).encode("ascii", "ignore").decode()
    assert one(spark, letters, X.strip_accents) == plain


def test_content_lemmas(spark):
    stop = ["acao", "porque"]
    kept = one(
        spark,
        ["Ação", "de", "Casa", "PORQUE", "céu"],
        lambda c: export.content_lemmas(c, stop),
        "array<string>",
    )
    assert kept == ["casa", "céu"]


def test_names(spark):
    assert one(spark, "A b/C", X.safe_name) == "A_b-C"
    assert one(spark, "x" * 300, X.excerpt) == "x" * 200 + "..."
    assert one(spark, "abc", X.excerpt) == "abc..."
    assert one(spark, 1234567.9, X.thousands, "double") == "1,234,567"


def test_stopword_set():
    words = stopword_set(("pt",), VIDEO_TALK)
    assert {"amor", "canal", "de", "não"} <= set(words)
    assert len(words) == len(set(words))


@pytest.mark.parametrize(
    "seconds, short, long",
    [
        (0.0, "00:00", "00:00:00"),
        (59.99, "00:59", "00:00:59"),
        (6005.2, "100:05", "01:40:05"),
        (363600.0, "6060:00", "101:00:00"),
    ],
)
def test_durations(spark, seconds, short, long):
    assert one(spark, seconds, clock.minutes_seconds, "double") == short
    assert one(spark, seconds, clock.hours_minutes_seconds, "double") == long


@pytest.mark.parametrize(
    "text, stamped",
    [
        ("2022-11-01 05:06:07", "2022-11-01 05:06:07"),
        ("2022-11-01T05:06:07Z", "2022-11-01 05:06:07"),
        ("N/A", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, stamped):
    assert one(spark, text, lambda c: clock.stamp(clock.parse_timestamp(c))) == stamped


def test_transcript_text(spark):
    rows = [(6005.0, "uma\nduas"), (1.5, "fim")]
    text = one(spark, rows, clock.transcript_text, "array<struct<start:double,text:string>>")
    assert text == "[100:05] uma duas\n[00:01] fim"


def test_status_ladders(spark):
    removed = "This was removed: unavailable"
    assert one(spark, removed, status.precheck_status)["status"] == status.REMOVED
    assert one(spark, removed, status.fetch_status)["status"] == status.UNAVAILABLE
    odd = one(spark, "Odd", status.fetch_status)
    assert (odd["status"], odd["language"]) == ("ERROR: Odd", "error")
    assert one(spark, "Odd", status.precheck_status)["status"] == "VIDEO_UNAVAILABLE: Odd"
    both = one(spark, "Private and deleted", status.fetch_status)
    assert both["status"] == status.PRIVATE
    assert one(spark, "IP block", status.may_have_transcript) is True
    assert one(spark, "Video unavailable", status.may_have_transcript) is False
