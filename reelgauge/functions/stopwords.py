"""Stopword sets: Spark's own language lists plus words given by the caller."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterable

from pyspark.find_spark_home import _find_spark_home
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession

# Filler words of Portuguese video talk added to the language list.
VIDEO_TALK = """
de da do das dos em no na nos nas querer algum live tá dá
ele ela eles elas esse essa isso este esta isto carar pra ver olhada
aí aqui lá ali hoje dia gente mulher homem vez vezes senhor senhora
vida alto ser estar ter fazer ir vir falar dizer acontecer ceu céu amor
canal entrar like dislike rede social feedback comentário ebook grátis
importante inscrever inscritar link cara book mandar mensagem parada seguinte
pessoa ativar notificação notificações clique tocar assunto descrição baixar outro
achar brother beleza irmão entender rapaziar querido enfim aproveitar clicar chat
cupom hein trocar ideia música musica embaixo abraço caixinha galera nenhum afinal
deixar tornar and the you with thi this your yours that are know for just
when where who what why how all not women woman man men one have out
olhar mano manos
""".split()

LANGUAGES = {
    "pt": "portuguese",
    "en": "english",
    "fr": "french",
    "de": "german",
    "es": "spanish",
}


def _without_session(language: str) -> list[str]:
    """The same list read from the installed Spark, for use before a session exists."""
    jars = os.path.join(_find_spark_home(), "jars", "spark-mllib_*.jar")
    with zipfile.ZipFile(sorted(glob.glob(jars))[-1]) as jar:
        entry = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
        return jar.read(entry).decode("utf-8").splitlines()


def language_list(lang: str) -> list[str]:
    """Spark's default list of a language given by its two-letter code."""
    if SparkSession.getActiveSession() is None:
        words = _without_session(LANGUAGES[lang])
    else:
        words = StopWordsRemover.loadDefaultStopWords(LANGUAGES[lang])
    return sorted(set(words))


def stopword_set(
    langs: Iterable[str] = ("pt",), extra: Iterable[str] = VIDEO_TALK
) -> list[str]:
    """Distinct union of the language lists and the extra words, lower-cased."""
    words = {w for lang in langs for w in language_list(lang)}
    return sorted(words | {w.lower() for w in extra})


def stopword_table(spark: SparkSession, langs: Iterable[str]) -> DataFrame:
    """One row per language and word, for stopwords kept as data."""
    rows = [(lang, word) for lang in langs for word in language_list(lang)]
    return spark.createDataFrame(rows, "lang string, word string")


def union_tables(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Distinct union of two stopword tables with a ``word`` column."""
    return base.select("word").unionByName(extra.select("word")).distinct()
