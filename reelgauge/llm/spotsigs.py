"""SpotSigs fingerprints: chains of content words behind common-word anchors.

DataFrame functions only.  A fingerprint is the set of hashed chains of a text; sets are
compared by their Jaccard similarity, partitioned by size and pruned by prefixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Common words of English, German, French and Spanish that anchor a chain.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht sich und von zu auf für "
    "au dans de des du en est et la le les par pas pour que qui sur un une "
    "al como con del el las los no para por se su y"
).split()
_MARK = "\u0001"


def _normal(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _by_letter(words: list[str]) -> str:
    """Pattern of the words, tried letter by letter instead of word by word."""
    if words == [""]:
        return ""
    heads = sorted({w[0] for w in words if w})
    tails = "|".join(h + _by_letter([w[1:] for w in words if w[:1] == h]) for h in heads)
    return f"(?:{tails})" + "?" * ("" in words)


def spots(text: Column) -> Column:
    """Distinct hashed chains of a text, sorted: array<int>.

    A run of anchors counts as its last one.  The chain is that anchor, the two content
    words after it and the anchors between them.  A text without a chain is hashed whole;
    an empty or null one has no element.
    """
    # anchors lose the space before them, so what lies between spaces starts with a content word;
    # no group repeats, as that would take stack in proportion to a text
    marked = F.regexp_replace(_normal(text), f" ({_by_letter(sorted(set(ANCHORS)))})(?= )", f"{_MARK}$1")
    word = f"[^ {_MARK}]+"
    chains = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?=({word} {word}(?:{_MARK}[^ ]*)? {word}))"), F.lit(1))
    hashed = F.transform(F.array_distinct(chains), lambda c: F.hash(c))
    whole = F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    # one element, so that the chains are computed once
    return F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, F.sort_array(F.array_distinct(h))).otherwise(whole)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike, an empty one is like no other."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.get(F.transform(F.array(both), lambda n: n / (either - n)), F.lit(0)))
    )


def written(spot_set: Column) -> Column:
    """A fingerprint as text: its hashes in hexadecimal, in order."""
    unsigned = lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(spot_set, unsigned), " ")


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above ``value``, in two short searches."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    below = lambda array: F.size(F.filter(array, lambda b: b <= value))
    coarse = F.array(*(F.lit(b) for b in bounds[::width]))
    fine = F.array(*(F.lit(b) for b in bounds))
    block = F.greatest(below(coarse) - 1, F.lit(0))
    return F.get(F.transform(F.array(block), lambda k: k * width + below(F.slice(fine, k * width + 1, F.lit(width)))), F.lit(0))


def with_next(docs: DataFrame, columns: dict[str, str], order: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Add to each row columns of the next one by descending ``order``; the last meets the first.

    ``columns`` maps new names to existing ones.  Rows are dealt by ranges of ``order``
    (bounded by approximate quantiles, so ranges hold alike many rows) and a window
    finds the next row inside a range; the first row of a range is copied to the range
    before it.  Null keys come last; equal keys follow each other by the mapped columns.
    Only the bounds and one key per range reach the driver.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(order, shares, 20 * parts)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    docs = docs.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(_place(F.col(order), bounds)))
    top = {r[0]: r[1] for r in docs.groupBy("__range").agg(F.max(order)).collect()}
    if not top:
        return docs.drop("__range").select("*", *(F.col(c).alias(n) for n, c in columns.items()))
    filled = sorted(top)
    # the first row of each range also ends the next higher one; the very first ends the lowest
    goes_to = dict(zip(filled, [*filled[1:], filled[0]], strict=True))
    at = F.col("__range") + 2
    tops = F.array(*(F.lit(top.get(k)).cast(docs.schema[order].dataType) for k in range(-1, filled[-1] + 1)))
    targets = F.array(*(F.lit(goes_to.get(k, 0)) for k in range(-1, filled[-1] + 1)))
    first = F.col(order).eqNullSafe(F.element_at(tops, at))
    row = lambda r, copy: F.struct(r.cast("int").alias("r"), F.lit(copy).alias("copy"))
    own = row(F.col("__range"), 0)
    dealt = docs.withColumn("__at", F.explode(F.when(first, F.array(own, row(F.element_at(targets, at), 1))).otherwise(F.array(own))))
    dealt = dealt.withColumn("__range", F.col("__at.r")).withColumn("__copy", F.col("__at.copy")).drop("__at")
    following = Window.partitionBy("__range").orderBy("__copy", F.desc_nulls_last(order), *columns.values())
    dealt = dealt.select("*", *(F.lead(c).over(following).alias(n) for n, c in columns.items()))
    return dealt.filter("__copy = 0").drop("__range", "__copy")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses, for every row.

    Null texts count as empty; the next row is by descending doc_id (null ids last, equal
    ids by their texts); a single row is its own next.  Other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("spots", spots(F.col("text")))
    out = with_next(base, {"next_text": "text", "next_spots": "spots"})
    out = out.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_spots", spots(F.col("edited")))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("spots")).alias("fingerprint"),
        written(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def near_pairs(sets: DataFrame, threshold: float = 0.8, key: str = "doc_id", spot_set: str = "spots") -> DataFrame:
    """Pairs of different sets at least ``threshold`` alike: a, b (smallest keys), likeness.

    Equal sets count once.  Sets meet only inside neighbouring size classes (a class spans
    one factor ``1/threshold``), through a shared element of their prefixes in hash order,
    and only where their sizes allow the threshold.  Empty sets have no pairs.
    """
    s = F.col(spot_set)
    one = sets.filter(F.size(s) > 0).groupBy(s.alias("spots")).agg(F.min(key).alias("key"))
    n = F.size("spots")
    kind = F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9)
    prefix = n - F.ceil(n * threshold - 1e-9) + 1
    index = one.select("key", "spots", n.alias("n"), kind.alias("kind"), F.explode(F.slice("spots", F.lit(1), prefix.cast("int"))).alias("spot"))
    a = index.select(F.col("key").alias("a"), F.col("n").alias("na"), "kind", "spot")
    b = index.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("kind"), F.col("kind") - 1)).alias("kind"), "spot")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    pairs = a.join(b, ["kind", "spot"]).filter((F.col("a") != F.col("b")) & (small >= threshold * large - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.join(one.select(F.col("key").alias("a"), F.col("spots").alias("sa")), "a")
    found = found.join(one.select(F.col("key").alias("b"), F.col("spots").alias("sb")), "b")
    return found.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)
