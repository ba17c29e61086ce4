"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers that pass their own check (cards, bank accounts, addresses of machines, phone
and social security numbers) and dates are permuted by a keyed Feistel network inside
their format, so one value has one pseudonym in every document, and two values never
share one.  Names in mail addresses and secrets get a keyed digest of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of the permutations where a caller hands in none; a deployment hands in its own.
DEFAULT_KEY = "pseudonym-key-0"
#: Rounds of the Feistel network.
ROUNDS = 8

_B, _A = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Written forms of each kind, tried in this order at each place.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": rf"{_B}(?:AKIA[0-9A-Z]{{16}}{_A}|(?i:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?\"?[A-Za-z0-9+/_-]{{8,}}+\"?)",
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "date": rf"{_B}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}){_A}(?!-\d)",
    "ssn": rf"(?<![\p{{L}}\p{{N}}-])\d{{3}}-\d{{2}}-\d{{4}}{_A}(?!-\d)",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}){_A}",
    "iban": rf"{_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_A}",
    "card": rf"(?<![\p{{L}}\p{{N}}.-])(?:\d(?:[ -]?\d){{12,18}}{_A}(?!-\d)|\d{{4}}(?:-\d{{4}}){{3}}{_A})",
}
#: Days permuted among each other: blocks of 256 times 285 counted from 1900-01-01, and what
#: is left of the years 1 to 9999 before (95 times 389) and after (64 times 626) whole blocks.
FIRST_DAY, DATE_RADIX = "1900-01-01", (256, 285)
EARLY_DAYS, EARLY_RADIX = -693_595, (95, 389)
LATE_DAYS, LATE_RADIX = 2_918_400, (64, 626)
#: Length of a bank account by country; others are tried at every length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _power(digits: Column) -> Column:
    return F.rpad(F.lit("1"), digits + 1, "0").cast("long")


def _keyed(key: str, tweak: str, turn: Column, value: Column) -> Column:
    """60 bits that depend on all four."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_numbers(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """Permute the pairs (left < a, right < b): struct(left, right)."""

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, (acc["left"] + _keyed(key, tweak, turn, acc["right"]) % a) % a).otherwise(acc["left"]).alias("left"),
            F.when(even, acc["right"]).otherwise((acc["right"] + _keyed(key, tweak, turn, acc["left"]) % b) % b).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permute the digit strings of one length (2 to 34 digits, by halves of up to 17)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)

    def padded(pair: Column) -> Column:
        return F.concat(F.lpad(pair["left"].cast("string"), half, "0"), F.lpad(pair["right"].cast("string"), rest, "0"))

    # one element, so that the permuted pair is computed once
    pair = feistel_numbers(left, right, _power(half), _power(rest), key, tweak)
    return F.get(F.transform(F.array(pair), padded), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _put_back(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    def character(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.substring(form, F.lit(1), i + 1)))
        return F.when(c.rlike(r"^\d$"), F.substring(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), character), "")


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Sum of the checksum, from the right; ``doubled_first``: the last digit counts twice."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == (0 if doubled_first else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of a bank account's letters and digits, letters counting from 10."""
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever ``use`` does with it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prefixes(hit: Column, least: int) -> Column:
    """The prefixes of ``hit`` that end with a whole group of letters and digits, longest first."""
    size = F.length(hit)
    ends = F.filter(
        F.sequence(size, F.least(F.lit(least), size), F.lit(-1)),
        lambda n: F.substring(hit, n, F.lit(1)).rlike("[A-Z0-9]") & ~F.substring(hit, n + 1, F.lit(1)).rlike("[A-Z0-9]"),
    )
    return F.transform(ends, lambda n: F.substring(hit, F.lit(1), n))


def _card_in(hit: Column) -> Column:
    """The card that ``hit`` is or starts with; null without one.

    A card of an issuer with one length has that length, whatever digits follow; then come
    the whole hit, and the lengths other issuers use, longest first.
    """
    own = r"^(?:4\d{15}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13})$"
    other = r"^(?:4(?:\d{12}|\d{18})|3[0689]\d{12,17}|35\d{14,17}|(?:5[0678]|6\d)\d{11,17})$"

    def rank(p: Column) -> Column:
        return _once(_digits(p), lambda d: F.when(
            d.rlike(r"^\d{13,19}$") & (_luhn_sum(d, False) % 10 == 0),
            F.when(d.rlike(own), 0).when(p == hit, 1).when(d.rlike(other), 2),
        ))

    return _first(_prefixes(hit, 13), rank)


def _iban_in(hit: Column) -> Column:
    """The bank account that ``hit`` is or starts with, of its country's length at first; null without one."""
    own = "^(?:" + "|".join(rf"(?:{names.replace(' ', '|')}).{{{n - 2}}}" for n, names in IBAN_LENGTHS.items()) + ")$"
    known = f"^(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})"

    def rank(p: Column) -> Column:
        return _once(F.replace(p, F.lit(" "), F.lit("")), lambda s: F.when(
            _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))) == 1,
            F.when(s.rlike(own), 0).when(p == hit, 1).when(~s.rlike(known), 2),
        ))

    return _first(_prefixes(hit, 12), rank)


def _first(values: Column, rank) -> Column:
    """The first of the values of the lowest rank; null ranks do not count."""
    ranked = F.transform(values, lambda v, i: F.struct(rank(v).alias("rank"), i.alias("place"), v.alias("value")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["value"]


def _card(hit: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = feistel_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        check = lambda b: F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string"))
        return F.when(_luhn_sum(d, False) % 10 == 0, _once(body, lambda b: _put_back(hit, _once(b, check))))

    return _once(_digits(hit), made)


def _ip(hit: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        n = [F.get(parts, F.lit(i)) for i in range(4)]
        pair = feistel_numbers(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
        text = lambda p: F.concat_ws(".", *(x.cast("string") for h in ("left", "right") for x in (F.floor(p[h] / 256), p[h] % 256)))
        return F.when(F.forall(parts, lambda x: x <= 255), _once(pair, text))

    return _once(F.transform(F.split(hit, r"\."), lambda x: x.cast("int")), made)


def _date(hit: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        first, second, third = (F.get(p, F.lit(i)) for i in range(3))
        year_first = F.length(first) == 4
        # day before month, unless the second number can only be a day
        month_first = ~year_first & hit.contains("/") & (second.cast("int") > 12)
        mark = F.regexp_extract(hit, r"[-./]", 0)
        n = F.struct(
            F.when(year_first, first).otherwise(third).cast("int").alias("y"),
            F.when(year_first, second).when(month_first, first).otherwise(second).cast("int").alias("m"),
            F.when(year_first, third).when(month_first, second).otherwise(first).cast("int").alias("d"),
        )

        def moved(v: Column) -> Column:
            y, m, d = v["y"], v["m"], v["d"]
            leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
            last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
            valid = m.between(1, 12) & d.between(1, last) & (y >= 1)
            days = F.datediff(F.make_date(y, m, d), F.to_date(F.lit(FIRST_DAY)))
            size = DATE_RADIX[0] * DATE_RADIX[1]
            # no whole block starts before day EARLY_DAYS + 95 * 389
            early, late = EARLY_DAYS + EARLY_RADIX[0] * EARLY_RADIX[1], LATE_DAYS

            def block(n: Column) -> Column:
                """The day its block starts with, the day's place in it, and the block's radices."""
                radix = lambda i: F.when(n < early, EARLY_RADIX[i]).when(n >= late, LATE_RADIX[i]).otherwise(DATE_RADIX[i])
                start = F.when(n < early, EARLY_DAYS).otherwise(F.floor(n / size) * size)
                return F.struct(start.alias("start"), (n - start).alias("n"), radix(0).alias("a"), radix(1).alias("b"))

            def back(k: Column) -> Column:
                pair = feistel_numbers(F.floor(k["n"] / k["b"]), k["n"] % k["b"], k["a"], k["b"], key, "date")
                return _once(pair, lambda q: F.date_add(F.to_date(F.lit(FIRST_DAY)), (k["start"] + q["left"] * k["b"] + q["right"]).cast("int")))

            def written(day: Column) -> Column:
                short = F.length(first) + F.length(second) < 4
                two = lambda x: F.when(short & ~year_first, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
                yy, mm, dd = F.lpad(F.year(day).cast("string"), 4, "0"), two(F.month(day)), two(F.day(day))
                return (
                    F.when(year_first, F.concat_ws("|", yy, mm, dd))
                    .when(month_first, F.concat_ws("|", mm, dd, yy))
                    .otherwise(F.concat_ws("|", dd, mm, yy))
                )

            result = _once(_once(_once(days, block), back), written)
            return F.when(valid, F.replace(result, F.lit("|"), mark))

        return _once(n, moved)

    return _once(F.split(hit, r"[-./]"), made)


def _ssn(hit: Column, key: str) -> Column:
    valid = ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, _once(_digits(hit), lambda d: _put_back(hit, feistel_digits(d, key, "ssn"))))


def _phone(hit: Column, key: str) -> Column:
    """The country code stays; the digits after it are permuted."""
    def made(head: Column) -> Column:
        tail = F.substring(hit, F.length(head) + 1, F.length(hit))
        return _once(tail, lambda t: F.when(
            F.length(_digits(t)).between(6, 17),
            F.concat(head, _put_back(t, feistel_digits(_digits(t), key, "phone"))),
        ))

    return _once(F.regexp_extract(hit, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 0), made)


def _iban(hit: Column, key: str) -> Column:
    def made(s: Column) -> Column:
        country, body = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s))
        valid = (_mod97(F.concat(body, F.substring(s, F.lit(1), F.lit(4)))) == 1) & F.length(_digits(body)).between(2, 34)
        moved = _put_back(body, feistel_digits(_digits(body), key, "iban"))
        check = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        spaced = lambda r: F.when(hit.contains(" "), F.rtrim(F.regexp_replace(r, "(.{4})", "$1 "))).otherwise(r)
        return F.when(valid, _once(_once(moved, check), spaced))

    return _once(F.replace(hit, F.lit(" "), F.lit("")), made)


def _email(hit: Column, key: str) -> Column:
    host = F.substring_index(hit, "@", -1)
    digest = lambda x, tweak, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), F.lower(x)), 256), 1, n)
    return F.concat(
        F.lit("u"), digest(hit, "name", 16), F.lit("@h"), digest(host, "host", 12), F.lit("."), F.substring_index(host, ".", -1)
    )


def _secret(hit: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.regexp_extract(hit, r"([A-Za-z0-9+/_-]{8,})\"?$", 1)), 256)
    return F.when(hit.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16)))).otherwise(
        F.concat(
            F.regexp_extract(hit, r"^[^=:]+[=:]\s?\"?", 0), F.substring(digest, 1, 32),
            F.when(hit.endswith('"'), '"').otherwise(""),
        )
    )


_MAKE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


#: Places of a text whose pieces are put together at once.
CHUNK = 256

#: What a hit that may run on into other text is cut to.
_CUT = {"iban": _iban_in, "card": _card_in}


def _replaced(hit: Column, key: str) -> Column:
    """struct(kind, value, pseudonym) of the value that ``hit`` starts with; null where no check passes."""
    def made(kind: str, make) -> Column:
        value = F.when(hit.rlike(rf"\A(?:{FORMS[kind]})\z"), _CUT.get(kind, lambda h: h)(hit))
        return _once(value, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.when(v.isNotNull(), make(v, key)).alias("pseudonym")))

    tried = F.array(*(made(kind, make) for kind, make in _MAKE.items()))
    return F.get(F.filter(tried, lambda x: x["pseudonym"].isNotNull()), F.lit(0))


def _pieces(parts: Column, values: Column) -> Column:
    """The text in order: array of struct(kind, value, pseudonym), the last null for what stays.

    ``parts`` is the text cut where a hit starts, ``values`` what ``_replaced`` found at those
    places.  A value covers the places inside it; those of a failed hit are open.
    """
    shape = "array<struct<kind: string, value: string, pseudonym: string>>"
    plain = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"), F.lit(None).cast("string").alias("pseudonym"))

    def step(acc: Column, x: Column) -> Column:
        part, found, covered = x["part"], x["found"], acc["covered"]
        taken = F.when((covered == 0) & found.isNotNull(), found)
        ahead = _once(taken, lambda v: F.when(v.isNotNull(), F.length(v["value"])).otherwise(covered))
        rest = plain(F.substring(part, ahead + 1, F.length(part)))
        return F.struct(
            F.greatest(ahead - F.length(part), F.lit(0)).alias("covered"),
            F.concat(acc["out"], F.filter(F.array(taken, rest), lambda v: v.isNotNull() & (v["value"] != ""))).alias("out"),
        )

    def joined(own: Column) -> Column:
        # without a hit at the very start, the first part is before all hits
        lead = F.size(own) - F.size(values)
        return F.transform(own, lambda p, i: F.struct(p.alias("part"), F.get(values, i - lead).alias("found")))

    def in_chunks(pairs: Column) -> Column:
        # an array that grows is copied at each step, so it grows by chunks of short ones
        chunks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK)), lambda at: F.slice(pairs, at, CHUNK))

        def more(acc: Column, chunk: Column) -> Column:
            start = F.struct(acc["covered"].alias("covered"), F.array().cast(shape).alias("out"))
            grown = lambda x: F.struct(x["covered"].alias("covered"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
            return _once(F.aggregate(chunk, start, step), grown)

        none = F.struct(F.lit(0).alias("covered"), F.array().cast(f"array<{shape}>").alias("out"))
        return F.aggregate(chunks, none, more, lambda acc: F.flatten(acc["out"]))

    # bound once each: what stands inside a lambda is computed for every element
    return _once(_once(parts, joined), in_chunks)


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", found: str = "pii") -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten and an array column ``found``.

    ``found`` holds struct(kind, value, pseudonym) of every replaced value in text order.
    Null texts stay null and empty ones empty, both with an empty ``found``; values that
    fail their check stay as they are, and values inside or behind them are still found;
    dates of the years 1 to 9999 count; repeated rows are treated alike.  A column already
    called ``found`` is an error.  No row moves.
    """
    if found in docs.columns:
        raise ValueError(f"column {found} exists; name another one")
    t = F.col(text)
    # every place where a form matches is looked at, also those inside another hit
    any_form = f"(?=({'|'.join(FORMS.values())}))"
    shape = "array<struct<kind: string, value: string, pseudonym: string>>"
    hits = F.when(
        t.rlike(r"@|\d\D?\d|AKIA|[=:]\s?\"?[A-Za-z0-9+/_-]{8}"),
        F.transform(F.regexp_extract_all(t, F.lit(any_form), F.lit(1)), lambda h: _replaced(h, key)),
    ).otherwise(F.array().cast(shape))
    out = docs.withColumn("__pii_hits", hits)
    some = F.exists("__pii_hits", lambda x: x.isNotNull())
    out = out.withColumn("__pii_pieces", F.when(some, _pieces(F.split(t, any_form, -1), F.col("__pii_hits"))).otherwise(F.array().cast(shape)))
    rewritten = F.array_join(F.transform("__pii_pieces", lambda x: F.coalesce(x["pseudonym"], x["value"])), "")
    return out.select(
        *(F.when(F.size("__pii_pieces") > 0, rewritten).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns),
        F.filter("__pii_pieces", lambda x: x["pseudonym"].isNotNull()).alias(found),
    )
