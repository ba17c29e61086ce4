"""License scan with ordered signature rules, in DataFrame functions only.

Some three hundred rules, each a regular expression with a priority, are tried behind
keywords that all their matches hold.  Detections are intervals of the text; one that lies inside a detection of
no lower priority is suppressed, and the labels of the rest are reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three phrases every scan reports, by their words.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Signatures: label, keyword (one word in lower case that every match of the name holds, so
# that line breaks inside a name do not matter), pattern of the name, pattern of its short
# identifiers, pattern of its address (or ""); names with nothing in common have a row each.
SIGNATURES = [
    ("mit", "mit", r"MIT", r"MIT", r"opensource\.org/licenses?/mit"),
    ("mit", "expat", r"Expat", r"", r""),
    ("mit", "x11", r"X11", r"", r""),
    ("mit-0", "mit", r"MIT[ -]+(?:No[ -]+Attribution|Zero)", r"MIT-0", r"opensource\.org/licenses?/mit-0"),
    ("apache", "apache", r"Apache(?:\s+Software)?", r"Apache", r"apache\.org/licenses/?"),
    ("apache-1.1", "apache", r"Apache(?:\s+Software)?\s+License,?\s+(?:Version|v\.?)\s*1\.1", r"Apache-1\.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("apache-2.0", "apache", r"Apache(?:\s+Software)?\s+License,?\s+(?:Version|v\.?)\s*2(?:\.0)?", r"Apache-2\.0", r"apache\.org/licenses/LICENSE-2\.0"),
    ("gpl", "general", r"(?:GNU\s+)?General\s+Public", r"GPL", r"gnu\.org/licenses/?"),
    ("gpl-1.0", "general", r"(?:GNU\s+)?General\s+Public\s+License,?\s+(?:version|v\.?)\s*1(?:\.0)?", r"GPL-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general", r"(?:GNU\s+)?General\s+Public\s+License,?\s+(?:version|v\.?)\s*2(?:\.0)?", r"GPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general", r"(?:GNU\s+)?General\s+Public\s+License,?\s+(?:version|v\.?)\s*3(?:\.0)?", r"GPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl", "lesser", r"(?:GNU\s+)?Lesser\s+General\s+Public", r"LGPL", r"gnu\.org/copyleft/lesser"),
    ("lgpl-2.1", "lesser", r"(?:GNU\s+)?Lesser\s+General\s+Public\s+License,?\s+(?:version|v\.?)\s*2\.1", r"LGPL-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser", r"(?:GNU\s+)?Lesser\s+General\s+Public\s+License,?\s+(?:version|v\.?)\s*3(?:\.0)?", r"LGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.0", "library", r"(?:GNU\s+)?Library\s+General\s+Public", r"LGPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl", "affero", r"(?:GNU\s+)?Affero\s+General\s+Public", r"AGPL", r"gnu\.org/licenses/agpl"),
    ("agpl-3.0", "affero", r"(?:GNU\s+)?Affero\s+General\s+Public\s+License,?\s+(?:version|v\.?)\s*3(?:\.0)?", r"AGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "documentation", r"(?:GNU\s+)?Free\s+Documentation", r"GFDL(?:-1\.[123])?", r"gnu\.org/licenses/fdl"),
    ("bsd", "bsd", r"(?:(?:new|original|modified|simplified)\s+)?BSD(?:-style)?", r"BSD", r"opensource\.org/licenses?/bsd"),
    ("bsd-2-clause", "bsd", r"(?:BSD[ -]+(?:2|two)[ -]+Clause|(?:2|two)[ -]+Clause\s+BSD)", r"BSD-2-Clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:BSD[ -]+(?:3|three)[ -]+Clause|(?:3|three)[ -]+Clause\s+BSD)", r"BSD-3-Clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:BSD[ -]+(?:4|four)[ -]+Clause|(?:4|four)[ -]+Clause\s+BSD)", r"BSD-4-Clause", r""),
    ("0bsd", "bsd", r"(?:Zero[ -]+Clause\s+BSD|BSD[ -]+Zero[ -]+Clause)", r"0BSD", r"opensource\.org/licenses?/0bsd"),
    ("mpl", "mozilla", r"Mozilla\s+Public", r"MPL", r"mozilla\.org/MPL"),
    ("mpl-1.1", "mozilla", r"Mozilla\s+Public\s+License,?\s+(?:version|v\.?)\s*1\.1", r"MPL-1\.1", r"mozilla\.org/MPL/1\.1"),
    ("mpl-2.0", "mozilla", r"Mozilla\s+Public\s+License,?\s+(?:version|v\.?)\s*2(?:\.0)?", r"MPL-2\.0", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    ("epl", "eclipse", r"Eclipse\s+Public", r"EPL", r"eclipse\.org/legal/epl"),
    ("epl-1.0", "eclipse", r"Eclipse\s+Public\s+License,?\s+(?:version|v\.?|-)\s*1(?:\.0)?", r"EPL-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"Eclipse\s+Public\s+License,?\s+(?:version|v\.?|-)\s*2(?:\.0)?", r"EPL-2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("edl", "eclipse", r"Eclipse\s+Distribution", r"EDL-1\.0", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl", "development", r"Common\s+Development\s+and\s+Distribution", r"CDDL(?:-1\.[01])?", r"opensource\.org/licenses?/cddl"),
    ("cpl", "common", r"Common\s+Public", r"CPL-1\.0", r"opensource\.org/licenses?/cpl"),
    ("ipl", "ibm", r"IBM\s+Public", r"IPL-1\.0", r"opensource\.org/licenses?/ibmpl"),
    ("isc", "isc", r"ISC", r"ISC", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"Zlib", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("bsl-1.0", "boost", r"Boost\s+Software", r"BSL-1\.0", r"boost\.org/LICENSE_1_0"),
    ("busl-1.1", "business", r"Business\s+Source", r"BUSL-1\.1", r"mariadb\.com/bsl11"),
    ("unlicense", "unlicense", r"(?:The\s+)?Unlicense", r"Unlicense", r"unlicense\.org"),
    ("wtfpl", "want", r"Do\s+What\s+The\s+F\w*\s+You\s+Want\s+To\s+Public", r"WTFPL", r"wtfpl\.net"),
    ("artistic", "artistic", r"(?:Perl\s+)?Artistic", r"Artistic", r"opensource\.org/licenses?/artistic"),
    ("artistic-2.0", "artistic", r"Artistic\s+License,?\s+(?:version|v\.?)?\s*2(?:\.0)?", r"Artistic-2\.0", r"opensource\.org/licenses?/artistic-license-2\.0"),
    ("python-2.0", "python", r"Python(?:\s+Software\s+Foundation)?", r"(?:Python|PSF)-2\.0", r"docs\.python\.org/\S*license"),
    ("php-3.01", "php", r"PHP", r"PHP-3\.0?1?", r"php\.net/license"),
    ("ruby", "ruby", r"Ruby", r"Ruby", r"ruby-lang\.org/\S*license"),
    ("postgresql", "postgresql", r"PostgreSQL", r"PostgreSQL", r"postgresql\.org/about/licence"),
    ("openssl", "openssl", r"OpenSSL", r"OpenSSL", r"openssl\.org/source/license"),
    ("curl", "curl", r"curl", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("ofl-1.1", "font", r"(?:SIL\s+)?Open\s+Font", r"OFL-1\.1", r"scripts\.sil\.org/OFL"),
    ("ncsa", "ncsa", r"(?:University\s+of\s+Illinois/)?NCSA(?:\s+Open\s+Source)?", r"NCSA", r"opensource\.org/licenses?/ncsa"),
    ("ms-pl", "microsoft", r"Microsoft\s+Public", r"MS-PL", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", r"Microsoft\s+Reciprocal", r"MS-RL", r"opensource\.org/licenses?/ms-rl"),
    ("afl-3.0", "academic", r"Academic\s+Free", r"AFL-3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", "open", r"Open\s+Software", r"OSL-3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("eupl", "european", r"European\s+Union\s+Public", r"EUPL(?:-1\.[012])?", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cecill", "cecill", r"CeCILL(?:-[BC])?", r"CECILL(?:-[BC]|-[12]\.[01])?", r"cecill\.info"),
    ("sspl", "server", r"Server\s+Side\s+Public", r"SSPL-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", r"Elastic", r"Elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("upl-1.0", "permissive", r"Universal\s+Permissive", r"UPL-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("vim", "vim", r"Vim", r"Vim", r"vimhelp\.org/uganda"),
    ("w3c", "w3c", r"W3C(?:\s+Software(?:\s+Notice\s+and)?)?", r"W3C", r"w3\.org/Consortium/Legal"),
    ("odbl-1.0", "database", r"Open\s+Database", r"ODbL-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("pddl-1.0", "dedication", r"Public\s+Domain\s+Dedication\s+and", r"PDDL-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("odc-by-1.0", "commons", r"Open\s+Data\s+Commons\s+Attribution", r"ODC-By-1\.0", r"opendatacommons\.org/licenses/by"),
    ("cc0-1.0", "cc0", r"CC0(?:\s+1\.0)?(?:\s+Universal)?", r"CC0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "creative", r"Creative\s+Commons\s+Attribution(?:\s+[1-4]\.\d)?", r"", r""),
    ("cc-by", "by", r"CC[ -]BY(?:\s+[1-4]\.\d)?", r"CC-BY(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "sa", r"CC[ -]BY[ -]SA(?:[ -][1-4]\.\d)?", r"CC-BY-SA(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nd", "nd", r"CC[ -]BY[ -]ND(?:[ -][1-4]\.\d)?", r"CC-BY-ND(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc", "nc", r"CC[ -]BY[ -]NC(?:[ -][1-4]\.\d)?", r"CC-BY-NC(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "sa", r"CC[ -]BY[ -]NC[ -]SA(?:[ -][1-4]\.\d)?", r"CC-BY-NC-SA(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "nd", r"CC[ -]BY[ -]NC[ -]ND(?:[ -][1-4]\.\d)?", r"CC-BY-NC-ND(?:-[1-4]\.\d)?", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("proprietary", "reserved", r"all\s+rights\s+reserved,?\s+proprietary", r"LicenseRef-Proprietary", r""),
    ("public-domain", "domain", r"(?:released|dedicated|placed)\s+(?:in)?to\s+the\s+public\s+domain", r"LicenseRef-Public-Domain", r""),
]

_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Confidence of a label by the priority of the rule that found it.
CONFIDENCE = {4: 0.98, 3: 0.9, 2: 0.75, 1: 0.6}


def rules() -> list[dict]:
    """The rules in order: keyword, gates, pattern, label, priority (4 wins over 1).

    Every match holds the keyword, and one of the gates, in lower case.
    """
    made = []
    for label, keyword, name, short, address in SIGNATURES:
        bare = re.search("[Ll]icen|public\\\\s\\+domain|reserved|CC|Creative|Unlicense", name) is not None
        full = name if bare else rf"{name}\s+(?:Public\s+)?Licen[cs]e"
        if "licen" in full.lower():
            gates = ("licen",)
        else:
            gates = ("cc by", "cc-by") if name.startswith("CC[ -]BY") else (keyword,)
        own = [
            (keyword, gates, rf"{_L}(?:licensed|released|distributed|available|published|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:GNU\s+)?{full}{_R}", 3),
            (keyword, gates, rf"{_L}{full}{_R}", 2),
        ]
        if short:
            own.insert(0, ("spdx", ("spdx",), rf"{_L}SPDX-License-Identifier:\s*\(?{short}{_R}(?![.+-]\w)", 4))
            own.append(("license", ("licen",), rf"{_L}Licen[cs]e\s*[:=]\s*[\"']?{short}{_R}(?![.+-]\w)", 3))
        if address:
            # the end of the host's name, with the slash where one follows
            end = re.search(r"\\(\.[a-z]+)\)?(/|\Z)", address)
            own.append((re.match(r"[a-z0-9]+", address)[0], (end[1] + end[2],), rf"{_L}(?:https?://)?(?:www\.)?{address}", 2))
        made += [
            {"keyword": k, "gates": g, "pattern": "(?i)" + p, "label": label, "priority": n} for k, g, p, n in own
        ]
    return made


def gate_words() -> list[str]:
    """One of these is in every lower-cased text that a rule matches."""
    words = {g for r in rules() for g in r["gates"]}
    return sorted(w for w in words if not any(v in w for v in words - {w}))


def _families() -> Column:
    """The rules as one constant array, grouped by gate keyword."""
    groups: dict[str, list] = {}
    for r in rules():
        groups.setdefault(r["keyword"], []).append({k: r[k] for k in ("pattern", "label", "priority")})
    # plain literals: the optimiser folds them into one value
    return F.array(*(
        F.struct(
            F.lit(k).alias("keyword"),
            F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in r.items())) for r in own)).alias("rules"),
        )
        for k, own in groups.items()
    ))


_DETECTION = "array<struct<begin: int, stop: int, priority: int, label: string>>"


def detections(text: Column, low: Column) -> Column:
    """Every match of every gated rule: array of (begin, stop, priority, label).

    ``low`` is the lower-cased text, a column of its own so that it is computed once.
    """
    def gate(family: Column) -> Column:
        named = low.rlike(r"licen[cs]e\s*[:=]")
        return F.when(family["keyword"] == "license", named).otherwise(F.contains(low, family["keyword"]))

    gated = F.flatten(F.transform(F.filter(_families(), gate), lambda f: f["rules"]))

    def matches(rule: Column) -> Column:
        # what lies between the matches, and the matches, give their places
        hits = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.length)
        between = F.transform(F.split(text, rule["pattern"], -1), F.length)
        empty = F.array().cast(_DETECTION)
        return F.get(
            F.transform(F.array(hits), lambda h: F.when(F.size(h) == 0, empty).otherwise(placed(rule, h, between))), F.lit(0)
        )

    def placed(rule: Column, hits: Column, between: Column) -> Column:

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            hit = F.struct(
                begin.alias("begin"), (begin + x["hit"]).alias("stop"),
                rule["priority"].alias("priority"), rule["label"].alias("label"),
            )
            return F.struct((begin + x["hit"]).alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

        pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTION).alias("found"))
        return F.aggregate(pairs, start, step, lambda acc: acc["found"])

    return F.flatten(F.transform(gated, matches))


def surviving(found: Column) -> Column:
    """Labels and best priority after suppression: struct(labels, best).

    In order of begin, longest first, a detection is inside an earlier one exactly if
    that one's end is not before its own; ends are kept per priority.
    """
    def first(a: Column, b: Column) -> Column:
        def order(x, y, rest):
            return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

        rest = order(a["label"], b["label"], F.lit(0))
        return order(a["begin"], b["begin"], order(b["stop"], a["stop"], order(b["priority"], a["priority"], rest)))

    names = ("e1", "e2", "e3", "e4")

    def step(acc: Column, d: Column) -> Column:
        reach = F.greatest(
            *(F.when(d["priority"] <= n, acc[e]).otherwise(-1) for n, e in enumerate(names, 1)), F.lit(-1)
        )
        kept = reach < d["stop"]
        ends = [
            F.when(d["priority"] == n, F.greatest(acc[e], d["stop"])).otherwise(acc[e]).alias(e)
            for n, e in enumerate(names, 1)
        ]
        return F.struct(
            *ends,
            F.when(kept, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(kept, F.greatest(acc["best"], d["priority"])).otherwise(acc["best"]).alias("best"),
        )

    start = F.struct(
        *(F.lit(-1).alias(e) for e in names),
        F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"),
    )
    return F.aggregate(F.array_sort(found, first), start, step, lambda acc: F.struct(acc["labels"], acc["best"]))


def scan_licenses(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters, digits and non-ASCII characters; base phrases are
    consecutive words whatever stands between them.  Base labels always stay; the rules
    add theirs.  ``score`` is the confidence of the best surviving rule, 0.7 at least
    where a base phrase stands, 0 without any label.  Null and empty texts have no words
    and no labels; repeated rows are repeated; other columns are ignored; nothing moves.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    alternatives = "|".join(rf"{_BREAK}+".join(p.split(" ")) for p in BASE_PHRASES)
    place = rf"(?i)(?<={_BREAK})(?=(?:{alternatives})(?:{_BREAK}|\z))"
    out = docs.select(F.col(keep), t.alias("_t"), F.lower(t).alias("_low"))
    gated = F.lit(False)
    for word in gate_words():
        gated = gated | F.contains("_low", F.lit(word))
    out = out.withColumn("n_words", F.regexp_count("_t", F.lit(_WORD)).cast("long"))
    # the parts of a text that start at a base phrase, after the part before the first
    out = out.withColumn(
        "_parts",
        F.when(F.contains("_low", F.lit("license")), F.split(F.concat(F.lit(" "), F.col("_t")), place, -1))
        .otherwise(F.array(F.lit(""))),
    )
    n_base = (F.size("_parts") - 1).cast("long")
    count = lambda c: F.regexp_count(c, F.lit(_WORD)).cast("long")
    first_words = {p.split(" ")[0]: label for p, label in BASE_PHRASES.items()}
    base = F.sort_array(F.array_distinct(F.transform(
        F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))),
        lambda p: _labelled(F.lower(F.regexp_extract(p, "(?i)^([a-z]+)", 1)), first_words),
    )))
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    out = out.select(
        keep, "n_words", n_base.alias("n_base"),
        F.when(n_base > 0, count(F.get("_parts", F.lit(0)))).alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - count(F.element_at("_parts", -1))).alias("last_word"),
        base.alias("_base"),
        F.when(gated, surviving(detections(F.col("_t"), F.col("_low")))).otherwise(none).alias("_rules"),
    )
    best = F.col("_rules.best")
    score = F.lit(0.0)
    for priority, confidence in CONFIDENCE.items():
        score = F.when(best == priority, F.lit(confidence)).otherwise(score)
    return out.select(
        keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", "_rules.labels")), ",").alias("labels"),
        F.greatest(score, F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
    )


def _labelled(word: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        out = F.when(word == key, F.lit(label)).otherwise(out)
    return out
