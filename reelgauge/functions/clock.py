"""Time expressions: parsing, formatting and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(c: Column) -> Column:
    """Both stored formats, ``Y-m-d H:M:S`` and RFC 3339, to UTC; junk is NULL."""
    return F.try_to_timestamp(c)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def minutes_seconds(seconds: Column) -> Column:
    """``MM:SS`` with unbounded minutes; fractions of a second are cut off."""
    whole = seconds.cast("long")
    return F.format_string(
        "%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60))
    )


def hours_minutes_seconds(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600).cast("long"),
        F.pmod(F.floor(whole / 60).cast("long"), F.lit(60)),
        F.pmod(whole, F.lit(60)),
    )


def transcript_text(snippets: Column) -> Column:
    """``[MM:SS] text`` lines in snippet order; newlines inside become spaces."""
    lines = F.transform(
        snippets,
        lambda s: F.concat(
            F.lit("["),
            minutes_seconds(s["start"]),
            F.lit("] "),
            F.replace(s["text"], F.lit("\n"), F.lit(" ")),
        ),
    )
    return F.array_join(lines, "\n")
