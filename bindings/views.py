"""Spark views that reshape the driver's tables into the library's tables.

Every view is row-local: none of them gathers rows of a key.  The DuckDB twins
are in ``bindings.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.functions import clock
from reelgauge.session import configure
from reelgauge.sources.files import read_spread

#: 2022-11-01 00:00:00 UTC
BASE = 1667260800
COLLECTED = "2023-04-01"
RECOLLECTED = "2023-04-02"

LANGS = ("pt", "en", "fr", "de", "es")
ERRORS = (
    "Private video: sign in",
    "This video has been deleted",
    "Removed by the uploader",
    "Video unavailable",
    "Age-restricted content",
    "This video is no longer available",
    "Blocked on copyright grounds",
    "IP address block in effect",
    "Connection reset",
)
ERROR_KINDS = (None, "NoTranscriptFound", "TranscriptsDisabled", "IpBlocked")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    path = f"{sf_dir}/{name}.parquet"
    if name == "documents":
        return read_spread(spark, path, spark.sparkContext.defaultParallelism)
    return spark.read.parquet(path)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat('v', doc_id) as videoId",
        "source as channelId",
        "substring(text, 1, 40) as videoTitle",
        "cast(null as string) as videoAudio",
        "text as videoTranscript",
        "cast(n_chars as bigint) as viewCount",
        "cast(doc_id * 37 % 1000 as bigint) as likeCount",
        "cast(doc_id * 11 % 100 as bigint) as commentCount",
        f"timestamp_seconds({BASE} + doc_id % 121 * 86400 + doc_id % 24 * 3600) as publishedAt",
        f"date '{COLLECTED}' as collectedDate",
        "lang as transcriptLanguage",
        "doc_id as ingest_seq",
    )


def stored_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos in the stored layout."""
    return videos(spark, sf_dir).drop("doc_id", "ingest_seq")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source; ``src7`` is missing on purpose."""
    return (
        table(spark, sf_dir, "documents")
        .filter("source <> 'src7'")
        .select(F.col("source").alias("channelId"))
        .distinct()
        .withColumn("channelName", F.concat(F.lit("Channel "), F.col("channelId")))
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, ':', turn) as commentId",
        "concat('v', conv_id) as videoId",
        "case when turn > 0 then concat(conv_id, ':0') end as parentCommentId",
        "concat('u_', role) as userId",
        "role as userName",
        "text as content",
        "cast(length(text) % 50 as bigint) as likeCount",
        f"timestamp_seconds({BASE} + conv_id * 86400 + turn * 60) as publishedAt",
        f"date '{COLLECTED}' as collectedDate",
    )


def api_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video records as JSON; some counts are left out, times come in both formats."""
    rfc = F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    even = F.col("doc_id") % 2 == 0
    statistics = F.struct(
        F.col("viewCount").cast("string").alias("viewCount"),
        F.when(F.col("doc_id") % 7 != 0, F.col("likeCount").cast("string")).alias("likeCount"),
        F.when(F.col("doc_id") % 10 != 0, F.col("commentCount").cast("string")).alias(
            "commentCount"
        ),
    )
    snippet = F.struct(
        "channelId",
        F.col("videoTitle").alias("title"),
        F.when(even, rfc).otherwise(clock.stamp(F.col("publishedAt"))).alias("publishedAt"),
    )
    record = F.struct(
        F.col("videoId").alias("id"), snippet.alias("snippet"), statistics.alias("statistics")
    )
    return videos(spark, sf_dir).select("doc_id", F.to_json(record).alias("payload"))


def api_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel records, one page per supplier; some lack counts or a title."""
    key = F.col("s_suppkey")
    item = F.struct(
        F.concat(F.lit("UC"), key).alias("id"),
        F.struct(F.when(key % 9 != 0, F.col("s_name")).alias("title")).alias("snippet"),
        F.struct(
            F.when(key % 5 != 0, (key * 101).cast("string")).alias("subscriberCount"),
            F.when(key % 4 != 0, (key * 7).cast("string")).alias("videoCount"),
        ).alias("statistics"),
    )
    return table(spark, sf_dir, "supplier").select(
        F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")
    )


def playlist_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of two items per document: one names its id in either place."""
    when = F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = F.struct(
        F.struct(
            when.alias("publishedAt"),
            F.struct(F.lit(None).cast("string").alias("videoId")).alias("resourceId"),
        ).alias("snippet"),
        F.struct(F.col("videoId").alias("videoId")).alias("contentDetails"),
    )
    second = F.struct(
        F.struct(
            when.alias("publishedAt"),
            F.struct(F.concat("videoId", F.lit("b")).alias("videoId")).alias("resourceId"),
        ).alias("snippet"),
        F.struct(F.lit(None).cast("string").alias("videoId")).alias("contentDetails"),
    )
    return videos(spark, sf_dir).select(
        F.to_json(F.struct(F.array(first, second).alias("items"))).alias("payload")
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of two hits per document; every third document leads with a channel."""
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("youtube#channel")).otherwise(
        F.lit("youtube#video")
    )
    def hit(kind, video):
        return F.struct(F.struct(kind.alias("kind"), video.alias("videoId")).alias("id"))

    hits = F.array(
        hit(kind, F.col("videoId")),
        hit(F.lit("youtube#video"), F.concat("videoId", F.lit("b"))),
    )
    return videos(spark, sf_dir).select(F.to_json(F.struct(hits.alias("items"))).alias("payload"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thread per document: its first line is the comment, the others the replies."""
    def comment(pos, line):
        return F.struct(
            F.concat(F.col("doc_id"), F.lit(":"), pos).alias("id"),
            F.struct(
                F.struct(F.concat(F.lit("u"), pos % 5).alias("value")).alias("authorChannelId"),
                F.concat(F.lit("User "), pos % 5).alias("authorDisplayName"),
                line.alias("textDisplay"),
                F.length(line).cast("bigint").alias("likeCount"),
                F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            ).alias("snippet"),
        )

    lines = F.split("videoTranscript", "\n")
    n = F.size(lines)
    replies = F.transform(
        F.slice(lines, F.lit(2), n - 1), lambda line, i: comment(i + 1, line)
    )
    record = F.struct(
        F.struct(comment(F.lit(0), lines[0]).alias("topLevelComment")).alias("snippet"),
        F.when(n > 1, F.struct(replies.alias("comments"))).alias("replies"),
    )
    return videos(spark, sf_dir).select("videoId", F.to_json(record).alias("payload"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed transcripts: the lines of a document, 97.3 seconds apart."""
    pieces = F.transform(
        F.split("videoTranscript", "\n"),
        lambda line, i: F.struct((i * F.lit(97.3).cast("double")).alias("start"), line.alias("text")),
    )
    return videos(spark, sf_dir).select("videoId", F.to_json(pieces).alias("payload"))


def timed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose transcript carries time marks, a bare time and a link."""
    lines = F.transform(
        F.split("videoTranscript", "\n"),
        lambda line, i: F.format_string("[%02d:%02d] %s", i * 3, i % 60, line),
    )
    tail = F.format_string(
        " 9:59 at [01:02:33] see https://a.example/v?id=%d or www.b.example/x [Mark] end",
        F.col("doc_id"),
    )
    return videos(spark, sf_dir).withColumn(
        "videoTranscript", F.concat(F.array_join(lines, "\n"), tail)
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, ERRORS))
    kinds = F.array(*map(F.lit, ERROR_KINDS))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("v"), F.col("doc_id")).alias("videoId"),
        F.col("doc_id"),
        texts[(F.col("doc_id") % len(ERRORS)).cast("int")].alias("message"),
        # every message meets every kind
        kinds[(F.floor(F.col("doc_id") / len(ERRORS)) % len(ERROR_KINDS)).cast("int")].alias("kind"),
    )


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert batch: every third video changed, some twice, and new videos."""
    base = videos(spark, sf_dir).filter("doc_id % 3 = 0")

    def variant(rows: DataFrame, step: int, video_id: str) -> DataFrame:
        return rows.selectExpr(
            f"{video_id} as videoId",
            f"concat(channelId, '-{step}') as channelId",
            f"concat(videoTitle, ' /{step}') as videoTitle",
            "concat('a/', doc_id) as videoAudio",
            f"case when (doc_id + {step}) % 2 = 1 then concat('new{step} ', videoTitle) end as videoTranscript",
            f"viewCount + {step} * 1000 as viewCount",
            f"likeCount + {step} as likeCount",
            f"commentCount + {step} as commentCount",
            f"publishedAt + interval {step} hours as publishedAt",
            f"date '{RECOLLECTED}' as collectedDate",
            f"case when (doc_id + {step}) % 2 = 1 then 'xx' end as transcriptLanguage",
            f"doc_id * 10 + {step} as seq",
        )

    return (
        variant(base, 1, "videoId")
        .unionByName(variant(base.filter("doc_id % 15 = 0"), 2, "videoId"))
        .unionByName(variant(base, 3, "concat('n', doc_id)"))
        .unionByName(variant(base.filter("doc_id % 15 = 0"), 4, "concat('n', doc_id)"))
    )


def comment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited comments with other values everywhere, and new ones; first turns twice."""
    base = table(spark, sf_dir, "conversations")

    def variant(rows: DataFrame, step: int, comment_id: str) -> DataFrame:
        return rows.selectExpr(
            f"{comment_id} as commentId",
            f"concat('w', conv_id, '{step}') as videoId",
            f"case when turn > 1 then concat(conv_id, ':{step}') end as parentCommentId",
            f"concat('x{step}_', role) as userId",
            f"concat('X{step} ', role) as userName",
            f"concat('edit {step} ', text) as content",
            f"cast(turn + {step} as bigint) as likeCount",
            f"timestamp_seconds({BASE} + {step} * 60) as publishedAt",
            f"date '{RECOLLECTED}' as collectedDate",
            f"conv_id * 1000 + turn * 10 + {step} as seq",
        )

    stored = "concat(conv_id, ':', turn)"
    fresh = "concat('n', conv_id, ':', turn)"
    return (
        variant(base.filter("turn % 2 = 0"), 1, stored)
        .unionByName(variant(base.filter("turn = 0"), 2, stored))
        .unionByName(variant(base.filter("turn = 1"), 3, fresh))
    )


def stored_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('UC', s_suppkey) as channelId",
        "s_name as channelName",
        f"date '{COLLECTED}' as dayCollected",
        "cast(s_suppkey * 3 as bigint) as numberOfSubscribers",
        "cast(s_suppkey as bigint) as numberOfVideos",
    )


def channel_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").selectExpr(
        "concat(case when s_suppkey % 4 = 0 then 'UC' else 'NEW' end, s_suppkey) as channelId",
        "concat(s_name, ' renamed') as channelName",
        f"date '{RECOLLECTED}' as dayCollected",
        "cast(null as bigint) as numberOfSubscribers",
        "cast(s_suppkey * 2 as bigint) as numberOfVideos",
        "cast(s_suppkey as bigint) as seq",
    )


def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel list whose every sixth row is a blank filler."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "case when s_suppkey % 6 <> 0 then s_name end as name",
        "case when s_suppkey % 6 <> 0 then concat('https://c.example/', s_suppkey) end as url",
        "case when s_suppkey % 6 <> 0 then concat('UC', s_suppkey) "
        "when s_suppkey % 12 = 0 then '' end as id",
        "case when s_suppkey % 6 <> 0 then cast(s_suppkey as bigint) end as numberOfVideos",
        "case when s_suppkey % 6 <> 0 then cast(s_suppkey * 3 as bigint) end as numberOfSubscribers",
        f"case when s_suppkey % 6 <> 0 then timestamp_seconds({BASE} + s_suppkey) end as dataCollected",
    )


def fresh_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This year's figures; every seventh channel did not answer."""
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 0").selectExpr(
        "concat('UC', s_suppkey) as channelId",
        "cast(s_suppkey * 2 as bigint) as numberOfVideos",
        "cast(s_suppkey * 5 as bigint) as numberOfSubscribers",
    )


def transcript_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available transcripts per video: one language per conversation turn."""
    langs = F.array(*map(F.lit, ("fr", "en", "pt-BR", "pt", "de")))
    index = ((F.col("conv_id") + F.col("turn")) % 5).cast("int")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id")).alias("videoId"),
        langs[index].alias("language"),
        F.col("turn").alias("seq"),
        "text",
    )


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of downloaded files, some in another language or of another type."""
    types = F.array(*map(F.lit, ("srv1", "json3", "srt", "vtt", "srv3", "srv2")))
    index = ((F.col("conv_id") * 5 + F.col("turn")) % 6).cast("int")
    lang = F.when(F.col("turn") % 4 == 3, F.lit("en")).otherwise(F.lit("pt"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("v."), F.col("conv_id"), F.lit("."), lang, F.lit("."), types[index]
        ).alias("file")
    )


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of fetching a transcript for every video without one."""
    from reelgauge.functions.status import fetch_status

    failed = fetch_status(F.col("message"))
    ok = F.col("doc_id") % 2 == 0
    return (
        errors(spark, sf_dir)
        .filter("doc_id % 3 = 0")
        .select(
            "videoId",
            ok.alias("ok"),
            F.when(ok, F.concat(F.lit("text of "), F.col("videoId")))
            .otherwise(failed["status"])
            .alias("text"),
            F.when(ok, F.lit("pt")).otherwise(failed["language"]).alias("language"),
        )
    )


def videos_without_some_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third transcript missing, every eleventh empty; audio paths half filled."""
    return videos(spark, sf_dir).selectExpr(
        "doc_id",
        "videoId",
        "channelId",
        "publishedAt",
        "ingest_seq",
        "case when doc_id % 3 = 0 then null when doc_id % 11 = 0 then '' "
        "else videoTranscript end as videoTranscript",
        "case when doc_id % 3 = 0 then null else transcriptLanguage end as transcriptLanguage",
        "case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' "
        "else concat('audio/', videoId, '.mp3') end as videoAudio",
    )
