"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from bindings import views as V
from reelgauge import schemas
from reelgauge.functions import clock, status
from reelgauge.functions import stopwords as S
from reelgauge.functions import text as X
from reelgauge.operators import channels as CH
from reelgauge.operators import engagement as E
from reelgauge.operators import filters as FI
from reelgauge.operators import joins as J
from reelgauge.operators import ngrams as N
from reelgauge.operators import picks as P
from reelgauge.operators import quality as Q
from reelgauge.operators import topics as TO
from reelgauge.operators import upsert as U
from reelgauge.operators.clusters import cluster_engagement
from reelgauge.operators.scaling import materialise, unnest
from reelgauge.plans import export, report
from reelgauge.session import shared_dir
from reelgauge.sources import files, landed
from reelgauge.sources import records as R
from reelgauge.streaming import ingest

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@lru_cache(maxsize=1)
def stop() -> list[str]:
    """All language lists of the test texts plus the filler words."""
    return S.stopword_set(V.LANGS)


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, so both engines compare them alike."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = clock.stamp(F.col(f.name))
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
    return df.withColumns(out) if out else df


def r6(*names: str) -> dict[str, Column]:
    return {n: F.round(F.col(n).cast("double"), 6) for n in names}


def in_period(spark: SparkSession, sf: str) -> DataFrame:
    return E.assign_periods(FI.valid_videos(V.videos(spark, sf)))


# --- scans and parsing ----------------------------------------------------------

@query
def scan_videos(spark, sf):
    return shown(FI.analysis_columns(V.videos(spark, sf)))


@query
def api_channels_parse(spark, sf):
    return R.parse_channels(V.api_channels(spark, sf))


@query
def api_videos_parse(spark, sf):
    parsed = R.parse_videos(V.api_videos(spark, sf), collected=V.COLLECTED)
    return shown(parsed.drop("doc_id", "videoAudio", "videoTranscript", "transcriptLanguage"))


@query
def comment_fetch_list(spark, sf):
    parsed = R.parse_videos(V.api_videos(spark, sf), collected=V.COLLECTED)
    return FI.comments_enabled(parsed).select("videoId", "commentCount")


@query
def api_playlist_parse(spark, sf):
    return shown(R.parse_playlist(V.playlist_pages(spark, sf)))


@query
def api_search_parse(spark, sf):
    return R.parse_search(V.search_pages(spark, sf))


@query
def comments_flatten(spark, sf):
    return shown(R.flatten_threads(V.threads(spark, sf), collected=V.COLLECTED))


# --- constraints ------------------------------------------------------------------

@query
def dq_pk(spark, sf):
    """Keys used twice in the upsert batch."""
    return Q.duplicate_keys(V.batch(spark, sf), "videoId")


@query
def dq_not_null(spark, sf):
    batch = V.batch(spark, sf)
    return Q.null_counts(batch, ["videoId", "videoTitle", "videoTranscript", "publishedAt"])


@query
def dq_orphans(spark, sf):
    videos = V.videos(spark, sf)
    comments = V.comments(spark, sf).unionByName(
        V.comment_batch(spark, sf).select(*schemas.COMMENTS.fieldNames())
    )
    return Q.all_orphans(V.channels(spark, sf), videos, comments)


# --- upserts and patches ------------------------------------------------------------

@query
def upsert_videos(spark, sf):
    return shown(U.upsert_videos(V.stored_videos(spark, sf), V.batch(spark, sf)))


@query
def upsert_comments(spark, sf):
    return shown(U.upsert_comments(V.comments(spark, sf), V.comment_batch(spark, sf)))


@query
def upsert_channels(spark, sf):
    return shown(U.upsert_channels(V.stored_channels(spark, sf), V.channel_batch(spark, sf)))


@query
def patch_transcripts(spark, sf):
    videos = V.videos_without_some_transcripts(spark, sf).select(
        "videoId", "videoTranscript", "transcriptLanguage"
    )
    patches = V.batch(spark, sf).filter("seq % 10 = 1 or seq % 10 = 3")
    return U.patch_transcripts(videos, patches)


@query
def patch_audio_path(spark, sf):
    videos = V.videos_without_some_transcripts(spark, sf).select("videoId", "videoAudio")
    patches = V.batch(spark, sf).filter("seq % 10 = 1 or seq % 10 = 3")
    return U.patch_audio_path(videos, patches)


@query
def record_unavailable(spark, sf):
    videos = V.videos_without_some_transcripts(spark, sf).select(
        "videoId", "videoTranscript", "transcriptLanguage"
    )
    return U.patch_transcripts(videos, U.transcript_patches(V.fetch_results(spark, sf)))


@query
def ensure_columns(spark, sf):
    partial = V.videos(spark, sf).select("channelId", "videoId", "likeCount", "doc_id")
    wide = U.add_missing_column(partial, "transcriptLanguage")
    return shown(FI.ensure_columns(wide, schemas.ANALYSIS))


# --- columns, types, filters ------------------------------------------------------------

@query
def resolve_columns(spark, sf):
    odd = V.videos(spark, sf).select(
        F.col("videoId"),
        F.col("channelId").alias("Channel_Ref"),
        F.col("transcriptLanguage"),
        F.col("videoTranscript").alias("cleanTranscript"),
        F.col("viewCount").alias("VIEWCOUNT_total"),
    )
    return FI.resolve_columns(
        odd,
        {
            "channelId": ["channel"],
            "videoTranscript": ["cleantranscript", "transcript", "text"],
            "viewCount": ["viewcount"],
        },
    )


@query
def coerce_types(spark, sf):
    raw = V.videos(spark, sf).selectExpr(
        "videoId",
        "case doc_id % 4 when 0 then date_format(publishedAt, 'yyyy-MM-dd HH:mm:ss') "
        "when 1 then date_format(publishedAt, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "when 2 then 'N/A' end as publishedAt",
        "case doc_id % 5 when 0 then 'many' when 1 then null "
        "else cast(viewCount as string) end as viewCount",
        "case doc_id % 3 when 0 then concat(likeCount, '.7') "
        "else cast(likeCount as string) end as likeCount",
        "cast(commentCount as string) as commentCount",
    )
    filled = FI.coerce_types(raw, fill=0)
    strict = FI.coerce_types(raw).select("videoId", F.col("viewCount").alias("viewCountOrNull"))
    return shown(filled.join(strict, "videoId"))


@query
def valid_videos(spark, sf):
    videos = V.videos(spark, sf).selectExpr(
        "videoId",
        "case when doc_id % 13 = 0 then null else channelId end as channelId",
        "case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then '  \n\t ' "
        "when doc_id % 17 = 0 then 'VIDEO_UNAVAILABLE: Video is private' "
        "else videoTranscript end as videoTranscript",
        "publishedAt",
        "case when doc_id % 19 = 0 then null else viewCount end as viewCount",
        "likeCount",
        "commentCount",
    )
    return shown(FI.valid_videos(videos))


@query
def transcript_status_split(spark, sf):
    videos = V.videos(spark, sf).selectExpr(
        "videoId",
        "case when doc_id % 17 = 0 then 'VIDEO_UNAVAILABLE: Video is private' "
        "when doc_id % 5 = 0 then 'TRANSCRIPT_UNAVAILABLE: none' "
        "when doc_id % 7 = 0 then null else videoTranscript end as videoTranscript",
    )
    return FI.with_transcript_status(videos)


@query
def filter_half_open(spark, sf):
    rows = FI.between(V.videos(spark, sf), "2022-11-05 00:00:00", "2023-01-10 05:00:00", "left")
    return shown(rows.select("videoId", "publishedAt"))


@query
def filter_publish_window(spark, sf):
    listed = R.parse_playlist(V.playlist_pages(spark, sf))
    start, end = "2022-12-01T00:00:00Z", "2023-01-31T23:59:59Z"
    both = FI.between(listed, start, end).withColumn("bounds", F.lit("both"))
    after = FI.between(listed, start=end).withColumn("bounds", F.lit("after"))
    before = FI.between(listed, end=start).withColumn("bounds", F.lit("before"))
    return shown(both.unionByName(after).unionByName(before))


@query
def videos_by_period(spark, sf):
    rows = E.assign_periods(V.videos(spark, sf).select("videoId", "publishedAt"))
    return shown(rows)


@query
def transcript_backlog(spark, sf):
    videos = V.videos_without_some_transcripts(spark, sf)
    listed = FI.transcript_backlog(videos, "2022-11-15", "2023-02-10")
    return shown(listed.select("videoId", "publishedAt", "ingest_seq"))


@query
def transcript_done(spark, sf):
    videos = V.videos_without_some_transcripts(spark, sf)
    return FI.has_transcript(videos).select("videoId")


@query
def audio_backlog(spark, sf):
    return FI.audio_backlog(V.videos_without_some_transcripts(spark, sf))


@query
def channel_filter(spark, sf):
    return shown(FI.analysis_columns(FI.channel(V.videos(spark, sf), "src3")))


# --- joins ----------------------------------------------------------------------

@query
def channel_names(spark, sf):
    videos = V.videos(spark, sf).select("videoId", "channelId")
    return J.channel_names(videos, V.channels(spark, sf))


@query
def new_videos(spark, sf):
    """Two thirds of the videos are hits, the even half of all is stored."""
    stored = V.videos(spark, sf).filter("doc_id % 2 = 0")
    return J.new_videos(R.parse_search(V.search_pages(spark, sf)), stored)


@query
def stored_videos(spark, sf):
    stored = V.videos(spark, sf).filter("doc_id % 2 = 0")
    return J.stored_videos(R.parse_search(V.search_pages(spark, sf)), stored)


@query
def known_ids(spark, sf):
    return J.known_ids(V.videos(spark, sf), V.batch(spark, sf))


@query
def video_details_join(spark, sf):
    ids = R.parse_search(V.search_pages(spark, sf))
    details = R.parse_videos(V.api_videos(spark, sf), collected=V.COLLECTED)
    return J.video_details(ids, details.select("videoId", "channelId", "viewCount"))


@query
def channel_yearly_update(spark, sf):
    updated = CH.yearly_update(
        V.channel_list(spark, sf), V.fresh_stats(spark, sf), 2025, "2025-05-25 09:43:51"
    )
    return CH.dated_export(updated, 2025)


@query
def comment_threads(spark, sf):
    """Stored comments, and those of the batch under ids of their own, so that all ids are unique."""
    batch = V.comment_batch(spark, sf).withColumn("commentId", F.concat_ws("/", "seq", "commentId"))
    comments = V.comments(spark, sf).unionByName(batch.select(*schemas.COMMENTS.fieldNames()))
    fresh = comments.select("commentId", "parentCommentId", "userId", "content")
    threads = J.comment_threads(fresh)
    return threads.select(
        "commentId", "parentCommentId", "userId", "parentUserId", "parentContent"
    )


@query
def comments_per_video(spark, sf):
    return J.comments_per_video(V.comments(spark, sf), V.videos(spark, sf))


@query
def videos_with_transcript(spark, sf):
    videos = V.videos(spark, sf).select("videoId", "channelId")
    return J.videos_with_transcript(videos, V.transcript_options(spark, sf))


@query
def lemma_lookup(spark, sf):
    """Plural-like words of the corpus map to their stem."""
    videos = V.videos(spark, sf)
    tokens = X.tokenize(F.col("videoTranscript")).alias("tokens")
    counts = materialise(N.doc_term_counts(videos.select("videoId", tokens)))
    lemmas = (
        counts.filter(F.col("term").rlike("^[a-z]{4,}s$"))
        .select("term", F.expr("left(term, length(term) - 1)").alias("lemma"))
        .distinct()
    )
    return J.lemma_counts(counts, materialise(lemmas))


@query
def stopword_table_filter(spark, sf):
    left = J.explode_stop_filtered(V.videos(spark, sf), S.stopword_table(spark, V.LANGS))
    return left.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query
def stopword_union(spark, sf):
    """Spark's lists plus the corpus' own words of at most two letters."""
    tokens = X.tokenize(F.col("videoTranscript"))
    short = unnest(V.videos(spark, sf), tokens, "word").filter(F.length("word") <= 2)
    return S.union_tables(S.stopword_table(spark, V.LANGS), short)


# --- aggregates -------------------------------------------------------------------

@query
def metric_summary(spark, sf):
    out = E.metric_summary(V.videos(spark, sf), ["channelId"])
    return out.withColumns(r6(*[f"mean_{m}" for m in schemas.METRICS]))


@query
def corpus_summary(spark, sf):
    out = E.metric_summary(V.videos(spark, sf))
    return out.withColumns(r6(*[f"mean_{m}" for m in schemas.METRICS]))


@query
def engagement_thresholds(spark, sf):
    return E.engagement_thresholds(in_period(spark, sf)).withColumns(r6("high", "low"))


@query
def engagement_tiers(spark, sf):
    narrow = in_period(spark, sf).select("period", "channelId", "videoId", "viewCount")
    return E.explode_tiers(E.with_tiers(narrow)).drop("channelId")


@query
def thresholds_after_batch(spark, sf):
    """Stored counts of two thirds of the videos, then a batch with the rest and with changed views."""
    rows = in_period(spark, sf).select("period", "channelId", "viewCount", "doc_id")
    stored = materialise(E.metric_counts(rows.filter("doc_id % 3 <> 0")))
    replaced = rows.filter("doc_id % 6 = 1")
    changed = replaced.withColumn("viewCount", F.col("viewCount") + 1000)
    change = E.counts_change(rows.filter("doc_id % 3 = 0").unionByName(changed), replaced)
    return E.limits_of_counts(materialise(E.merged_counts([stored, change])))


@query
def tier_sizes(spark, sf):
    narrow = in_period(spark, sf).select("period", "channelId", "videoId", "viewCount")
    return E.tier_sizes(E.with_tiers(narrow))


@query
def tokenize(spark, sf):
    tokens = X.tokenize(F.col("videoTranscript"))
    return V.videos(spark, sf).select(
        "videoId",
        F.size(tokens).cast("bigint").alias("n"),
        F.array_join(tokens, " ").alias("tokens"),
    )


@query
def bigram_counts(spark, sf):
    return N.bigram_counts(N.with_tokens(V.videos(spark, sf), stop()), ["channelId"])


@query
def bigram_fallback(spark, sf):
    counts = N.raw_bigram_counts(V.videos(spark, sf), ["channelId"], stop())
    return N.top_per_group(counts, ["channelId"])


@query
def doc_term_counts(spark, sf):
    return N.doc_term_counts(N.with_tokens(V.videos(spark, sf), stop()))


@query
def top_bigrams(spark, sf):
    return N.top_bigrams(in_period(spark, sf), stop())


@query
def top_bigrams_first_seen(spark, sf):
    rows = in_period(spark, sf).withColumn("order_key", F.col("ingest_seq"))
    return N.top_bigrams(rows, stop(), ties="first_seen")


@query
def period_report_tiers_bigrams(spark, sf):
    """Tier sizes and top bigrams of the report: strict cleaner, ties by first appearance."""
    tables = report.period_report(
        V.videos(spark, sf), stop(), ties="first_seen", order="ingest_seq", strict=True, parts=("tiers", "bigrams")
    )
    sizes = tables["tiers"].withColumnRenamed("videos", "n").withColumn("part", F.lit("tiers"))
    pairs = tables["bigrams"].withColumnRenamed("frequency", "n").withColumn("part", F.lit("bigrams"))
    return sizes.unionByName(pairs, allowMissingColumns=True)


@query
def group_engagement(spark, sf):
    labels = V.table(spark, sf, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id")).alias("videoId"), "quality", "toxic"
    )
    labelled = V.videos(spark, sf).join(labels, "videoId")
    out = E.group_engagement(labelled, ["quality", "toxic"])
    return out.withColumns(
        r6(*schemas.METRICS)
        | {"views_shown": X.thousands(F.col("viewCount")), "views_rounded": F.bround("viewCount", 0)}
    )


@query
def channels_in_period(spark, sf):
    return E.channels_in_period(in_period(spark, sf))


@query
def rollup_period_channel(spark, sf):
    out = E.rollup_period_channel(in_period(spark, sf))
    return out.withColumns(r6(*[f"mean_{m}" for m in schemas.METRICS]))


@query
def channel_profile(spark, sf):
    details = V.stored_channels(spark, sf).selectExpr(
        "concat('src', substring(channelId, 3)) as channelId", "channelName", "numberOfSubscribers"
    )
    return shown(CH.channel_profile(V.videos(spark, sf), details, V.COLLECTED))


@query
def outcome_counts(spark, sf):
    updated = CH.yearly_update(
        V.channel_list(spark, sf), V.fresh_stats(spark, sf), 2025, "2025-05-25 09:43:51"
    )
    return CH.update_outcome(updated, 2025)


@query
def transcript_outcome(spark, sf):
    return CH.transcript_outcome(V.videos_without_some_transcripts(spark, sf))


@query
def topic_k(spark, sf):
    sizes = E.group_sizes(in_period(spark, sf))
    return sizes.withColumn("k", E.topic_count(F.col("n")).cast("bigint"))


@query
def zscore_metrics(spark, sf):
    rows = in_period(spark, sf).select("period", "channelId", "videoId", *schemas.METRICS)
    out = E.zscores(rows, ["period", "channelId"])
    return out.select(
        "period", "videoId", *[F.round(f"z_{m}", 6).alias(f"z_{m}") for m in schemas.METRICS]
    )


# --- picks ----------------------------------------------------------------------

@query
def argmax_per_group(spark, sf):
    rows = V.videos(spark, sf).select("channelId", "videoId", "likeCount", "videoTranscript")
    return P.argmax_per_group(rows, ["channelId"], "likeCount", "videoId", "videoTranscript")


@query
def pick_transcript_lang(spark, sf):
    return P.pick_transcript_language(V.transcript_options(spark, sf))


@query
def pick_subtitle_ext(spark, sf):
    return P.pick_subtitle_file(V.subtitle_files(spark, sf), "pt")


# --- text -------------------------------------------------------------------------

@query
def remove_stopwords(spark, sf):
    return V.videos(spark, sf).select(
        "videoId", X.remove_stopwords(F.col("videoTranscript"), stop()).alias("text")
    )


@query
def remove_stopwords_strict(spark, sf):
    return V.timed_videos(spark, sf).select(
        "videoId", X.remove_stopwords_strict(F.col("videoTranscript"), stop()).alias("text")
    )


@query
def text_clean_basic(spark, sf):
    return V.timed_videos(spark, sf).select(
        "videoId", X.clean_basic(F.col("videoTranscript")).alias("text")
    )


@query
def text_clean_export(spark, sf):
    return V.timed_videos(spark, sf).select(
        "videoId", X.clean_export(F.col("videoTranscript")).alias("text")
    )


@query
def token_filter(spark, sf):
    pieces = F.filter(X.words(F.lower("videoTranscript")), X.is_alphabetic)
    return V.videos(spark, sf).select(
        "videoId", F.array_join(export.content_lemmas(pieces, stop()), " ").alias("lemmas")
    )


@query
def clean_transcripts_full(spark, sf):
    rows = FI.analysis_columns(V.timed_videos(spark, sf))
    return shown(export.clean_transcripts(rows, stop()))


@query
def clean_export(spark, sf):
    rows = FI.analysis_columns(V.timed_videos(spark, sf))
    window = FI.between(rows, "2022-10-31 00:00:00", "2023-02-01 00:00:00", "left")
    return shown(export.export_transcripts(window, stop()))


@query
def transcript_format(spark, sf):
    parsed = R.parse_snippets(V.snippets(spark, sf))
    return parsed.select("videoId", clock.transcript_text(F.col("snippets")).alias("text"))


@query
def duration_format(spark, sf):
    seconds = (F.col("viewCount") * 7).cast("double") + 0.9
    return V.videos(spark, sf).select(
        "videoId",
        clock.minutes_seconds(seconds).alias("mmss"),
        clock.hours_minutes_seconds(seconds).alias("hhmmss"),
    )


@query
def safe_name(spark, sf):
    return V.videos(spark, sf).select(
        "videoId", X.safe_name(F.concat("videoTitle", F.lit(" / "), "channelId")).alias("name")
    )


@query
def transcript_status_precheck(spark, sf):
    return V.errors(spark, sf).select(
        "videoId", status.precheck_status(F.col("message"), F.col("kind")).alias("s")
    ).select("videoId", "s.status", "s.language")


@query
def transcript_status_fetch(spark, sf):
    return V.errors(spark, sf).select(
        "videoId", status.fetch_status(F.col("message")).alias("s")
    ).select("videoId", "s.status", "s.language")


@query
def transcript_available(spark, sf):
    return V.errors(spark, sf).select(
        "videoId", status.may_have_transcript(F.col("message"), F.col("kind")).alias("available")
    )


# --- files ------------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    """The videos stored by month, December written twice, and a month of rows without a time."""
    path, rows = _folder(spark, "monthly"), V.videos(spark, sf)
    timeless = F.when(F.col("doc_id") % 29 != 0, F.col("publishedAt"))
    files.write_by_month(rows.withColumn("publishedAt", timeless), path)
    december = rows.filter("publishedAt >= '2022-12-01' and publishedAt < '2023-01-01' and doc_id % 29 != 0")
    files.write_by_month(december.withColumn("viewCount", F.col("viewCount") + 1), path)
    return files.read_by_month(spark, path, rows.schema)


@query
def monthly_window(spark, sf):
    return shown(FI.between(_monthly(spark, sf), "2022-12-20 00:00:00", "2023-01-10 05:00:00", "left").select(
        "videoId", "viewCount", "publishedAt", "publishMonth"))


@query
def monthly_periods(spark, sf):
    rows = E.assign_periods(_monthly(spark, sf))
    return rows.groupBy("period", "channelId").agg(F.count(F.lit(1)).alias("videos"), F.sum("viewCount").alias("views"))


@query
def scan_channels_csv(spark, sf):
    rows, path = V.channel_list(spark, sf), _folder(spark, "channels")
    files.write_csv(rows, path)
    return shown(files.read_channel_list(spark, path))


@query
def scan_analysis_csv(spark, sf):
    path = _folder(spark, "analysis")
    files.write_csv(FI.analysis_columns(V.timed_videos(spark, sf)), path)
    return shown(FI.coerce_types(files.read_analysis_file(spark, path)))


@query
def sink_csv_roundtrip(spark, sf):
    """Two appended parts are read back as one file."""
    path = _folder(spark, "appended")
    videos = FI.analysis_columns(V.videos(spark, sf))
    early = F.col("publishedAt") < F.lit("2022-12-15").cast("timestamp")
    files.write_csv(videos.filter(early), path)
    files.write_csv(videos.filter(~early), path, mode="append")
    return shown(FI.coerce_types(files.read_analysis_file(spark, path)))


@query
def sink_tsv_roundtrip(spark, sf):
    path = _folder(spark, "results")
    narrow = in_period(spark, sf).select("period", "channelId", "viewCount", "likeCount")
    files.write_results(E.explode_tiers(E.with_tiers(narrow)).drop("channelId"), path)
    schema = "viewCount long, likeCount long, period string, entity string, tier string"
    return files.read_results(spark, path, T._parse_datatype_string(schema))


# --- learning ---------------------------------------------------------------------

_MODELS: dict[tuple[str, str], TO.TopicModel] = {}


def topic_model(spark: SparkSession, sf: str) -> TO.TopicModel:
    """The stored model of these tables, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = TO.fit_topics(in_period(spark, sf), stop())
    return _MODELS[key]


@query
def lda_topic_terms(spark, sf):
    return TO.topic_terms(topic_model(spark, sf))


@query
def lda_topic_labels(spark, sf):
    return TO.topic_labels(topic_model(spark, sf))


@query
def lda_dominant_topic(spark, sf):
    return TO.dominant_topics(topic_model(spark, sf))


@query
def lda_representative_doc(spark, sf):
    return TO.representative_documents(topic_model(spark, sf), V.videos(spark, sf))


@query
def lda_topic_engagement(spark, sf):
    return TO.topic_engagement(topic_model(spark, sf), V.videos(spark, sf), examples=True)


@query
def lda_topic_totals(spark, sf):
    """What holds for any fitted model: videos add up, shares are whole, bounds rise, topics are few."""
    model = topic_model(spark, sf)
    table = TO.topic_engagement(model, V.videos(spark, sf))
    videos = table.groupBy("period", "entity").agg(F.sum("num_videos").alias("n"))
    share = sum((F.coalesce(f"p{i}", F.lit(0.0)) for i in range(1, TO.MAX_TOPICS)), F.col("p0"))
    shares = model.documents.groupBy("period", "entity").agg(
        F.max(F.abs(share - 1)).alias("off"), F.max("k").cast("bigint").alias("k"), F.min(F.least("p0", F.coalesce("p1", "p0"))).alias("lowest")
    )
    before = F.lag("bound").over(Window.partitionBy("period", "entity").orderBy("pass"))
    steps = model.bounds.withColumn("fall", (before - F.col("bound")) / F.abs(before))
    falls = steps.groupBy("period", "entity").agg(F.coalesce(F.max("fall"), F.lit(0.0)).alias("fall"))
    joined = videos.join(shares, ["period", "entity"]).join(falls, ["period", "entity"])
    whole, rises = (F.col("off") < 1e-9) & (F.col("lowest") > 0), F.col("fall") < 1e-4
    return joined.select("period", "entity", "n", "k", whole.alias("shares_whole"), rises.alias("bound_rises"))


@query
def lda_top_term_order(spark, sf):
    """Ranked terms of every topic: ranks without a gap, weights that never rise, no term twice."""
    terms = TO.topic_terms(topic_model(spark, sf))
    key = ["period", "entity", "topic"]
    own = Window.partitionBy(*key).orderBy("rank")
    steps = terms.withColumn("up", F.col("weight") - F.lag("weight").over(own))
    per_topic = steps.groupBy(*key).agg(
        F.max("rank").alias("last"), F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.max("up").alias("up")
    )
    good = (F.col("last") == F.col("n")) & (F.col("n") == F.col("terms")) & (F.coalesce("up", F.lit(0.0)) <= 0)
    return per_topic.groupBy("period", "entity").agg(F.count("*").alias("k"), F.min(good).alias("ordered"))


@query
def kmeans_engagement(spark, sf):
    rows = in_period(spark, sf).select("period", "channelId", "videoId", *schemas.METRICS)
    return cluster_engagement(rows)


# --- streaming --------------------------------------------------------------------

def _land(records: DataFrame, folder: str, offset: int, mark: str = "") -> None:
    """Land API records; ``mark`` goes in front of every title."""
    titled = F.replace(
        F.col("payload"), F.lit('"title":"'), F.lit(f'"title":"{mark}')
    )
    rows = records.select((F.col("doc_id") + offset).alias("seq"), titled.alias("payload"))
    rows.write.mode("append").json(folder)


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return shown(
        landed.read_table(spark, root, "videos").select(
            "videoId", "videoTitle", "viewCount", "commentCount", "publishedAt"
        )
    )


@query
def stream_upsert_videos(spark, sf):
    """All records arrive, then a third of them again with another title."""
    root = _folder(spark, "stream")
    records, folder = V.api_videos(spark, sf), f"{root}/landed"
    _land(records, folder, 0)
    ingest.upsert_stream(ingest.read_landed(spark, folder, 4), root, V.COLLECTED).awaitTermination()
    _land(records.filter("doc_id % 3 = 0"), folder, 0, "2 ")
    ingest.upsert_stream(ingest.read_landed(spark, folder, 4), root, V.COLLECTED).awaitTermination()
    return _stored(spark, root)


@query
def stream_two_jobs(spark, sf):
    """Two jobs with the same batch numbers on one root, then a replay."""
    root = _folder(spark, "stream")
    records = V.api_videos(spark, sf)
    rows = lambda part, mark: records.filter(f"doc_id % 3 {part}").select(
        F.col("doc_id").alias("seq"), F.replace("payload", F.lit('"title":"'), F.lit(f'"title":"{mark}')).alias("payload")
    )
    ingest.upsert_batch(root, V.COLLECTED, "first")(rows("< 2", ""), 0)
    ingest.upsert_batch(root, V.COLLECTED, "second")(rows("> 0", "2 "), 0)
    ingest.new_video_batch(root, V.COLLECTED, "third")(rows(">= 0", "3 "), 0)
    ingest.new_video_batch(root, V.COLLECTED, "third")(rows(">= 0", "3 "), 0)
    return _stored(spark, root)


@query
def stream_replay(spark, sf):
    """New videos stored in one batch, which then runs again: nothing is lost or doubled."""
    root = _folder(spark, "stream")
    records = V.api_videos(spark, sf).select(F.col("doc_id").alias("seq"), "payload")
    write = ingest.new_video_batch(root, V.COLLECTED, "new")
    write(records.filter("seq % 2 = 0"), 0)
    write(records, 1)
    write(records, 1)
    return _stored(spark, root)


@query
def stream_new_videos(spark, sf):
    """Even records arrive first; then all do, and only the odd ones are new."""
    root = _folder(spark, "stream")
    records, folder = V.api_videos(spark, sf), f"{root}/landed"
    _land(records.filter("doc_id % 2 = 0"), folder, 0)
    ingest.new_video_stream(ingest.read_landed(spark, folder), root, V.COLLECTED).awaitTermination()
    _land(records, folder, 0, "2 ")
    ingest.new_video_stream(ingest.read_landed(spark, folder), root, V.COLLECTED).awaitTermination()
    return _stored(spark, root)
