"""Parsing, files, the landed tables, streaming and the composed plans."""

import json

import pytest
from pyspark.sql import functions as F

from bindings import views as V
from reelgauge import schemas
from reelgauge.functions.stopwords import stopword_set
from reelgauge.operators import filters as FI
from reelgauge.operators import upsert as U
from reelgauge.plans import export, report
from reelgauge.plans.collect import collect
from reelgauge.sources import files, landed, records
from reelgauge.streaming import ingest

SF = "/root/testdata/sf0.001"


def pages(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "payload string")


def comment(key, text="t"):
    return {"id": key, "snippet": {
        "authorChannelId": {"value": "u"}, "authorDisplayName": "U", "textDisplay": text,
        "likeCount": 2, "publishedAt": "2022-11-01T00:00:00Z"}}


# --- records ------------------------------------------------------------------------

def test_video_record_without_counts(spark):
    record = {"id": "v", "snippet": {"channelId": "c", "title": "T", "publishedAt": "2022-11-01T01:02:03Z"},
              "statistics": {}}
    row = records.parse_videos(pages(spark, record), collected="2023-01-01").first()
    assert (row.viewCount, row.likeCount, row.commentCount, row.commentsEnabled) == (0, 0, 0, False)
    assert str(row.collectedDate) == "2023-01-01"


def test_thread_without_replies(spark):
    thread = {"snippet": {"topLevelComment": comment("a")}}
    full = {"snippet": {"topLevelComment": comment("b")}, "replies": {"comments": [comment("c"), comment("d")]}}
    df = pages(spark, thread, full).withColumn("videoId", F.lit("v"))
    found = {r.commentId: r.parentCommentId for r in records.flatten_threads(df).collect()}
    assert found == {"a": None, "b": None, "c": "b", "d": "b"}


def test_empty_pages(spark):
    assert records.parse_search(pages(spark, {}, {"items": []})).count() == 0
    assert records.parse_channels(pages(spark, {"items": [{"id": "c"}]})).first()["channelName"] == "N/A"


# --- files ----------------------------------------------------------------------------

def test_analysis_file_keeps_text(spark, tmp_path):
    texts = [' lead, "quoted" \n new\tline ', None, "a\\b", "x"]
    df = spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "videoId string, videoTranscript string")
    path = str(tmp_path / "f")
    files.write_csv(FI.ensure_columns(df, schemas.ANALYSIS), path)
    found = {r.videoId: r.videoTranscript for r in files.read_analysis_file(spark, path).collect()}
    assert found == {f"v{i}": t for i, t in enumerate(texts)}


def test_results_go_to_safe_folders(spark, tmp_path):
    df = spark.createDataFrame([("p 1", "A/B c", "high", "x y", 3)],
                               "period string, entity string, tier string, bigram string, frequency long")
    path = tmp_path / "r"
    files.write_results(df, str(path))
    assert (path / "period=p_1" / "entity=A-B_c" / "tier=high").is_dir()


def test_video_scan_reads_nine_columns(spark, tmp_path):
    path = str(tmp_path / "videos")
    V.stored_videos(spark, SF).write.parquet(path)
    df = files.read_videos(spark, path).filter("viewCount > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == schemas.ANALYSIS_COLUMNS
    assert "collectedDate" not in plan and "PushedFilters: [IsNotNull(viewCount), GreaterThan(viewCount,5)]" in plan


# --- landed tables -----------------------------------------------------------------------

def video_rows(spark, *rows):
    df = spark.createDataFrame(rows, "videoId string, videoTitle string, videoTranscript string, seq long")
    return df.withColumns({
        "publishedAt": F.lit("2022-11-01").cast("timestamp"),
        "collectedDate": F.lit("2022-11-01").cast("date"),
        **{c: F.lit(None).cast("string") for c in ("channelId", "videoAudio", "transcriptLanguage")},
        **{c: F.lit(1).cast("long") for c in schemas.METRICS},
    })


def titles(df):
    return {r.videoId: (r.videoTitle, r.videoTranscript) for r in df.collect()}


def test_batches_apply_in_order(spark, tmp_path):
    root = str(tmp_path / "t")
    landed.commit_batch(root, 0, {"videos": video_rows(spark, ("a", "1", "x", 5), ("b", "1", None, 6))})
    landed.commit_batch(root, 1, {"videos": video_rows(spark, ("a", "2", None, 1))})
    expected = {"a": ("2", "x"), "b": ("1", None)}
    assert titles(landed.read_table(spark, root, "videos")) == expected
    # a repeated batch changes nothing and keeps its place, a later one counts on top
    landed.commit_batch(root, 0, {"videos": video_rows(spark, ("a", "1", "x", 5), ("b", "1", None, 6))})
    assert titles(landed.read_table(spark, root, "videos")) == expected
    landed.commit_batch(root, 1, {"videos": video_rows(spark, ("a", "2", None, 1))})
    landed.commit_batch(root, 2, {"videos": video_rows(spark, ("b", "3", "y", 1), ("c", "3", None, 2))})
    assert titles(landed.read_table(spark, root, "videos")) == {
        "a": ("2", "x"), "b": ("3", "y"), "c": ("3", None)}
    assert sorted(r.videoId for r in landed.read_ids(spark, root).collect()) == ["a", "b", "c"]


def test_uncommitted_batch_is_invisible(spark, tmp_path):
    root = str(tmp_path / "t")
    assert landed.read_table(spark, root, "videos").count() == 0
    assert landed.read_ids(spark, root).count() == 0
    landed.commit_batch(root, 0, {"videos": video_rows(spark, ("a", "1", None, 1))})
    # a write that failed leaves nothing of its batch, be it new or run again
    broken = video_rows(spark, ("z", "1", None, 1)).withColumn("videoTitle", F.raise_error(F.lit("lost")))
    for number in (0, 1):
        with pytest.raises(Exception, match="lost"):
            landed.commit_batch(root, number, {"videos": broken})
    # nor does a staging folder that its writer left behind count
    video_rows(spark, ("y", "1", None, 1)).write.parquet(f"{root}/videos/.spark-staging-x/job=manual/number=1")
    assert set(titles(landed.read_table(spark, root, "videos"))) == {"a"}


def test_stream_equals_batch(spark, tmp_path):
    root, folder = str(tmp_path / "s"), str(tmp_path / "in")
    api = V.api_videos(spark, SF)
    api.select(F.col("doc_id").alias("seq"), "payload").repartition(5).write.json(folder)
    ingest.upsert_stream(ingest.read_landed(spark, folder, 2), root, V.COLLECTED).awaitTermination()
    parsed = records.parse_videos(api.withColumnRenamed("doc_id", "seq"), collected=V.COLLECTED)
    empty = spark.createDataFrame([], schemas.VIDEOS)
    batch = U.upsert_videos(empty, parsed)
    stream = landed.read_table(spark, root, "videos")
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))
    # nothing new: running again stores nothing
    ingest.upsert_stream(ingest.read_landed(spark, folder, 2), root, V.COLLECTED).awaitTermination()
    assert stream.count() == landed.read_table(spark, root, "videos").count()


# --- plans -------------------------------------------------------------------------------

def test_collect_run(spark, tmp_path):
    root = str(tmp_path / "c")

    def item(key, day):
        return {"snippet": {"publishedAt": f"2022-11-{day:02d}T00:00:00Z"}, "contentDetails": {"videoId": key}}

    def video(key, comments=True):
        counts = {"viewCount": "5"} | ({"commentCount": "1"} if comments else {})
        return {"id": key, "snippet": {"channelId": "c", "title": key.upper(), "publishedAt": "2022-11-02T00:00:00Z"},
                "statistics": counts}

    playlists = pages(spark, {"items": [item("a", 2), item("b", 3), item("late", 29), item("gone", 4)]})
    videos = pages(spark, video("a"), video("b", comments=False), video("late"))
    threads = spark.createDataFrame(
        [(v, json.dumps({"snippet": {"topLevelComment": comment(f"{v}1")}})) for v in ("a", "b")],
        "videoId string, payload string")
    channels = pages(spark, {"items": [{"id": "c", "snippet": {"title": "C"}, "statistics": {"subscriberCount": "9"}}]})
    texts = spark.createDataFrame([("a", "en", 1, "english"), ("a", "pt", 2, "português")],
                                  "videoId string, language string, seq long, text string")
    for number in (0, 1):
        collect(spark, root, number, playlists, videos, threads, channels, texts, "2023-01-01",
                "2022-11-01T00:00:00Z", "2022-11-20T00:00:00Z")
    stored = titles(landed.read_table(spark, root, "videos"))
    assert stored == {"a": ("A", "português"), "b": ("B", None)}
    # comments only where they are enabled; the second run found nothing new
    assert [r.commentId for r in landed.read_table(spark, root, "comments").collect()] == ["a1"]
    assert landed.read_table(spark, root, "channels").first()["numberOfSubscribers"] == 9


def test_report_tables(spark, tmp_path):
    names = V.channels(spark, SF)
    tables = report.period_report(V.videos(spark, SF), stopword_set(V.LANGS), names=names)
    assert set(tables) == {"tiers", "bigrams", "topics", "clusters"}
    report.write_report(tables, str(tmp_path / "out"))
    assert (tmp_path / "out" / "bigrams" / "period=nov-dec_2022" / "entity=Channel_src3").is_dir()
    assert (tmp_path / "out" / "bigrams" / "period=nov-dec_2022" / "entity=ALL").is_dir()


def test_report_reads_texts_once(spark, tmp_path):
    path = str(tmp_path / "videos")
    V.videos(spark, SF).write.parquet(path)
    videos = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stop = stopword_set(V.LANGS)
    rows = report.tokenised_rows(report.analysis_rows(videos), list(stop))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(publishedAt" in plan
    assert plan.count("regexp_extract_all") == 1
    tables = report.period_report(videos, stop, parts=("tiers", "bigrams"), names=V.channels(spark, SF))
    for table in tables.values():
        # what the parts read is the stored table, never the texts of the source again
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert path not in plan and "videoTranscript" not in plan
    # equal names stay apart by their ids
    assert {"entity", "entityId"} <= set(tables["tiers"].columns)
    with pytest.raises(ValueError, match="orders the corpus"):
        report.period_report(videos, stop, ties="first_seen")
    with pytest.raises(ValueError, match="not parts"):
        report.period_report(videos, stop, parts=("tier",))


def test_export_window(spark, tmp_path):
    path = str(tmp_path / "export")
    export.export_window(V.videos(spark, SF), path, stopword_set(V.LANGS))
    back = FI.coerce_types(files.read_analysis_file(spark, path))
    assert back.columns == schemas.ANALYSIS_COLUMNS
    assert back.count() == V.videos(spark, SF).count()


def test_lemmatiser_hook(spark):
    df = spark.createDataFrame([("v", "Gatos correm")], "videoId string, videoTranscript string")
    rows = FI.ensure_columns(df, schemas.ANALYSIS)
    upper = lambda tokens: F.transform(tokens, lambda t: F.concat(t, F.lit("x")))
    cleaned = export.clean_transcripts(rows, [], lemmatiser=upper).first()
    assert cleaned.cleanTranscript == "gatosx corremx" and cleaned.viewCount == 0
    lemmas = spark.createDataFrame([("Gatos", "gato")], "term string, lemma string")
    exported = export.export_transcripts(rows, [], lemmas=lemmas).first()
    assert exported.videoTranscript == "gato correm"


@pytest.mark.parametrize("name", ["top_bigrams", "bigram_counts"])
def test_tokens_are_computed_once(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_top_k_is_trimmed_before_the_exchange(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["top_bigrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 15, Partial" in plan


def test_jobs_share_a_root(spark, tmp_path):
    root = str(tmp_path / "jobs")
    landed.commit_batch(root, 2, {"videos": video_rows(spark, ("a", "1", "x", 5))}, "one")
    # same and lower numbers of another job
    landed.commit_batch(root, 2, {"videos": video_rows(spark, ("b", "1", None, 1))}, "two")
    landed.commit_batch(root, 0, {"videos": video_rows(spark, ("c", "1", None, 1))}, "two")
    assert set(titles(landed.read_table(spark, root, "videos"))) == {"a", "b", "c"}
    landed.commit_batch(root, 1, {"videos": video_rows(spark, ("d", "1", None, 1))}, "one")
    assert set(titles(landed.read_table(spark, root, "videos"))) == {"a", "b", "c", "d"}
    with pytest.raises(ValueError, match="name"):
        landed.commit_batch(root, 1, {"videos": video_rows(spark, ("d", "1", None, 1))}, "a/b")


def test_replay_after_another_job(spark, tmp_path):
    root = str(tmp_path / "late")
    first = {"videos": video_rows(spark, ("a", "old", "x", 1))}
    landed.commit_batch(root, 7, first, "one")
    landed.commit_batch(root, 0, {"videos": video_rows(spark, ("a", "new", None, 1))}, "two")
    landed.commit_batch(root, 7, first, "one")
    assert titles(landed.read_table(spark, root, "videos")) == {"a": ("new", "x")}
    # a run that yields fewer rows replaces those of the one before
    both = {"videos": video_rows(spark, ("b", "1", None, 1), ("c", "1", None, 2))}
    landed.commit_batch(root, 1, both, "two")
    landed.commit_batch(root, 1, {"videos": video_rows(spark, ("c", "1", None, 2))}, "two")
    assert sorted(r.videoId for r in landed.read_ids(spark, root).collect()) == ["a", "c"]
    assert [r.videoId for r in landed.read_ids(spark, root, without=("two", 1)).collect()] == ["a"]
    plan = landed.read_ids(spark, root, without=("two", 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ReadSchema: struct<videoId:string>" in plan


def test_batch_that_runs_again(spark, tmp_path):
    root = str(tmp_path / "again")
    page = '{"items": [{"id": "a", "snippet": {"title": "A"}}, {"id": "b"}, {"snippet": {"title": "no id"}}]}'
    batch = spark.createDataFrame([(1, page), (2, '{"id": "c"}')], "seq long, payload string")
    for write in (ingest.new_video_batch(root, V.COLLECTED, "new"), ingest.upsert_batch(root, V.COLLECTED, "up")):
        for _ in range(2):
            write(batch, 0)
            assert sorted(r.videoId for r in landed.read_ids(spark, root).collect()) == ["a", "b", "c"]
    assert [r.seq for r in records.without_id(batch).collect()] == [1]


def test_pages_of_threads(spark):
    comment = lambda i: {"id": i, "snippet": {"textDisplay": i}}
    thread = lambda i, *replies: {"snippet": {"topLevelComment": comment(i)}, "replies": {"comments": [comment(r) for r in replies]}}
    rows = [("v", json.dumps({"items": [thread("a", "a1"), thread("b")]})), ("w", json.dumps(thread("c", "c1")))]
    flat = records.flatten_threads(spark.createDataFrame(rows, "videoId string, payload string")).collect()
    assert sorted((r.commentId, r.videoId, r.parentCommentId) for r in flat) == [
        ("a", "v", None), ("a1", "v", "a"), ("b", "v", None), ("c", "w", None), ("c1", "w", "c"),
    ]


def test_months_are_pruned(spark, tmp_path):
    from reelgauge.operators.engagement import assign_periods

    path, rows = str(tmp_path / "months"), V.videos(spark, SF)
    files.write_by_month(rows.withColumn("publishedAt", F.when(F.col("doc_id") != 3, F.col("publishedAt"))), path)
    months = sorted(p.name for p in (tmp_path / "months").iterdir() if p.name.startswith("publishMonth"))
    assert "publishMonth=2022-12-01" in months and "publishMonth=__HIVE_DEFAULT_PARTITION__" in months
    stored = files.read_by_month(spark, path, rows.schema)
    assert stored.count() == rows.count()

    def months_read(df):
        return {f.split("publishMonth=")[1].split("/")[0] for f in df.select("_metadata.file_path").distinct().toPandas().file_path}

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    window = FI.between(stored, "2022-12-20", "2023-01-01", "left")
    plan = window._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "publishMonth" in pushed and "2022-12-01" in pushed
    assert months_read(window) == {"2022-12-01"}
    plan = assign_periods(stored)._jdf.queryExecution().executedPlan().toString()
    assert "publishMonth" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    same = lambda df: sorted(map(str, df.select(*rows.columns).collect()))
    kept = rows.filter("doc_id != 3")
    assert same(window) == same(FI.between(kept, "2022-12-20", "2023-01-01", "left"))
    # one open bound, and no bound at all
    assert same(FI.between(stored, start="2023-01-19")) == same(FI.between(kept, start="2023-01-19"))
    assert FI.between(stored).count() == rows.count()


def test_time_filter_reaches_the_scan(spark, tmp_path):
    from reelgauge.operators.filters import between, coerce_types

    path = str(tmp_path / "typed")
    spark.sql("select 'a' as videoId, timestamp'2022-01-02' as publishedAt, 1L as viewCount, 2L as likeCount, 3L as commentCount").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = between(coerce_types(spark.read.parquet(path)), "2022-01-01", "2022-02-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(publishedAt" in plan and "LessThanOrEqual(publishedAt" in plan


def test_spread_grows_with_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table.parquet")
    spark.range(20_000).selectExpr("id", "uuid() as text").repartition(2).write.parquet(path)
    monkeypatch.setattr(files, "SPREAD_BYTES", 100_000, raising=False)
    # few files: more tasks for more bytes; at least as many files as wanted tasks: no exchange
    assert files.read_spread(spark, path, 3).rdd.getNumPartitions() > 5
    plain = files.read_spread(spark, path, 2)
    assert "Exchange" not in plain._jdf.queryExecution().toString() and plain.count() == 20_000


def test_report_without_topics_stores_no_text(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(report, "materialise", lambda df: kept.append(df) or df)
    rows = [("v1", "c", "t", "gato cachorro pata", 1, 1, 1, "2022-11-02 00:00:00"), ("v2", "c", "t", "gato cachorro lua", 2, 1, 1, "2022-11-03 00:00:00")]
    df = spark.createDataFrame(rows, "videoId string, channelId string, videoTitle string, videoTranscript string, viewCount long, likeCount long, commentCount long, publishedAt string")
    tables = report.period_report(df, stopword_set(("pt",)), parts=("tiers", "bigrams"))
    assert "videoTranscript" not in kept[0].columns and tables["bigrams"].count() > 0
