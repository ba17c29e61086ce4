"""Table and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()
_ts, _date, _b = T.TimestampType(), T.DateType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType(
        [T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields]
    )


CHANNELS = _struct(
    ("channelId", _s, False),
    ("channelName", _s, False),
    ("dayCollected", _date, False),
    ("numberOfSubscribers", _l),
    ("numberOfVideos", _l),
)

VIDEOS = _struct(
    ("videoId", _s, False),
    ("channelId", _s),
    ("videoTitle", _s, False),
    ("videoAudio", _s),
    ("videoTranscript", _s),
    ("viewCount", _l),
    ("likeCount", _l),
    ("commentCount", _l),
    ("publishedAt", _ts, False),
    ("collectedDate", _date, False),
    ("transcriptLanguage", _s),
)

COMMENTS = _struct(
    ("commentId", _s, False),
    ("videoId", _s, False),
    ("parentCommentId", _s),
    ("userId", _s, False),
    ("userName", _s, False),
    ("content", _s, False),
    ("likeCount", _l),
    ("publishedAt", _ts, False),
    ("collectedDate", _date, False),
)

#: Columns a table must not leave NULL, by table.
NOT_NULL = {
    name: [f.name for f in schema if not f.nullable]
    for name, schema in {
        "channels": CHANNELS,
        "videos": VIDEOS,
        "comments": COMMENTS,
    }.items()
}

CHANNEL_LIST_CSV = _struct(
    ("name", _s),
    ("url", _s),
    ("id", _s),
    ("numberOfVideos", _l),
    ("numberOfSubscribers", _l),
    ("dataCollected", _ts),
)

METRICS = ["viewCount", "likeCount", "commentCount"]

#: Layout of the file that the analyses read.
ANALYSIS = _struct(
    ("videoId", _s),
    ("channelId", _s),
    ("videoTitle", _s),
    ("videoTranscript", _s),
    ("publishedAt", _ts),
    ("transcriptLanguage", _s),
    ("viewCount", _l),
    ("likeCount", _l),
    ("commentCount", _l),
)
ANALYSIS_COLUMNS = ANALYSIS.fieldNames()

# --- landed API responses ---------------------------------------------------

API_CHANNEL_PAGE = _struct(
    (
        "items",
        T.ArrayType(
            _struct(
                ("id", _s),
                ("snippet", _struct(("title", _s))),
                (
                    "statistics",
                    _struct(("subscriberCount", _s), ("videoCount", _s)),
                ),
            )
        ),
    )
)

API_VIDEO = _struct(
    ("id", _s),
    ("snippet", _struct(("channelId", _s), ("title", _s), ("publishedAt", _s))),
    (
        "statistics",
        _struct(("viewCount", _s), ("likeCount", _s), ("commentCount", _s)),
    ),
)

# a response page of several records, or one bare record
API_VIDEO_PAGE = T.StructType([*API_VIDEO, T.StructField("items", T.ArrayType(API_VIDEO))])

API_PLAYLIST_PAGE = _struct(
    (
        "items",
        T.ArrayType(
            _struct(
                (
                    "snippet",
                    _struct(
                        ("publishedAt", _s),
                        ("resourceId", _struct(("videoId", _s))),
                    ),
                ),
                ("contentDetails", _struct(("videoId", _s))),
            )
        ),
    )
)

API_SEARCH_PAGE = _struct(
    (
        "items",
        T.ArrayType(_struct(("id", _struct(("kind", _s), ("videoId", _s))))),
    )
)

_comment = _struct(
    ("id", _s),
    (
        "snippet",
        _struct(
            ("authorChannelId", _struct(("value", _s))),
            ("authorDisplayName", _s),
            ("textDisplay", _s),
            ("likeCount", _l),
            ("publishedAt", _s),
        ),
    ),
)

API_THREAD = _struct(
    ("snippet", _struct(("topLevelComment", _comment))),
    ("replies", _struct(("comments", T.ArrayType(_comment)))),
)

API_THREAD_PAGE = T.StructType([*API_THREAD, T.StructField("items", T.ArrayType(API_THREAD))])

SNIPPETS = T.ArrayType(_struct(("start", _d), ("text", _s)))
