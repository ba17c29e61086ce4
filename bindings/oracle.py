"""DuckDB statements equal to the registered queries, over the same tables.

Shared views are written once in ``VIEWS``; ``sql(body)`` puts those a body uses
in front of it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from bindings import views as V
from bindings.queries import stop
from reelgauge.functions import stopwords as S

# Name, first and last midnight of each period.
PERIODS = (
    ("nov-dec 2022", "2022-11-01", "2022-12-31"),
    ("early jan 2023", "2023-01-06", "2023-01-18"),
    ("late jan 2023 on", "2023-01-19", "2023-03-01"),
)

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
BRACKET_TIME = r"\[\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\]"
BARE_TIME = r"\b\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\b"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
INNER = r"(\p{L})[,/:<>=](\p{L})"
TS = "'%Y-%m-%d %H:%M:%S'"
RFC = "'%Y-%m-%dT%H:%M:%SZ'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stamp(column: str) -> str:
    return f'strftime({column}, {TS}) as "publishedAt"'


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def _clean_basic(x: str) -> str:
    step = f"translate(coalesce({x}, ''), chr(10) || chr(13), '  ')"
    step = f"regexp_replace({step}, '{BRACKET_TIME}', ' ', 'g')"
    return _squeeze(f"lower(regexp_replace({step}, '{URL}', ' ', 'g'))")


def _clean_export(x: str) -> str:
    step = f"regexp_replace(coalesce({x}, ''), '{BRACKET_TIME}', '', 'g')"
    step = f"regexp_replace({step}, '{BARE_TIME}', '', 'g')"
    return _squeeze(f"translate({step}, chr(10) || chr(13), '  ')")


def _ascii(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7f]', '', 'g')"


def _ladder(kind: str) -> str:
    """(status, language) of an error message for either set of rules."""
    m = "lower(message)"
    age = f"contains({m}, 'age') and (contains({m}, 'restrict') or contains({m}, 'content'))"
    none = "kind in ('NoTranscriptFound', 'TranscriptsDisabled')"
    rules = [
        (f"contains({m}, 'private')", "'VIDEO_UNAVAILABLE: Video is private'"),
        (f"contains({m}, 'deleted')", "'VIDEO_UNAVAILABLE: Video has been deleted'"),
    ]
    if kind == "precheck":
        rules += [
            (f"contains({m}, 'removed')", "'VIDEO_UNAVAILABLE: Video has been removed'"),
            (f"contains({m}, 'unavailable')", "'VIDEO_UNAVAILABLE: Video is unavailable'"),
            (age, "'VIDEO_UNAVAILABLE: Video is age-restricted'"),
        ]
        other, lang = "'VIDEO_UNAVAILABLE: ' || message", "'unavailable'"
    else:
        rules += [
            (f"contains({m}, 'unavailable') or contains({m}, 'no longer available')", "'VIDEO_UNAVAILABLE: Video is unavailable'"),
            (age, "'VIDEO_UNAVAILABLE: Video is age-restricted'"),
            (f"contains({m}, 'copyright')", "'VIDEO_UNAVAILABLE: Video has copyright issues'"),
        ]
        other, lang = "'ERROR: ' || message", "'error'"
    text = " ".join(f"when {c} then {v}" for c, v in rules)
    hit = " or ".join(f"({c})" for c, _ in rules)
    if kind == "precheck":
        text = f"when {none} then 'TRANSCRIPT_UNAVAILABLE: No transcript available for this video' {text}"
        hit = f"{none} then 'not_available' when {hit}"
    return (
        f"case {text} else {other} end as status, "
        f"case when {hit} then 'unavailable' else {lang} end as language"
    )


def _batch_part(step: int, key: str, where: str) -> str:
    return f"""select {key} as "videoId", "channelId" || '-{step}' as "channelId",
      "videoTitle" || ' /{step}' as "videoTitle", 'a/' || doc_id as "videoAudio",
      case when (doc_id + {step}) % 2 = 1 then 'new{step} ' || "videoTitle" end as "videoTranscript",
      "viewCount" + {step} * 1000 as "viewCount", "likeCount" + {step} as "likeCount",
      "commentCount" + {step} as "commentCount", "publishedAt" + interval {step} hour as "publishedAt",
      '{V.RECOLLECTED}' as "collectedDate",
      case when (doc_id + {step}) % 2 = 1 then 'xx' end as "transcriptLanguage",
      doc_id * 10 + {step} as seq from v_videos where doc_id % 3 = 0 {where}"""


def _comment_part(step: int, key: str, where: str) -> str:
    return f"""select {key} as "commentId", 'w' || conv_id || '{step}' as "videoId",
      case when turn > 1 then conv_id || ':{step}' end as "parentCommentId",
      'x{step}_' || role as "userId", 'X{step} ' || role as "userName",
      'edit {step} ' || text as content, turn + {step} as "likeCount",
      make_timestamp(({V.BASE}::bigint + {step} * 60) * 1000000) as "publishedAt",
      '{V.RECOLLECTED}' as "collectedDate",
      conv_id * 1000 + turn * 10 + {step} as seq from conversations where {where}"""


def _values(words: list[str]) -> str:
    return "values " + ", ".join(f"({_q(w)})" for w in words)


@lru_cache(maxsize=1)
def views() -> dict[str, str]:
    periods = ", ".join(
        f"({_q(name)}, timestamp {_q(start)}, timestamp {_q(end)})" for name, start, end in PERIODS
    )
    lang_words = ", ".join(
        f"({_q(lang)}, {_q(w)})" for lang in V.LANGS for w in S.language_list(lang)
    )
    errors = ", ".join(map(_q, V.ERRORS))
    text = '"videoTranscript"'
    return {
        "v_videos": f"""select doc_id, 'v' || doc_id as "videoId", source as "channelId",
          substring(text, 1, 40) as "videoTitle", cast(null as varchar) as "videoAudio",
          text as "videoTranscript", cast(n_chars as bigint) as "viewCount",
          cast(doc_id * 37 % 1000 as bigint) as "likeCount",
          cast(doc_id * 11 % 100 as bigint) as "commentCount",
          make_timestamp(({V.BASE} + doc_id % 121 * 86400 + doc_id % 24 * 3600) * 1000000) as "publishedAt",
          '{V.COLLECTED}' as "collectedDate", lang as "transcriptLanguage", doc_id as ingest_seq
          from documents""",
        "v_channels": """select distinct source as "channelId", 'Channel ' || source as "channelName"
          from documents where source <> 'src7'""",
        "v_comments": f"""select conv_id || ':' || turn as "commentId", 'v' || conv_id as "videoId",
          case when turn > 0 then conv_id || ':0' end as "parentCommentId", 'u_' || role as "userId",
          role as "userName", text as content, cast(length(text) % 50 as bigint) as "likeCount",
          make_timestamp(({V.BASE} + conv_id * 86400 + turn * 60) * 1000000) as "publishedAt",
          '{V.COLLECTED}' as "collectedDate" from conversations""",
        "v_batch": " union all ".join(
            [
                _batch_part(1, '"videoId"', ""),
                _batch_part(2, '"videoId"', "and doc_id % 15 = 0"),
                _batch_part(3, "'n' || doc_id", ""),
                _batch_part(4, "'n' || doc_id", "and doc_id % 15 = 0"),
            ]
        ),
        "v_comment_batch": " union all ".join(
            [
                _comment_part(1, "conv_id || ':' || turn", "turn % 2 = 0"),
                _comment_part(2, "conv_id || ':' || turn", "turn = 0"),
                _comment_part(3, "'n' || conv_id || ':' || turn", "turn = 1"),
            ]
        ),
        "v_all_comments": """select "commentId", "parentCommentId", "userId", content from v_comments union all
          select seq || '/' || "commentId", "parentCommentId", "userId", content from v_comment_batch""",
        "v_periods": f"select * from (values {periods}) t(period, period_start, period_end)",
        "v_in_period": """select v.*, p.period from v_videos v join v_periods p
          on v."publishedAt" between p.period_start and p.period_end""",
        "v_entities": """select *, 'ALL' as entity from v_in_period union all
          select *, "channelId" as entity from v_in_period""",
        "v_thresholds": """select period, entity, count(*) as n,
          cast(case when count(*) <= 3 then min("viewCount") else quantile_cont("viewCount", 0.75) end as double) as high,
          cast(case when count(*) <= 3 then min("viewCount") - 1 else quantile_cont("viewCount", 0.25) end as double) as low
          from v_entities group by 1, 2""",
        "v_tiers": """select e.*, 'high' as tier from v_entities e join v_thresholds t using (period, entity)
          where "viewCount" >= high union all
          select e.*, 'low' as tier from v_entities e join v_thresholds t using (period, entity)
          where "viewCount" <= low""",
        "v_stop": f"select * from ({_values(stop())}) t(word)",
        "v_stopwords": f"select * from (values {lang_words}) t(lang, word)",
        "v_timed": f"""select * exclude ("videoTranscript"),
          array_to_string(list_transform(string_split("videoTranscript", chr(10)),
            lambda line, i: format('[{{:02d}}:{{:02d}}] {{}}', (i - 1) * 3, (i - 1) % 60, line)), chr(10))
          || ' 9:59 at [01:02:33] see https://a.example/v?id=' || doc_id || ' or www.b.example/x [Mark] end'
          as "videoTranscript" from v_videos""",
        "v_words": f"""select doc_id, "videoId", pos, word from (select doc_id, "videoId",
          unnest(string_split({_squeeze(text)}, ' ')) as word,
          unnest(range(1, len(string_split({_squeeze(text)}, ' ')) + 1)) as pos from v_videos)
          where word <> ''""",
        "v_kept_words": "select * from v_words where lower(word) not in (select word from v_stop)",
        "v_tokens": f"""select doc_id, "videoId", pos, sub, token from (select doc_id, "videoId", pos,
          unnest(regexp_extract_all(lower(word), '{TOKEN}')) as token,
          unnest(range(1, len(regexp_extract_all(lower(word), '{TOKEN}')) + 1)) as sub from v_kept_words)
          where token not in (select word from v_stop)""",
        "v_bigrams": """select doc_id, "videoId", spot, token || ' ' || next_token as bigram from (
          select doc_id, "videoId", token, row_number() over w as spot, lead(token) over w as next_token from v_tokens
          window w as (partition by doc_id order by pos, sub)) where next_token is not null""",
        "v_raw_tokens": f"""select doc_id, "videoId", "channelId", "transcriptLanguage" as lang,
          unnest(regexp_extract_all(lower("videoTranscript"), '{TOKEN}')) as token,
          unnest(range(1, len(regexp_extract_all(lower("videoTranscript"), '{TOKEN}')) + 1)) as pos
          from v_videos""",
        "v_errors": f"""select 'v' || doc_id as "videoId", doc_id,
          ([{errors}])[doc_id % {len(V.ERRORS)} + 1] as message,
          ([null, 'NoTranscriptFound', 'TranscriptsDisabled', 'IpBlocked'])[doc_id // {len(V.ERRORS)} % 4 + 1] as kind
          from documents""",
        "v_gaps": """select doc_id, "videoId", "channelId", "publishedAt", ingest_seq,
          case when doc_id % 3 = 0 then null when doc_id % 11 = 0 then '' else "videoTranscript" end as "videoTranscript",
          case when doc_id % 3 = 0 then null else "transcriptLanguage" end as "transcriptLanguage",
          case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else 'audio/' || "videoId" || '.mp3' end
          as "videoAudio" from v_videos""",
        "v_channel_list": f"""select case when s_suppkey % 6 <> 0 then s_name end as name,
          case when s_suppkey % 6 <> 0 then 'https://c.example/' || s_suppkey end as url,
          case when s_suppkey % 6 <> 0 then 'UC' || s_suppkey when s_suppkey % 12 = 0 then '' end as id,
          case when s_suppkey % 6 <> 0 then cast(s_suppkey as bigint) end as "numberOfVideos",
          case when s_suppkey % 6 <> 0 then cast(s_suppkey * 3 as bigint) end as "numberOfSubscribers",
          case when s_suppkey % 6 <> 0 then strftime(make_timestamp(({V.BASE} + s_suppkey) * 1000000), {TS}) end
          as "dataCollected" from supplier""",
        "v_yearly": """select c.*, coalesce(s.s_suppkey * 2, 0) as "videos2025",
          coalesce(s.s_suppkey * 5, 0) as "inscritos2025",
          case when s.s_suppkey is not null then '2025-05-25 09:43:51' end as "dataColetada2025"
          from v_channel_list c left join (select * from supplier where s_suppkey % 7 <> 0) s
          on c.id = 'UC' || s.s_suppkey""",
        "v_options": """select 'v' || conv_id as "videoId",
          (['fr', 'en', 'pt-BR', 'pt', 'de'])[(conv_id + turn) % 5 + 1] as language, turn as seq, text
          from conversations""",
        "v_files": """select 'v.' || conv_id || '.' || case when turn % 4 = 3 then 'en' else 'pt' end || '.' ||
          (['srv1', 'json3', 'srt', 'vtt', 'srv3', 'srv2'])[(conv_id * 5 + turn) % 6 + 1] as file from conversations""",
        "v_search": """select "videoId" from v_videos where doc_id % 3 <> 0
          union all select "videoId" || 'b' from v_videos""",
        "v_lines": """select doc_id, "videoId", "publishedAt", unnest(string_split("videoTranscript", chr(10))) as line,
          unnest(range(0, len(string_split("videoTranscript", chr(10))))) as pos from v_videos""",
        "v_term_counts": """select "videoId", token as term, count(*) as n from v_raw_tokens group by 1, 2""",
    }


def sql(body: str) -> str:
    """``body`` with the views it needs, each in front of its users."""
    defined = views()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in defined and name not in needed:
                visit(defined[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = [f"{n} as materialized ({defined[n]})" for n in needed]
    return "with " + ",\n".join(parts) + "\n" + body


_METRIC_STATS = ", ".join(
    f'round(avg("{m}"), 6) as "mean_{m}", max("{m}") as "max_{m}"'
    for m in ("viewCount", "likeCount", "commentCount")
)
_KEEP_LATEST = {
    "overwrite": 'arg_max_null("{c}", seq)',
    "fill": 'arg_max("{c}", seq)',
    "keep": 'arg_min_null("{c}", seq)',
}


def _upsert(key: str, target: str, batch: str, **columns: str) -> str:
    names = [key, *[c for group in columns.values() for c in group.split()]]
    cols = ", ".join(f'"{c}"' for c in names)
    picks = ", ".join(
        _KEEP_LATEST[kind].format(c=c) + f' as "{c}"'
        for kind, group in columns.items()
        for c in group.split()
    )
    out = ", ".join(
        f"strftime(\"{c}\", {TS}) as \"{c}\"" if c == "publishedAt" else f'"{c}"' for c in names
    )
    return f"""select {out} from (select "{key}", {picks} from (
      select {cols}, -1 as seq from {target} union all select {cols}, seq from {batch})
      group by "{key}")"""


def _period_z(m: str) -> str:
    dev = f'stddev_pop("{m}") over w'
    return f"""round(case when {dev} = 0 then 0 else ("{m}" - avg("{m}") over w) / {dev} end, 6) as "z_{m}" """


def _regroup(source: str, expr: str, order: str, name: str) -> str:
    """One text per video from rows of words, empty where none is left."""
    return f"""select v."videoId", coalesce(t.text, '') as {name} from v_videos v left join (
      select "videoId", string_agg({expr}, ' ' order by {order}) as text from {source} group by 1) t
      on v."videoId" = t."videoId" """


def _strict_words(source: str = "v_timed") -> str:
    bare = "regexp_replace(translate(lower(\"videoTranscript\"), '[]', ''), '\\p{Nd}+', '', 'g')"
    split = f"string_split({_squeeze(bare)}, ' ')"
    return f"""(select * from (select "videoId", unnest({split}) as word,
      unnest(range(1, len({split}) + 1)) as pos from {source})
      where word <> '' and word not in (select word from v_stop))"""


def _pieces(clean: str, source: str) -> str:
    # twice, as neighbours share their letter in "a,b,c"
    apart = f"regexp_replace({clean}, '{INNER}', '\\1 \\2', 'g')"
    split = f"string_split(regexp_replace({apart}, '{INNER}', '\\1 \\2', 'g'), ' ')"
    return f"""(select "videoId", pos, regexp_replace(word, '{EDGE}', '', 'g') as word from (
      select "videoId", unnest({split}) as word, unnest(range(1, len({split}) + 1)) as pos from {source}))"""


_CONTENT = f"""length(word) > 2 and word not in (select word from v_stop)
  and {_ascii('word')} not in (select word from v_stop)"""
_ALPHA = r"regexp_matches(word, '^\p{L}+$')"
_TIMED_COLUMNS = f""" "channelId", "videoTitle", {_stamp('v."publishedAt"')}, "transcriptLanguage",
  "viewCount", "likeCount", "commentCount" """


def _stream(marked: str) -> str:
    return f"""select "videoId", case when {marked} then '2 ' || "videoTitle" else "videoTitle" end as "videoTitle",
      "viewCount", case when doc_id % 10 <> 0 then "commentCount" else 0 end as "commentCount",
      {_stamp('"publishedAt"')} from v_videos"""


def statements() -> dict[str, str]:
    text = '"videoTranscript"'
    bodies = {
        "scan_videos": f"""select "videoId", "channelId", "videoTitle", "videoTranscript", {_stamp('"publishedAt"')},
          "transcriptLanguage", "viewCount", "likeCount", "commentCount" from v_videos""",
        "api_channels_parse": """select 'UC' || s_suppkey as "channelId",
          case when s_suppkey % 9 <> 0 then s_name else 'N/A' end as "channelName",
          cast(case when s_suppkey % 5 <> 0 then s_suppkey * 101 else 0 end as bigint) as "numberOfSubscribers",
          cast(case when s_suppkey % 4 <> 0 then s_suppkey * 7 else 0 end as bigint) as "numberOfVideos" from supplier""",
        "api_videos_parse": f"""select "videoId", "channelId", "videoTitle", "viewCount",
          case when doc_id % 7 <> 0 then "likeCount" else 0 end as "likeCount",
          case when doc_id % 10 <> 0 then "commentCount" else 0 end as "commentCount",
          {_stamp('"publishedAt"')}, "collectedDate", doc_id % 10 <> 0 as "commentsEnabled" from v_videos""",
        "comment_fetch_list": 'select "videoId", "commentCount" from v_videos where doc_id % 10 <> 0',
        "api_playlist_parse": f"""select "videoId", {_stamp('"publishedAt"')} from v_videos union all
          select "videoId" || 'b' as "videoId", {_stamp('"publishedAt"')} from v_videos""",
        "api_search_parse": "select * from v_search",
        "comments_flatten": f"""select doc_id || ':' || pos as "commentId", "videoId",
          case when pos > 0 then doc_id || ':0' end as "parentCommentId", 'u' || (pos % 5) as "userId",
          'User ' || (pos % 5) as "userName", line as content, cast(length(line) as bigint) as "likeCount",
          {_stamp('"publishedAt"')}, '{V.COLLECTED}' as "collectedDate" from v_lines""",
        "dq_pk": 'select "videoId", count(*) as rows from v_batch group by 1 having count(*) > 1',
        "dq_not_null": """select 'videoId' as "column", count(*) - count("videoId") as nulls from v_batch
          union all select 'videoTitle', count(*) - count("videoTitle") from v_batch
          union all select 'videoTranscript', count(*) - count("videoTranscript") from v_batch
          union all select 'publishedAt', count(*) - count("publishedAt") from v_batch""",
        "dq_orphans": """select 'video-channel' as relation, "channelId" as key, count(*) as rows from v_videos
          where "channelId" not in (select "channelId" from v_channels) group by 2
          union all select 'comment-video', "videoId", count(*) from (
            select "videoId" from v_comments union all select "videoId" from v_comment_batch)
          where "videoId" not in (select "videoId" from v_videos) group by 2
          union all select 'reply-parent', "parentCommentId", count(*) from (
            select "parentCommentId" from v_comments union all select "parentCommentId" from v_comment_batch)
          where "parentCommentId" is not null and "parentCommentId" not in (
            select "commentId" from v_comments union all select "commentId" from v_comment_batch) group by 2""",
        "upsert_videos": _upsert(
            "videoId", "v_videos", "v_batch",
            overwrite="videoTitle viewCount likeCount commentCount collectedDate",
            fill="videoTranscript transcriptLanguage",
            keep="channelId videoAudio publishedAt",
        ),
        "upsert_comments": _upsert(
            "commentId", "v_comments", "v_comment_batch",
            overwrite="content likeCount collectedDate",
            keep="videoId parentCommentId userId userName publishedAt",
        ),
        "upsert_channels": f"""select 'UC' || s_suppkey as "channelId",
            case when s_suppkey % 4 = 0 then s_name || ' renamed' else s_name end as "channelName",
            case when s_suppkey % 4 = 0 then '{V.RECOLLECTED}' else '{V.COLLECTED}' end as "dayCollected",
            cast(case when s_suppkey % 4 = 0 then null else s_suppkey * 3 end as bigint) as "numberOfSubscribers",
            cast(case when s_suppkey % 4 = 0 then s_suppkey * 2 else s_suppkey end as bigint) as "numberOfVideos"
            from supplier
          union all select 'NEW' || s_suppkey, s_name || ' renamed', '{V.RECOLLECTED}', null,
            cast(s_suppkey * 2 as bigint) from supplier where s_suppkey % 4 = 2""",
        "patch_transcripts": """select g."videoId",
          case when b."videoId" is not null then b."videoTranscript" else g."videoTranscript" end as "videoTranscript",
          case when b."videoId" is not null then b."transcriptLanguage" else g."transcriptLanguage" end as "transcriptLanguage"
          from v_gaps g left join (select * from v_batch where seq % 10 = 1) b on g."videoId" = b."videoId" """,
        "patch_audio_path": """select g."videoId",
          case when b."videoId" is not null then b."videoAudio" else g."videoAudio" end as "videoAudio"
          from v_gaps g left join (select * from v_batch where seq % 10 = 1) b on g."videoId" = b."videoId" """,
        "record_unavailable": f"""select g."videoId",
          case when r.text is not null then r.text else g."videoTranscript" end as "videoTranscript",
          case when r.text is not null then r.language else g."transcriptLanguage" end as "transcriptLanguage"
          from v_gaps g left join (select * from (
            select "videoId", doc_id % 2 = 0 as ok, case when doc_id % 2 = 0 then 'text of ' || "videoId" else status end as text,
            case when doc_id % 2 = 0 then 'pt' else language end as language
            from (select "videoId", doc_id, {_ladder('fetch')} from v_errors where doc_id % 3 = 0))
            where ok or starts_with(text, 'VIDEO_UNAVAILABLE') or starts_with(text, 'TRANSCRIPT_UNAVAILABLE')) r
          on g."videoId" = r."videoId" """,
        "ensure_columns": """select "videoId", "channelId", cast(null as varchar) as "videoTitle",
          cast(null as varchar) as "videoTranscript", cast(null as varchar) as "publishedAt",
          cast(null as varchar) as "transcriptLanguage", cast(null as bigint) as "viewCount", "likeCount",
          cast(null as bigint) as "commentCount" from v_videos""",
        "resolve_columns": """select "videoId", "channelId", "transcriptLanguage", "videoTranscript", "viewCount"
          from v_videos""",
        "coerce_types": f"""select "videoId",
          case when doc_id % 4 < 2 then strftime("publishedAt", {TS}) end as "publishedAt",
          case when doc_id % 5 < 2 then 0 else "viewCount" end as "viewCount", "likeCount", "commentCount",
          case when doc_id % 5 >= 2 then "viewCount" end as "viewCountOrNull" from v_videos""",
        "valid_videos": f"""select "videoId", "channelId", "videoTranscript", {_stamp('"publishedAt"')}, "viewCount",
          "likeCount", "commentCount" from v_videos
          where doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 11 <> 0 and doc_id % 17 <> 0 and doc_id % 19 <> 0""",
        "transcript_status_split": """select "videoId",
          case when doc_id % 17 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0 then null else "videoTranscript" end as "videoTranscript",
          case when doc_id % 17 = 0 then 'VIDEO_UNAVAILABLE: Video is private'
            when doc_id % 5 = 0 then 'TRANSCRIPT_UNAVAILABLE: none' end as "transcriptStatus" from v_videos""",
        "filter_half_open": f"""select "videoId", {_stamp('"publishedAt"')} from v_videos
          where "publishedAt" >= timestamp '2022-11-05' and "publishedAt" < timestamp '2023-01-10 05:00:00'""",
        "filter_publish_window": f"""select l."videoId", {_stamp('l."publishedAt"')}, bounds from (
            select "videoId", "publishedAt" from v_videos union all select "videoId" || 'b', "publishedAt" from v_videos) l
          join (values ('both', timestamp '2022-12-01', timestamp '2023-01-31 23:59:59'),
            ('after', timestamp '2023-01-31 23:59:59', timestamp '9999-01-01'),
            ('before', timestamp '1900-01-01', timestamp '2022-12-01')) b(bounds, lo, hi)
          on "publishedAt" between lo and hi""",
        "videos_by_period": f"""select "videoId", {_stamp('"publishedAt"')}, period from v_in_period""",
        "transcript_backlog": f"""select "videoId", {_stamp('"publishedAt"')}, ingest_seq from v_gaps
          where "videoTranscript" is null and "publishedAt" >= timestamp '2022-11-15'
          and "publishedAt" <= timestamp '2023-02-10 23:59:59'""",
        "transcript_done": """select "videoId" from v_gaps where length("videoTranscript") > 0""",
        "audio_backlog": """select "videoId", 'https://www.youtube.com/watch?v=' || "videoId" as "videoUrl",
          'audio/audio_files/' || "videoId" || '.mp3' as "audioPath" from v_gaps
          where "videoAudio" is null or "videoAudio" = ''""",
        "channel_filter": f"""select "videoId", "channelId", "videoTitle", "videoTranscript", {_stamp('"publishedAt"')},
          "transcriptLanguage", "viewCount", "likeCount", "commentCount" from v_videos where "channelId" = 'src3'""",
        "channel_names": """select "videoId", v."channelId", coalesce(c."channelName", v."channelId") as "channelName"
          from v_videos v left join v_channels c on v."channelId" = c."channelId" """,
        "new_videos": 'select "videoId" from v_search where "videoId" not in (select concat(\'v\', doc_id) from documents where doc_id % 2 = 0)',
        "stored_videos": 'select "videoId" from v_search where "videoId" in (select concat(\'v\', doc_id) from documents where doc_id % 2 = 0)',
        "known_ids": 'select "videoId" from v_videos union select "videoId" from v_batch',
        "video_details_join": """select "videoId", "channelId", "viewCount" from v_search join v_videos using ("videoId")""",
        "channel_yearly_update": "select * from v_yearly",
        "comment_threads": """select r."commentId", r."parentCommentId", r."userId", p."userId" as "parentUserId",
          p.content as "parentContent" from v_all_comments r left join v_all_comments p
          on r."parentCommentId" = p."commentId" where r."parentCommentId" is not null""",
        "comments_per_video": """select v."videoId", count(c."commentId") as comments, count(c."parentCommentId") as replies,
          cast(coalesce(sum(c."likeCount"), 0) as bigint) as likes
          from v_videos v left join v_comments c on v."videoId" = c."videoId" group by 1""",
        "videos_with_transcript": """select "videoId", "channelId" from v_videos
          where "videoId" in (select "videoId" from v_options)""",
        "lemma_lookup": """select "videoId", case when regexp_full_match(term, '[a-z]{4,}s')
            then left(term, length(term) - 1) else term end as lemma, cast(sum(n) as bigint) as n
          from v_term_counts group by 1, 2""",
        "stopword_table_filter": """select t.lang, t.token as word, count(*) as n from v_raw_tokens t
          left join v_stopwords s on t.lang = s.lang and t.token = s.word where s.word is null group by 1, 2""",
        "stopword_union": """select word from v_stopwords union
          select token from v_raw_tokens where length(token) <= 2""",
        "metric_summary": f"""select "channelId", count(*) as videos, {_METRIC_STATS} from v_videos group by 1""",
        "corpus_summary": f"""select count(*) as videos, {_METRIC_STATS} from v_videos""",
        "engagement_thresholds": """select period, entity, n, round(high, 6) as high, round(low, 6) as low from v_thresholds""",
        "engagement_tiers": """select period, "videoId", "viewCount", entity, tier from v_tiers""",
        "thresholds_after_batch": """select period, entity, count(*) as n,
          cast(case when count(*) <= 3 then min(v) else quantile_cont(v, 0.75) end as double) as high,
          cast(case when count(*) <= 3 then min(v) - 1 else quantile_cont(v, 0.25) end as double) as low
          from (select period, entity, "viewCount" + case when doc_id % 6 = 1 then 1000 else 0 end as v from v_entities)
          group by 1, 2""",
        "tier_sizes": "select period, entity, tier, count(*) as videos from v_tiers group by 1, 2, 3",
        "tokenize": f"""select "videoId", cast(len(t) as bigint) as n, array_to_string(t, ' ') as tokens from (
          select "videoId", regexp_extract_all(lower("videoTranscript"), '{TOKEN}') as t from v_videos)""",
        "bigram_counts": """select "channelId", bigram, count(*) as frequency
          from v_bigrams join v_videos using (doc_id) group by 1, 2""",
        "bigram_fallback": """select "channelId", bigram, frequency, rank from (
          select *, row_number() over (partition by "channelId" order by frequency desc, bigram) as rank from (
            select "channelId", token || ' ' || next_token as bigram, count(*) as frequency from (
              select doc_id, "channelId", token, lead(token) over (partition by doc_id order by pos) as next_token
              from v_raw_tokens)
            where next_token is not null and token not in (select word from v_stop)
            and next_token not in (select word from v_stop) group by 1, 2)) where rank <= 15""",
        "doc_term_counts": 'select "videoId", token as term, count(*) as n from v_tokens group by 1, 2',
        "top_bigrams": """select period, entity, tier, bigram, frequency, rank from (
          select *, row_number() over (partition by period, entity, tier order by frequency desc, bigram) as rank from (
            select period, entity, tier, bigram, count(*) as frequency from v_tiers join v_bigrams using (doc_id)
            group by 1, 2, 3, 4)) where rank <= 15""",
        "top_bigrams_first_seen": """select period, entity, tier, bigram, frequency, rank from (
          select *, row_number() over (partition by period, entity, tier order by frequency desc, first_seen) as rank from (
            select period, entity, tier, bigram, count(*) as frequency, min((doc_id, spot)) as first_seen
            from v_tiers join v_bigrams using (doc_id) group by 1, 2, 3, 4)) where rank <= 15""",
        "period_report_tiers_bigrams": f"""select * from (with tokens as (
            select cast(substr("videoId", 2) as bigint) as doc_id, pos, sub, token from (select "videoId", pos,
              unnest(regexp_extract_all(word, '{TOKEN}')) as token,
              unnest(range(1, len(regexp_extract_all(word, '{TOKEN}')) + 1)) as sub from {_strict_words("v_videos")})
            where token not in (select word from v_stop)),
          pairs as (select doc_id, spot, token || ' ' || next_token as bigram from (
            select doc_id, token, row_number() over w as spot, lead(token) over w as next_token from tokens
            window w as (partition by doc_id order by pos, sub)) where next_token is not null)
          select 'tiers' as part, period, entity, tier, count(*) as n, cast(null as varchar) as bigram,
            cast(null as integer) as rank from v_tiers group by 2, 3, 4
          union all select 'bigrams', period, entity, tier, n, bigram, rank from (
            select *, row_number() over (partition by period, entity, tier order by n desc, first_seen) as rank from (
              select period, entity, tier, bigram, count(*) as n, min((doc_id, spot)) as first_seen
              from v_tiers join pairs using (doc_id) group by 1, 2, 3, 4)) where rank <= 15)""",
        "group_engagement": """select quality, toxic, round(avg("viewCount"), 6) as "viewCount",
          round(avg("likeCount"), 6) as "likeCount", round(avg("commentCount"), 6) as "commentCount",
          count(*) as num_videos, format('{:,}', cast(trunc(avg("viewCount")) as bigint)) as views_shown,
          round_even(avg("viewCount"), 0) as views_rounded
          from v_videos join labels using (doc_id) group by 1, 2""",
        "channels_in_period": 'select distinct period, "channelId" from v_in_period',
        "rollup_period_channel": """select period, entity, count(*) as videos,
          round(avg("viewCount"), 6) as "mean_viewCount", round(avg("likeCount"), 6) as "mean_likeCount",
          round(avg("commentCount"), 6) as "mean_commentCount" from v_entities group by 1, 2""",
        "channel_profile": f"""select 'src' || s_suppkey as "channelId", s_name as "channelName",
          '{V.COLLECTED}' as "dayCollected", cast(s_suppkey * 3 as bigint) as "numberOfSubscribers",
          coalesce(n, 0) as "numberOfVideos" from supplier
          left join (select "channelId", count(*) as n from v_videos group by 1) v on 'src' || s_suppkey = v."channelId" """,
        "outcome_counts": """select count(*) as processed, count("dataColetada2025") as updated,
          count(*) filter (where "dataColetada2025" is null and id <> '') as failed from v_yearly""",
        "transcript_outcome": """select "channelId", count(*) as saved,
          count(*) filter (where length("videoTranscript") > 0) as with_transcript,
          count(*) filter (where "videoTranscript" is null or "videoTranscript" = '') as without_transcript
          from v_gaps group by 1""",
        "topic_k": """select period, entity, count(*) as n,
          cast(case when count(*) = 1 then 1 else least(5, greatest(2, count(*) // 3)) end as bigint) as k
          from v_entities group by 1, 2""",
        "lda_topic_totals": """select period, entity, count(*) as n,
          cast(case when count(*) = 1 then 1 else least(5, greatest(2, count(*) // 3)) end as bigint) as k,
          true as shares_whole, true as bound_rises from v_entities group by 1, 2""",
        "lda_top_term_order": """select period, entity,
          cast(case when count(*) = 1 then 1 else least(5, greatest(2, count(*) // 3)) end as bigint) as k,
          true as ordered from v_entities group by 1, 2""",
        "zscore_metrics": f"""select period, "videoId", {_period_z('viewCount')}, {_period_z('likeCount')},
          {_period_z('commentCount')} from v_in_period window w as (partition by period, "channelId")""",
        "argmax_per_group": """select "channelId", "videoId", "likeCount", left("videoTranscript", 200) || '...' as example from (
          select *, row_number() over (partition by "channelId" order by "likeCount" desc, "videoId") as r from v_videos)
          where r = 1""",
        "pick_transcript_lang": """select "videoId", language, seq, text from (select *, row_number() over (
            partition by "videoId" order by list_position(['pt', 'pt-BR', 'en'], language), seq) as r
          from v_options where language in ('pt', 'pt-BR', 'en')) where r = 1""",
        "pick_subtitle_ext": """select "videoId", ext, file from (select *, row_number() over (
            partition by "videoId" order by list_position(['vtt', 'srt', 'srv3', 'srv2', 'srv1'], ext), file) as r
          from (select file, split_part(file, '.', 1) || '.' || split_part(file, '.', 2) as "videoId",
            split_part(file, '.', 3) as lang, split_part(file, '.', 4) as ext from v_files)
          where lang = 'pt' and ext <> 'json3') where r = 1""",
        "remove_stopwords": _regroup("v_kept_words", "word", "pos", "text"),
        "remove_stopwords_strict": _regroup(_strict_words(), "word", "pos", "text"),
        "text_clean_basic": f'select "videoId", {_clean_basic(text)} as text from v_timed',
        "text_clean_export": f'select "videoId", {_clean_export(text)} as text from v_timed',
        "token_filter": _regroup(
            f"""(select "videoId", lower(word) as word, pos from v_words
              where regexp_matches(lower(word), '^\\p{{L}}+$')
              and {_CONTENT.replace('word not', 'lower(word) not').replace("strip_accents(word)", "strip_accents(lower(word))")})""",
            "word", "pos", "lemmas",
        ),
        "clean_transcripts_full": f"""select v."videoId", {_TIMED_COLUMNS}, coalesce(t.text, '') as "cleanTranscript"
          from v_videos v left join (select "videoId", string_agg(word, ' ' order by pos) as text
            from {_pieces(_clean_basic(text), 'v_timed')} where {_ALPHA} and {_CONTENT} group by 1) t
          on v."videoId" = t."videoId" """,
        "clean_export": f"""select v."videoId", {_TIMED_COLUMNS}, coalesce(t.text, '') as "videoTranscript"
          from v_videos v left join (select "videoId", string_agg(word, ' ' order by pos) as text
            from {_pieces(_clean_export(text), 'v_timed')}
            where {_ALPHA} and lower(word) not in (select word from v_stop) group by 1) t
          on v."videoId" = t."videoId"
          where "publishedAt" >= timestamp '2022-10-31' and "publishedAt" < timestamp '2023-02-01'""",
        "transcript_format": """select "videoId", string_agg(format('[{:02d}:{:02d}] {}',
            cast(trunc(pos * 97.3::double) as bigint) // 60, cast(trunc(pos * 97.3::double) as bigint) % 60, line),
            chr(10) order by pos) as text from v_lines group by 1""",
        "duration_format": """select "videoId", format('{:02d}:{:02d}', s // 60, s % 60) as mmss,
          format('{:02d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) as hhmmss
          from (select "videoId", "viewCount" * 7 as s from v_videos)""",
        "safe_name": """select "videoId", translate("videoTitle" || ' / ' || "channelId", ' /', '_-') as name from v_videos""",
        "transcript_status_precheck": f'select "videoId", {_ladder("precheck")} from v_errors',
        "transcript_status_fetch": f'select "videoId", {_ladder("fetch")} from v_errors',
        "transcript_available": """select "videoId", not (contains(m, 'video is no longer available')
          or contains(m, 'video unavailable') or contains(m, 'age-restricted') or contains(m, 'age restricted'))
          and not coalesce(kind in ('NoTranscriptFound', 'TranscriptsDisabled'), false) as available
          from (select "videoId", kind, lower(message) as m from v_errors)""",
        "monthly_window": f"""select "videoId", cast("viewCount" + case when month("publishedAt") = 12 then 1 else 0 end as bigint)
          as "viewCount", {_stamp('"publishedAt"')}, strftime(date_trunc('month', "publishedAt"), '%Y-%m-%d') as "publishMonth"
          from v_videos where doc_id % 29 <> 0
          and "publishedAt" >= timestamp '2022-12-20' and "publishedAt" < timestamp '2023-01-10 05:00:00'""",
        "monthly_periods": """select period, "channelId", count(*) as videos,
          cast(sum("viewCount" + case when month("publishedAt") = 12 then 1 else 0 end) as bigint) as views
          from v_in_period where doc_id % 29 <> 0 group by 1, 2""",
        "scan_channels_csv": """select name, url, nullif(id, '') as id, "numberOfVideos", "numberOfSubscribers", "dataCollected"
          from v_channel_list""",
        "scan_analysis_csv": f"""select "videoId", "channelId", "videoTitle", "videoTranscript", {_stamp('"publishedAt"')},
          "transcriptLanguage", "viewCount", "likeCount", "commentCount" from v_timed""",
        "sink_csv_roundtrip": f"""select "videoId", "channelId", "videoTitle", "videoTranscript", {_stamp('"publishedAt"')},
          "transcriptLanguage", "viewCount", "likeCount", "commentCount" from v_videos""",
        "sink_tsv_roundtrip": """select "viewCount", "likeCount", translate(period, ' /', '_-') as period,
          translate(entity, ' /', '_-') as entity, tier from v_tiers""",
        "stream_upsert_videos": _stream("doc_id % 3 = 0"),
        "stream_new_videos": _stream("doc_id % 2 = 1"),
        "stream_two_jobs": _stream("doc_id % 3 > 0"),
        "stream_replay": _stream("false"),
    }
    return {name: sql(body) for name, body in bodies.items()}
