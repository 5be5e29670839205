"""The same queries in SQL (DuckDB), over the given tables only."""

from __future__ import annotations

BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SP = f"[{BLANK}]"
STAMP = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:[.,]\p{Nd}{3})?"
WORD = r"[\p{L}\p{N}_]"
HEADER = rf"^({STAMP}){SP}+\[(.*?)\]{SP}+({WORD}+){SP}+(.*?){SP}+-{SP}+(.*)\n?$"
CUSTOM = rf"^({STAMP}){SP}+\[(.*?)\]{SP}+{SP}*({WORD}+){SP}*{SP}+(.+?[^{BLANK}]){SP}*{SP}+\-{SP}+(.*){SP}*.*\n?$"
TRACE = (
    rf"^{SP}*(?:at .*[^{BLANK}]|Caused by:|Suppressed:|\.\.\. .*[^{BLANK}]"
    rf"|[A-Za-z_][\p{{L}}\p{{N}}_.$]*(?:Exception|Error)(?::|{SP}|$))"
)
NL = "chr(10)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g')"


LINES = r"""
stamped as (
  select event_id, user_id, event_type, props,
    case when event_id % 97 = 13 then '2024-02-30' || strftime(ts, ' %H:%M:%S')
         else strftime(ts, '%Y-%m-%d %H:%M:%S') end as sec,
    strftime(ts, '%g') as ms
  from events),
described as (
  select s.*, d.text,
    case when event_id % 17 = 6 then sec when event_id % 13 = 5 then sec || ',' || ms
         else sec || '.' || ms end as stamp,
    case event_type when 'error' then 'ERROR' when 'purchase' then 'INFO' when 'click' then 'DEBUG'
         when 'signup' then case when event_id % 7 = 2 then 'WARNING' else 'WARN' end
         else 'TRACE' end as lvl,
    case when event_id % 19 = 7 then ''
         when event_type = 'view' and event_id % 2 = 1 then ' heartbeat'
         when event_type = 'purchase' and event_id % 23 = 4 then ' payment Error for ' || props
         else ' props ' || props end as msg
  from stamped s left join documents d on d.doc_id = s.event_id),
records as (
  select event_id, 'app-' || (event_id % 4) || '.log' as filename,
    string_split(
      case when event_id < 4 then 'no header for ' || props
           else stamp || ' [http-' || (user_id % 8) || '] '
                || case when event_id % 11 = 3 then lower(lvl) else lvl end
                || ' com.acme.' || event_type || ' -' || msg end
      || coalesce(chr(10) || case
           when event_type = 'error' and event_id % 5 = 0 then
             'java.lang.IllegalStateException: bad ' || props || chr(10)
             || '    at com.acme.Handler.run(Handler.java:' || user_id || ')' || chr(10)
             || 'Caused by: java.io.IOException: closed'
           when event_type = 'purchase' and event_id % 3 = 0 then
             chr(10) || '    payload=' || props || chr(10) || '  ' || chr(10) || 'tail'
           when event_type = 'signup' and event_id % 5 = 1 then '  nested TimeoutException: slow' end, '')
      || coalesce(chr(10) || text, ''), chr(10)) as parts
  from described),
exploded as (
  select filename, event_id, unnest(parts) as value, unnest(range(len(parts))) as nth from records),
lines as (
  select filename, row_number() over (partition by filename order by event_id, nth) as line_num, value
  from exploded)"""


def headers(regex: str = HEADER, order=("timestamp", "thread", "level", "logger", "message")) -> str:
    fields = ", ".join(
        f"regexp_extract(value || chr(10), '{regex}', {i}) as \"{name}\"" for i, name in enumerate(order, 1)
    )
    return f"""
matched as (select *, regexp_matches(value || chr(10), '{regex}') as is_header from lines),
headers as (select filename, line_num, value, {fields},
    try_cast(left(regexp_extract(value || chr(10), '{regex}', 1), 19) as timestamp) as entry_time
  from matched where is_header)"""


ASSIGNED = """
carried as (
  select *, max(case when is_header then line_num end)
              over (partition by filename order by line_num) as entry_line from matched),
assigned as (
  select c.filename, c.line_num, c.value, c.is_header, c.entry_line, h.entry_time,
         h.timestamp, h.thread, h.level, h.logger, h.message
  from carried c join headers h on c.filename = h.filename and c.entry_line = h.line_num
  where h.entry_time is not null),
latched as (
  select *, min(case when not is_header and regexp_matches(value, '""" + TRACE + """') then line_num end)
              over (partition by filename, entry_line) as trace_from from assigned)"""

ENTRIES = (
    """
entries as (
  select filename, entry_line as line_num, any_value(entry_time) as entry_time,
    any_value(timestamp) as timestamp, any_value(thread) as thread, any_value(level) as level,
    any_value(logger) as logger, any_value(message) as message,
    ltrim(coalesce(string_agg(value, chr(10) order by line_num)
      filter (where not is_header and (trace_from is null or line_num < trace_from)), ''), chr(10))
      as message_body,
    """
    + strip(
        """coalesce(string_agg(lpad(cast(line_num as varchar), greatest(5, len(cast(line_num as varchar)))::int, ' ')
      || ': ' || value, chr(10) order by line_num)
      filter (where not is_header and line_num >= trace_from), '')"""
    )
    + """ as stacktrace,
    any_value(message) || coalesce(chr(10) || string_agg(value, chr(10) order by line_num)
      filter (where not is_header), '') as full_text
  from latched group by filename, entry_line)"""
)


def groups(source: str = "entries", name: str = "groups") -> str:
    place = "struct_pack(f := filename, l := line_num)"
    return f"""
{name} as (
  select count(*) as "count", string_agg(line_num, ',' order by filename, line_num) as line_numbers,
    string_agg(line_num, ', ' order by filename, line_num) as line_list,
    arg_min(timestamp, {place}) as timestamp, arg_max(timestamp, {place}) as last_timestamp, level,
    arg_min(thread, {place}) as thread, logger, min(filename) as filename, message, message_body,
    stacktrace, arg_min(line_num, {place}) as first_line, arg_max(line_num, {place}) as last_line,
    max(filename) as last_file
  from {source} group by level, logger, message, message_body, stacktrace)"""


COUNTS = """
counts as (
  select level, count(*) as n, min(struct_pack(f := filename, l := line_num)) as first_seen
  from headers where entry_time is not null group by level)"""


def signature(body: str = "message_body") -> str:
    line = strip("x")
    trace = strip(
        "regexp_replace(regexp_extract("
        + strip("stacktrace")
        + rf", '^[^\n]*'), '^{SP}*\p{{Nd}}+:{SP}*', '')"
    )
    return f"""coalesce(nullif({trace}, ''),
      list_filter(list_transform(string_split({body}, chr(10)), lambda x: {line}),
        lambda x: contains(x, 'Exception') or contains(x, 'Error') or starts_with(x, 'Caused by:'))[1],
      case when contains(message, 'Exception') or contains(message, 'Error') then {strip("message")} end, '')"""


SUMMARY = f"""
valued as (
  select "count" as c, unnest(['exception', 'time', 'logger', 'thread']) as dimension,
    unnest([{signature()}, left(timestamp, 13) || ':00', {strip("logger")}, {strip("thread")}]) as value
  from groups),
summary as (
  select dimension, value, count(*) as group_count, cast(sum(c) as bigint) as occurrence_count
  from valued where value <> '' group by dimension, value)"""

FIELDS = (
    '"count", timestamp, last_timestamp, level, thread, logger, filename, message, '
    "message_body, stacktrace"
)


def sql(select: str, *parts: str) -> str:
    return "with " + ",".join([LINES, *parts]) + "\n" + select


def on_lines(select: str) -> str:
    return sql(select)


def on_headers(select: str) -> str:
    return sql(select, headers())


def on_assigned(select: str) -> str:
    return sql(select, headers(), ASSIGNED)


def on_entries(select: str) -> str:
    return sql(select, headers(), ASSIGNED, ENTRIES)


def on_groups(select: str, *parts: str) -> str:
    return sql(select, headers(), ASSIGNED, ENTRIES, groups(), *parts)


KEY = "level, logger, message, message_body, stacktrace"
RANGE = "entry_time between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:30:00'"
PLACE = "filename, line_num, timestamp, level"
RANK = "case level when 'ERROR' then 0 when 'WARN' then 1 when 'WARNING' then 1 when 'INFO' then 2 when 'DEBUG' then 3 when 'TRACE' then 4 else 99 end"

ORACLE: dict[str, str] = {
    "scan_log_dir": on_lines("select filename, value from lines"),
    "number_lines": on_lines("select * from lines"),
    "lenient_utf8": "select doc_id, text || chr(65533) || '.' as text from documents",
    "sample_lines": on_lines(
        f"select * from lines where not regexp_matches(value, '^{SP}*$') order by filename, line_num limit 50"
    ),
    "parse_header_default": on_headers(
        """select m.filename, m.line_num, m.is_header, nullif(h.timestamp, '') as timestamp,
             nullif(h.thread, '') as thread, nullif(h.level, '') as level,
             nullif(h.logger, '') as logger, nullif(h.message, '') as message
           from matched m left join headers h on m.filename = h.filename and m.line_num = h.line_num"""
    ),
    "parse_header_custom": sql(
        "select filename, line_num, timestamp, thread, level, logger, message from headers", headers(CUSTOM)
    ),
    "extract_fields": on_headers(
        "select filename, line_num, timestamp, thread, level, logger, message from headers"
    ),
    "assign_entries": on_assigned("select filename, line_num, entry_line, is_header from assigned"),
    "drop_orphans": on_assigned(f"select filename, line_num, value from assigned where {RANGE}"),
    "classify_stacktrace": on_assigned(
        """select filename, entry_line, line_num,
             case when line_num >= trace_from then 'trace' else 'body' end as kind
           from latched where not is_header"""
    ),
    "build_message_body": on_entries("select filename, line_num, message_body from entries"),
    "build_stacktrace": on_entries("select filename, line_num, stacktrace from entries"),
    "build_full_text": on_entries("select filename, line_num, full_text from entries"),
    "filter_time_range": on_entries(f"select {PLACE} from entries where {RANGE}"),
    "drop_bad_timestamps": on_headers(f"select {PLACE} from headers where entry_time is not null"),
    "filter_level": on_entries(f"select {PLACE} from entries where upper(level) in ('ERROR', 'WARN')"),
    "filter_keyword": on_entries(
        f"""select {PLACE}, 'exact' as match from entries
              where contains(full_text, 'IllegalStateException: bad')
            union all select {PLACE}, 'folded' from entries
              where contains(lower(full_text), 'timeoutexception')"""
    ),
    "parse_datetime_text": """
        with shaped as (
          select event_id, event_id % 11 as shape, cast(cast(ts as date) as timestamp) as day,
            date_trunc('minute', ts) as minute, date_trunc('second', ts) as second,
            strftime(ts, ' %H:%M:%S') as clock from events),
        moments as (
          select event_id, shape, day, case when shape in (2, 4, 6) then minute
              when shape in (3, 5, 7) then second
              when shape = 8 then try_cast(strftime(day, '%Y-%m') || '-30' || clock as timestamp) end as t
          from shaped)
        select event_id,
          strftime(case when shape < 2 then day else t end, '%Y-%m-%d %H:%M:%S') as start_at,
          strftime(case when shape < 2 then day + interval '23:59:59' else t end, '%Y-%m-%d %H:%M:%S') as end_at
        from moments""",
    "normalize_timezone": """
        select event_id, strftime(ts - interval 8 hour, '%Y-%m-%d %H:%M:%S') as local_time from events""",
    "level_counts": sql("select level, n from counts", headers(), COUNTS),
    "dedup_groups": on_groups(f"select {FIELDS} from groups"),
    "collect_line_numbers": on_groups(
        f"""select g.filename, g.first_line, g."count", cast(0 as int) as batch, chunk_file, chunk_no, n, c.line_numbers
            from chunked c join groups g using ({KEY})""",
        f"""chunked as (
          select {KEY}, filename as chunk_file, line_num // 65536 as chunk_no, count(*) as n,
            string_agg(line_num, ',' order by line_num) as line_numbers
          from entries group by {KEY}, filename, line_num // 65536)""",
    ),
    "first_last_seen": on_groups(
        """select level, logger, message, message_body, stacktrace, timestamp, last_timestamp, first_line
           from groups"""
    ),
    "merge_groups": sql(
        f"""select m.*, n_chunks, n_lines, line_sum from (
              select a."count" + coalesce(b."count", 0) as "count", a.timestamp,
                coalesce(b.last_timestamp, a.last_timestamp) as last_timestamp, level, a.thread, logger,
                a.filename, message, message_body, stacktrace, cast(0 as int) as first_batch
              from early a left join late b using ({KEY})
              union all
              select b."count", b.timestamp, b.last_timestamp, b.level, b.thread, b.logger,
                b.filename, b.message, b.message_body, b.stacktrace, 1
              from late b anti join early a using ({KEY})) m
            join lined using ({KEY})""",
        headers(),
        ASSIGNED,
        ENTRIES,
        "first_half as (select * from entries where entry_time < timestamp '2024-01-15 12:00:00')",
        "second_half as (select * from entries where entry_time >= timestamp '2024-01-15 12:00:00')",
        groups("first_half", "early"),
        groups("second_half", "late"),
        f"""lined as (
          select {KEY}, count(*) as n_chunks, cast(sum(n) as bigint) as n_lines, cast(sum(s) as bigint) as line_sum
          from (
            select {KEY}, count(*) as n, sum(line_num) as s from first_half group by {KEY}, filename, line_num // 65536
            union all
            select {KEY}, count(*), sum(line_num) from second_half group by {KEY}, filename, line_num // 65536)
          group by {KEY})""",
    ),
    "totals": on_groups(
        """select (select count(*) from entries) as total_logs, count(*) as matched_groups,
             cast(sum("count") as bigint) as matched_occurrences from groups"""
    ),
    "level_summary": sql("select level, n from counts where n > 0 order by level", headers(), COUNTS),
    "level_bars": sql(
        """select level, n, repeat('█', cells) || repeat('░', 18 - cells) as bar from (
             select level, n, cast(least(greatest(
               round_even(n / (select max(n) from counts) * 18, 0), 1), 18) as int) as cells from counts)""",
        headers(),
        COUNTS,
    ),
    "dashboard": on_groups("select * from summary", SUMMARY),
    "distinct_counts": on_groups(
        "select dimension, count(*) as distinct_values from summary group by dimension", SUMMARY
    ),
    "exception_signature": on_entries(
        f"select filename, line_num, {signature()} as signature from entries"
    ),
    "time_bucket": on_headers("select filename, line_num, left(timestamp, 13) || ':00' as bucket from headers"
                              " where entry_time is not null"),
    "level_rank": on_headers(f"select filename, line_num, {RANK} as level_rank from headers"
                             " where entry_time is not null"),
    "safe_filename_part": rf"""
        select page_id, coalesce(nullif(regexp_replace({strip("url")}, '[^\p{{L}}\p{{N}}_-]', '_', 'g'), ''),
          'UNKNOWN') as part from pages""",
    "sort_time": on_groups(f"select {FIELDS} from groups order by timestamp, filename, first_line"),
    "sort_level": on_groups(
        f"""select {RANK} as level_rank, timestamp, filename, first_line, level, "count" from groups
            order by 1, 2, 3, 4"""
    ),
    "sort_summary": on_groups(
        "select * from summary order by dimension, occurrence_count desc, group_count desc, value", SUMMARY
    ),
    "top5_summary": on_groups(
        """select *, row_number() over (partition by dimension
             order by occurrence_count desc, group_count desc, value) as rank
           from summary qualify rank <= 5""",
        SUMMARY,
    ),
    "iter_entries": on_entries(
        f"""select filename, line_num, timestamp, strftime(entry_time, '%Y-%m-%d %H:%M:%S') as entry_time,
              thread, level, logger, message, message_body, stacktrace, full_text
            from entries where {RANGE}"""
    ),
    "parse_directory": sql(
        f"select {FIELDS} from groups order by {RANK}, timestamp, filename, first_line",
        headers(),
        ASSIGNED,
        ENTRIES,
        "kept as (select * from entries where contains(lower(full_text), 'timeoutexception'))",
        groups("kept"),
    ),
}
for _name, _dimension in {
    "exception_summary": "exception",
    "time_hotspots": "time",
    "logger_distribution": "logger",
    "thread_distribution": "thread",
}.items():
    ORACLE[_name] = on_groups(
        f"""select value, group_count, occurrence_count from summary where dimension = '{_dimension}'
            order by occurrence_count desc, group_count desc, value""",
        SUMMARY,
    )

# --- layout candidates ---------------------------------------------------------------

CANDIDATES = """
configs as (
  select case when c_custkey % 3 = 0 then 'Logback-' else 'logback-' end
      || lpad(cast(c_custkey as varchar), 9, '0')
      || case when c_custkey % 5 = 0 then '.XML' when c_custkey % 7 = 0 then '.txt' else '.xml' end as config,
    c_name, c_nationkey, c_mktsegment, c_custkey % 4 as kind,
    case c_custkey % 4 when 0 then '%d [%t] %-5p %c{36} - %m%n'
      when 1 then '%d{HH:mm} %-5level [%thread] %logger{0}: %msg%n'
      when 2 then '%d %clr(%level) [%t] %c - %m%n'
      else '%highlight(%d) [%thread] %level ${L:-%logger} - %msg%n' end as layout
  from customer),
candidates as (
  select config, cast(0 as int) as ordinal, 'FILE_LOG_PATTERN' as name, c_mktsegment || ' %m%n' as pattern,
    'property' as source, -1 as kind from configs
  union all select config, 1, c_name || ' Pattern', layout, 'encoder', kind from configs
  union all select config, 2, 'copy Pattern', layout, 'encoder', kind from configs
  union all select config, 3, 'Pattern', '%m ' || c_nationkey, 'encoder', -1 from configs)"""
SCORED = rf"""
samples as (
  select value from lines where not regexp_matches(value, '^{SP}*$') order by filename, line_num limit 50),
hits as (
  select count(*) as checked, sum(case when regexp_matches(value || chr(10), '{CUSTOM}') then 1 else 0 end) as m
  from samples),
scored as (
  select config, ordinal, name, pattern, source,
    cast(case when kind in (0, 3) then m else 0 end as bigint) as matches, checked,
    case when kind in (0, 3) then m else 0 end / checked as score
  from candidates, hits where ordinal <> 2)"""
CANDIDATE_FIELDS = "config, ordinal, name, pattern, source"
ORACLE |= {
    "scan_layout_configs": f"with {CANDIDATES} select {CANDIDATE_FIELDS} from candidates",
    "dedup_candidates": f"with {CANDIDATES} select {CANDIDATE_FIELDS} from candidates where ordinal <> 2",
    "discover_layout_configs": f"""with {CANDIDATES} select config from configs
        where lower(config) like 'logback%' and lower(config) like '%.xml'""",
    "score_patterns": sql("select * from scored", CANDIDATES, SCORED),
    "best_pattern": sql(
        """select * from scored qualify row_number() over (partition by config
             order by matches desc, score desc, ordinal) = 1""",
        CANDIDATES,
        SCORED,
    ),
    "best_config": sql(
        """select * from scored where lower(config) like 'logback%' and lower(config) like '%.xml'
           order by matches desc, score desc, config, ordinal limit 1""",
        CANDIDATES,
        SCORED,
    ),
}

# --- reports -------------------------------------------------------------------------


def _rstrip(text: str) -> str:
    return f"regexp_replace({text}, '{SP}+$', '')"


def _csv(text: str) -> str:
    return (
        f"""case when regexp_matches({text}, '[",\\r\\n]') then '"' || replace({text}, '"', '""') || '"' """
        f"else {text} end"
    )


CSV_TEXT = " || ',' || ".join(
    ['cast("count" as varchar)', _csv("line_list")]
    + [_csv(c) for c in "timestamp last_timestamp level thread logger filename message".split()]
    + [_csv("csv_body"), _csv("csv_trace")]
)
_MEMBERS = [
    f"""'            "{name}": ' || cast(to_json({name}) as varchar)"""
    for name in "timestamp last_timestamp level thread logger filename message message_body stacktrace".split()
]
JSON_TEXT = (
    """'        {' || chr(10) || '            "count": ' || "count" || ',' || chr(10)
    || '            "line_numbers": [' || chr(10) || '                '
    || replace(line_numbers, ',', ',' || chr(10) || '                ') || chr(10) || '            ],' || chr(10) || """
    + " || ',' || chr(10) || ".join(_MEMBERS)
    + " || chr(10) || '        }'"
)
MD_TEXT = f"""'. [' || level || '] ' || message || chr(10)
    || '- **出現行號**: `' || line_list || '`' || chr(10)
    || case when "count" > 1 then '- **時間範圍**: `' || timestamp || '` ～ `' || last_timestamp || '`'
         else '- **出現時間**: `' || timestamp || '`' end || chr(10)
    || '- **線程**: `' || thread || '`' || chr(10) || '- **Logger**: `' || logger || '`' || chr(10)
    || '- **來源檔案**: `' || filename || '`' || chr(10)
    || case when message_body <> '' then '#### 延伸訊息:' || chr(10) || '```text' || chr(10)
         || {_rstrip("message_body")} || chr(10) || '```' || chr(10) else '' end
    || case when stacktrace <> '' then '#### 內容/堆疊追蹤 (含原始行號):' || chr(10) || '```java' || chr(10)
         || {strip("stacktrace")} || chr(10) || '```' || chr(10) else '' end
    || chr(10) || '---'"""
TEXTS = f"""
texts as (
  select *, {CSV_TEXT} as csv_text, {JSON_TEXT} as json_text, {MD_TEXT} as md_text
  from (select *, {strip("message_body")} as csv_body, {strip("stacktrace")} as csv_trace from groups)),
ranked as (
  select *, row_number() over (order by timestamp, filename, first_line) as pos,
    row_number() over (partition by level order by timestamp, filename, first_line) as level_pos,
    count(*) over () as n_rows
  from texts)"""
CSV_HEAD = """'--- 統計摘要 ---' || chr(13) || chr(10) || '日誌等級 (Level),出現次數 (Count)' || chr(13) || chr(10)
  || {counts} || chr(13) || chr(10) || chr(13) || chr(10)"""
CSV_ROWS_HEAD = """ || '--- 詳細日誌內容 (已合併重複項) ---' || chr(13) || chr(10)
  || '出現次數,出現行號,第一次時間,最後一次時間,等級,線程,Logger,來源檔案,訊息內容,延伸訊息,堆疊追蹤 (含行號)'"""
MD_HEAD = """'# Java Log 分析報告' || chr(10) || chr(10) || '## 統計摘要' || chr(10) || '| 日誌等級 | 數量 |' || chr(10)
  || '| --- | --- |' || chr(10) || {counts} || chr(10) || chr(10) || '## 符合條件的詳細日誌'"""
CSV_SPLIT_HEAD = " || '--- 詳細日誌已分割 ---' || chr(13) || chr(10) || '請參考下列檔案'"
ALL_CSV = "(select string_agg(level || ',' || n, chr(13) || chr(10) order by level) from counts)"
ALL_MD = "(select string_agg('| ' || level || ' | ' || n || ' |', chr(10) order by level) from counts)"
MD_SPLIT_HEAD = MD_HEAD.replace("{counts}", ALL_MD).replace(
    "'## 符合條件的詳細日誌'", "'## 詳細日誌已分割' || chr(10) || '請參考下列檔案：'"
)
ALL_JSON = "(select string_agg('\"' || level || '\": ' || n, ', ' order by first_seen) from counts)"


def on_report(select: str, *parts: str) -> str:
    return on_groups(select, COUNTS, TEXTS, *parts)


def packed(unit: str, opening: str, size: str, limit: int) -> str:
    """Rows into parts one after the other; ``size`` may use ``idx``, the index in the part."""
    here, fresh = size.replace("{idx}", "p.idx + 1"), size.replace("{idx}", "1")
    position = "level_pos" if unit else "pos"
    unit_column = "level" if unit else "''"
    return f"""
rows_in as (
  select {unit_column} as unit, {position} as p0, r.*, {opening} as opening
  from ranked r {"join counts c using (level)" if unit else ""}),
packed as (
  select unit, p0, 1 as part_no, 1 as idx, opening + {fresh} as used from rows_in where p0 = 1
  union all
  select r.unit, r.p0,
    case when p.used + {here} > {limit} then p.part_no + 1 else p.part_no end,
    case when p.used + {here} > {limit} then 1 else p.idx + 1 end,
    case when p.used + {here} > {limit} then r.opening + {fresh} else p.used + {here} end
  from packed p join rows_in r on r.unit = p.unit and r.p0 = p.p0 + 1),
parted as (
  select k.part_no, k.idx, r.*, max(k.part_no) over (partition by k.unit) as n_parts
  from packed k join rows_in r on r.unit = k.unit and r.p0 = k.p0)"""


SPLIT = 150_000
CSV_SIZE = "strlen(csv_text) + 5"
MD_SIZE = "strlen(md_text) + 5 + len(cast({idx} as varchar))"
LEVEL_CSV_HEAD = CSV_HEAD.replace("{counts}", "level || ',' || n") + CSV_ROWS_HEAD
LEVEL_MD_HEAD = MD_HEAD.replace("{counts}", "'| ' || level || ' | ' || n || ' |'")
PART_NAME = "case when n_parts > 1 then '_part' || lpad(cast(part_no as varchar), 3, '0') else '' end"
BY_LEVEL_CSV = packed("level", f"strlen({LEVEL_CSV_HEAD}) + 5", CSV_SIZE, SPLIT)
MANIFEST = f"""
parts as (select distinct level, part_no, n_parts, 'report_' || level || {PART_NAME} || '.csv' as file from parted),
manifest as (
  select cast(0 as bigint) as ordinal, '' as level, cast(0 as bigint) as part_no, 'report_summary.csv' as file
  union all
  select row_number() over (order by first_seen, part_no), level, part_no, file
  from parts join counts using (level))"""


def recursive(query: str) -> str:
    return "with recursive" + query.removeprefix("with")


ORACLE |= {
    "rendered_size": on_report(
        """select filename, first_line, strlen(csv_text) + 5 as csv_size, strlen(md_text) + 6 as md_size
           from texts"""
    ),
    "report_csv": on_report(
        f"""select 'report.csv' as file, 0 as section, 0 as pos, {CSV_HEAD.replace("{counts}", ALL_CSV)}
              {CSV_ROWS_HEAD} as text
            union all select 'report.csv', 1, pos, csv_text from ranked"""
    ),
    "report_json": on_report(
        f"""select 'report.json' as file, 0 as section, 0 as pos,
              '{{' || chr(10) || '    "summary": {{' || {ALL_JSON} || '}},' || chr(10) || '    "results": [' as text
            union all select 'report.json', 1, pos, json_text || case when pos < n_rows then ',' else '' end
            from ranked
            union all select 'report.json', 2, 0, '    ]' || chr(10) || '}}'"""
    ),
    "report_md": on_report(
        f"""select 'report.md' as file, 0 as section, 0 as pos, {MD_HEAD.replace("{counts}", ALL_MD)} as text
            union all select 'report.md', 1, pos, '### ' || pos || md_text from ranked"""
    ),
    "report_summary": on_report(
        f"""select 0 as section, 0 as pos, {CSV_HEAD.replace("{counts}", ALL_CSV)}
              || '--- 詳細日誌已分割 ---' || chr(13) || chr(10) || '請參考下列檔案' as text
            union all
            select 1, row_number() over (order by first_seen), 'report_' || level || '.csv' from counts"""
    ),
    "split_by_level": on_report(
        f"""select 'report_' || level || '.csv' as file, 0 as section, 0 as pos, {LEVEL_CSV_HEAD} as text
            from counts
            union all select 'report_' || level || '.csv', 1, level_pos, csv_text from ranked
            union all select 'report_summary.csv', 0, 0, {CSV_HEAD.replace("{counts}", ALL_CSV)}
              {CSV_SPLIT_HEAD}
            union all select 'report_summary.csv', 1, row_number() over (order by first_seen),
              'report_' || level || '.csv' from counts"""
    ),
    "split_by_size": recursive(
        on_report(
            f"""select 'report' || {PART_NAME} || '.csv' as file, 1 as section, cast(idx as bigint) as pos, csv_text as text
                from parted
                union all
                select 'report' || {PART_NAME} || '.csv', 0, 0, {CSV_HEAD.replace("{counts}", ALL_CSV)} {CSV_ROWS_HEAD}
                from (select distinct part_no, n_parts from parted)
                union all
                select 'report_summary.csv', 0, 0, {CSV_HEAD.replace("{counts}", ALL_CSV)} {CSV_SPLIT_HEAD}
                union all
                select 'report_summary.csv', 1, part_no, 'report' || {PART_NAME} || '.csv'
                from (select distinct part_no, n_parts from parted)""",
            packed("", f"strlen({CSV_HEAD.replace('{counts}', ALL_CSV)} {CSV_ROWS_HEAD}) + 5", CSV_SIZE, SPLIT),
        )
    ),
    "split_by_level_and_size": recursive(
        on_report(
            f"""select 'report_' || level || {PART_NAME} || '.md' as file, 1 as section, cast(idx as bigint) as pos,
                  '### ' || idx || md_text as text from parted
                union all
                select 'report_' || level || {PART_NAME} || '.md', 0, 0, {LEVEL_MD_HEAD}
                from (select distinct level, part_no, n_parts from parted) join counts using (level)
                union all select 'report_summary.md', 0, 0, {MD_SPLIT_HEAD}
                union all select 'report_summary.md', 1, ordinal, '- `' || file || '`' from (
                  select row_number() over (order by first_seen, part_no) as ordinal,
                    'report_' || level || {PART_NAME} || '.md' as file
                  from (select distinct level, part_no, n_parts from parted) join counts using (level))""",
            packed("level", f"strlen({LEVEL_MD_HEAD}) + 1", MD_SIZE, SPLIT),
        )
    ),
    "output_manifest": recursive(on_report("select * from manifest", BY_LEVEL_CSV, MANIFEST)),
}

RUN_ENTRIES = """
kept as (select * from entries where entry_time >= timestamp '2024-01-05 06:00:00'
  and upper(level) in ('ERROR', 'WARN', 'INFO')),
counts as (
  select level, count(*) as n, min(struct_pack(f := filename, l := line_num)) as first_seen
  from kept group by level)"""
RUN_MANIFEST = f"""
parts as (select distinct level, part_no, n_parts, 'report_' || level || {PART_NAME} || '.md' as file from parted),
manifest as (
  select cast(0 as bigint) as ordinal, '' as level, cast(0 as bigint) as part_no, 'report_summary.md' as file
  union all
  select row_number() over (order by first_seen, part_no), level, part_no, file
  from parts join counts using (level))"""
ORACLE["run_analysis"] = recursive(
    sql(
        """select m.*, (select cast(sum(n) as bigint) from counts) as total_logs,
             (select count(*) from groups) as matched_groups,
             (select cast(sum("count") as bigint) from groups) as matched_occurrences
           from manifest m""",
        headers(),
        ASSIGNED,
        ENTRIES,
        RUN_ENTRIES,
        groups("kept"),
        TEXTS,
        packed("level", f"strlen({LEVEL_MD_HEAD}) + 1", MD_SIZE, SPLIT),
        RUN_MANIFEST,
    )
)

ORACLE["merge_saved_groups"] = ORACLE["merge_groups"]
