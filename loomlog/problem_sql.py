"""SQL for DuckDB that gives the rows of the core problems' queries by plain patterns and joins."""

from __future__ import annotations

_ISO_SQL = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_MONTHS_SQL = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_LEVEL_SQL = "(?i:debug|dbg|trace|info|notice|warn|warning|error|err|crit|critical|fatal|emerg|emergency|[DIWEF])"
P2 = rf"""
WITH lines AS (SELECT file_id, line_no, regexp_replace(raw, '\x1b\[[0-9;]*m', '', 'g') AS s FROM rawmessage WHERE file_id IS NOT NULL AND line_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY raw_id) = 1),
filled AS (SELECT * FROM lines WHERE s IS NOT NULL AND trim(s, chr(9) || ' ' || chr(13) || chr(10)) <> ''),
found AS (
    SELECT *, CASE
        WHEN regexp_matches(s, '^(?:<\d{{1,3}}>)?{_MONTHS_SQL} [ \d]\d \d\d:\d\d:\d\d \S+ [^\s\[\]:]+(?:\[\d+\])?: ') THEN 'bsd'
        WHEN regexp_matches(s, '^<\d{{1,3}}>1 {_ISO_SQL} \S+ \S+ \S+ \S+ (?:-|\[.*?\]) ') THEN 'ietf'
        WHEN regexp_matches(s, '^[DIWEF]\d{{4}} \d\d:\d\d:\d\d\.\d+ +\d+ [^\s:]+:\d+\] ') THEN 'glog'
        WHEN regexp_matches(s, '^{_ISO_SQL} +{_LEVEL_SQL} +\[[^\]]*\] \S+ - ') THEN 'logger'
        WHEN regexp_matches(s, '^\[{_ISO_SQL}\] \[{_LEVEL_SQL}\] \[[^\]\s]+\] ') THEN 'bracket'
        WHEN regexp_matches(s, '^{_ISO_SQL}\|{_LEVEL_SQL}\|[^|]+\|\d+\|') THEN 'pipe'
        WHEN regexp_matches(s, '^\d{{10}}\.\d+ [^\s/]+/\d+ {_LEVEL_SQL} ') THEN 'epoch'
        WHEN regexp_matches(s, '^\d+\.\d+\.\d+\.\d+ \S+ \S+ \[\d\d/{_MONTHS_SQL}/\d{{4}}:[^\]]+\] "[^"]*" \d+ ') THEN 'access'
        WHEN regexp_matches(s, '^\{{.*"(?:time|@t)": ?"{_ISO_SQL}".*\}}$') THEN 'json'
        WHEN regexp_matches(s, '^ts={_ISO_SQL} ') THEN 'logfmt'
    END AS kind FROM filled
),
stated AS (
    SELECT *, CASE kind
        WHEN 'bsd' THEN regexp_extract(s, '\d\d:\d\d:\d\d \S+ ([^\s\[\]:]+)(?:\[\d+\])?: ', 1)
        WHEN 'ietf' THEN regexp_extract(s, '^<\d+>1 {_ISO_SQL} \S+ (\S+) ', 1)
        WHEN 'glog' THEN regexp_extract(s, '^\S+ \S+ +\d+ ([^\s:]+):', 1)
        WHEN 'logger' THEN regexp_extract(s, '\[[^\]]*\] (\S+) - ', 1)
        WHEN 'bracket' THEN regexp_extract(s, '^\[[^\]]+\] \[[^\]]+\] \[([^\]\s]+)\]', 1)
        WHEN 'pipe' THEN split_part(s, '|', 3)
        WHEN 'epoch' THEN regexp_extract(s, '^\S+ ([^\s/]+)/', 1)
        WHEN 'json' THEN regexp_extract(s, '"(?:logger|name)": ?"([^"]*)"', 1)
        WHEN 'logfmt' THEN regexp_extract(s, ' component=(\S+)', 1)
    END AS named, lower(CASE kind
        WHEN 'bsd' THEN regexp_extract(s, '^[^:]+:\d\d:\d\d \S+ [^\s\[\]:]+(?:\[\d+\])?: ({_LEVEL_SQL}): ', 1)
        WHEN 'glog' THEN s[1]
        WHEN 'logger' THEN regexp_extract(s, '^{_ISO_SQL} +(\w+)', 1)
        WHEN 'bracket' THEN regexp_extract(s, '^\[[^\]]+\] \[(\w+)\]', 1)
        WHEN 'pipe' THEN split_part(s, '|', 2)
        WHEN 'epoch' THEN regexp_extract(s, '^\S+ \S+ (\w+) ', 1)
        WHEN 'json' THEN regexp_extract(s, '"(?:severity|lvl|level)": ?"([^"]*)"', 1)
        WHEN 'logfmt' THEN regexp_extract(s, ' level=(\w+)', 1)
        ELSE '' END) AS word, nullif(regexp_extract(s, '^<(\d+)>', 1), '')::INT % 8 AS severity
    FROM found
),
numbered AS (SELECT *, count(kind) OVER (PARTITION BY file_id ORDER BY line_no) AS entry FROM stated)
SELECT file_id, min(line_no) AS first_line_no, max(line_no) AS last_line_no,
    CASE
        WHEN max(word) IN ('d', 'debug', 'dbg', 'trace') THEN 'debug' WHEN max(word) IN ('i', 'info', 'notice') THEN 'info' WHEN max(word) IN ('w', 'warn', 'warning') THEN 'warn'
        WHEN max(word) IN ('e', 'err', 'error') THEN 'error' WHEN max(word) IN ('f', 'fatal', 'crit', 'critical', 'emerg', 'emergency') THEN 'fatal'
        WHEN max(severity) FILTER (WHERE kind IS NOT NULL) IS NULL THEN 'none'
        ELSE ['fatal', 'fatal', 'fatal', 'error', 'warn', 'info', 'info', 'debug'][max(severity) FILTER (WHERE kind IS NOT NULL) + 1]
    END AS level, coalesce(nullif(max(named), ''), 'none') AS component
FROM numbered WHERE entry > 0 GROUP BY file_id, entry"""

#: A field of a CSV record; dots don't stop at line breaks here.
_CSV = r'(?:"(?:[^"]|"")*"|[^",]*)'
P5 = rf"""
WITH records AS (SELECT rec_id, schema_name, raw_msg FROM logparseerror WHERE raw_msg IS NOT NULL AND trim(raw_msg, chr(9) || chr(10) || chr(13) || ' ') <> ''),
wanted AS (SELECT schema_name, count(*) AS n FROM parsercoldef GROUP BY 1),
split AS (SELECT rec_id, schema_name, regexp_full_match(raw_msg, '(?s){_CSV}(?:,{_CSV})*') AS sound, regexp_extract_all(',' || raw_msg, '(?s),({_CSV})', 1) AS parts FROM records),
fields AS (SELECT rec_id, schema_name, unnest(parts) AS part, unnest(range(len(parts))) AS col_pos FROM split JOIN wanted USING (schema_name) WHERE sound AND len(parts) = n),
plain AS (SELECT rec_id, schema_name, col_pos, CASE WHEN part LIKE '"%' THEN replace(part[2:-2], '""', '"') ELSE part END AS v FROM fields),
judged AS (
    SELECT rec_id, col_pos, CASE
        WHEN v = '' THEN CASE WHEN required THEN 'missing_value' END
        WHEN pv_type LIKE 'str%' AND strlen(v) > CASE WHEN pv_type = 'str' THEN 256 ELSE split_part(pv_type, ':', 2)::INT END THEN 'invalid_value'
        WHEN pv_type IN ('int', 'long') AND (NOT regexp_full_match(v, '[+-]?[0-9]+') OR try_cast(v AS BIGINT) IS NULL) THEN 'invalid_value'
        WHEN pv_type IN ('float', 'double') AND NOT regexp_full_match(v, '(?i)[+-]?(?:inf|infinity|nan|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)') THEN 'invalid_value'
        WHEN pv_type = 'bool' AND lower(v) NOT IN ('true', 'false') THEN 'invalid_value'
        WHEN pv_type = 'ts:%b %e %H:%M:%S' AND (NOT regexp_full_match(v, '[A-Za-z]{{3}} ( ?[0-9]|[0-9]{{2}}) [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_strptime('2000 ' || v, '%Y %b %d %H:%M:%S') IS NULL) THEN 'invalid_value'
        WHEN pv_type = 'ts:%Y-%m-%dT%H:%M:%S' AND (NOT regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_strptime(v, '%Y-%m-%dT%H:%M:%S') IS NULL) THEN 'invalid_value'
        WHEN pv_type LIKE 'ts:%z' AND (NOT regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\.[0-9]{{3}}[+-][0-9]{{2}}:?[0-9]{{2}}') OR try_strptime(v[:19], '%Y-%m-%dT%H:%M:%S') IS NULL) THEN 'invalid_value'
    END AS reason
    FROM plain JOIN parsercoldef USING (schema_name, col_pos)
)
SELECT rec_id, 'quoting' AS reason FROM split JOIN wanted USING (schema_name) WHERE NOT sound
UNION ALL SELECT rec_id, 'column_count' FROM split JOIN wanted USING (schema_name) WHERE sound AND len(parts) <> n
UNION ALL SELECT rec_id, first(reason ORDER BY col_pos) FROM judged WHERE reason IS NOT NULL GROUP BY rec_id"""

P6 = r"""
WITH trimmed AS (SELECT capture_id, regexp_replace(lower(trim(timestamp, chr(9) || chr(10) || chr(13) || ' ')), ' +', ' ', 'g') AS x, zone, received_at FROM syslogcapture LEFT JOIN logsource USING (logsource) WHERE timestamp IS NOT NULL),
shaped AS (
    SELECT *, CASE
        WHEN regexp_full_match(x, '\d{10}|\d{13}') THEN 'epoch'
        WHEN regexp_full_match(x, '\d{4}-\d\d-\d\d[t ]\d\d:\d\d:\d\d([.,]\d{1,9})? ?(z|[+-]\d\d:?\d\d)?') THEN 'iso'
        WHEN regexp_full_match(x, '[a-z]{3} \d{1,2} \d\d:\d\d:\d\d') THEN 'month'
        WHEN regexp_full_match(x, '\d\d/[a-z]{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d\d:?\d\d') THEN 'access'
        WHEN regexp_full_match(x, '\d\d/\d\d/\d{4} \d\d:\d\d:\d\d [ap]m') THEN 'half'
        WHEN regexp_full_match(x, '\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d') THEN 'dots'
        WHEN regexp_full_match(x, '[a-z]{3} [a-z]{3} \d{1,2} \d\d:\d\d:\d\d \d{4}') THEN 'ctime'
        WHEN regexp_full_match(x, '[a-z]{3}, \d\d [a-z]{3} \d{4} \d\d:\d\d:\d\d [a-z]{1,4}') THEN 'mail'
        WHEN regexp_full_match(x, '\d\d/\d\d/\d\d \d\d:\d\d') THEN 'short'
        WHEN regexp_full_match(x, '\d\d-\d\d \d\d:\d\d:\d\d[.,]\d{1,9}') THEN 'noyear'
    END AS kind FROM trimmed
),
years AS (SELECT *, unnest(CASE WHEN kind IN ('month', 'noyear') THEN range(year(received_at AT TIME ZONE 'UTC') - 8, year(received_at AT TIME ZONE 'UTC') + 2) ELSE [NULL] END) AS y FROM shaped WHERE kind IS NOT NULL),
clocks AS (
    SELECT *, CASE kind
        WHEN 'iso' THEN try_strptime(x[:10] || ' ' || x[12:19], '%Y-%m-%d %H:%M:%S')
        WHEN 'month' THEN try_strptime(y || ' ' || x, '%Y %b %d %H:%M:%S')
        WHEN 'access' THEN try_strptime(x[:20], '%d/%b/%Y:%H:%M:%S')
        WHEN 'half' THEN try_strptime(upper(x), '%m/%d/%Y %I:%M:%S %p')
        WHEN 'dots' THEN try_strptime(x, '%d.%m.%Y %H:%M:%S')
        WHEN 'ctime' THEN try_strptime(x[5:], '%b %d %H:%M:%S %Y')
        WHEN 'mail' THEN try_strptime(x[6:25], '%d %b %Y %H:%M:%S')
        WHEN 'short' THEN try_strptime('20' || x[7:8] || x[3:6] || x[:2] || x[9:], '%Y/%m/%d %H:%M')
        WHEN 'noyear' THEN try_strptime(y || '-' || x[:14], '%Y-%m-%d %H:%M:%S')
    END AS wall,
    CASE WHEN kind IN ('iso', 'noyear') THEN coalesce(rpad(nullif(regexp_extract(x, '\d\d:\d\d:\d\d[.,](\d+)', 1), ''), 6, '0')[:6]::BIGINT, 0) ELSE 0 END AS micro,
    CASE
        WHEN kind IN ('iso', 'access') AND regexp_matches(x, '[+-]\d\d:?\d\d$') THEN
            (CASE WHEN regexp_extract(x, '([+-])\d\d:?\d\d$', 1) = '-' THEN -1 ELSE 1 END) * (regexp_extract(x, '[+-](\d\d):?\d\d$', 1)::INT * 60 + regexp_extract(x, '[+-]\d\d:?(\d\d)$', 1)::INT)
        WHEN kind = 'iso' AND x LIKE '%z' THEN 0
        WHEN kind = 'mail' THEN map {'utc': 0, 'gmt': 0, 'z': 0, 'cet': 60, 'cest': 120, 'est': -300, 'edt': -240, 'ist': 330, 'aest': 600, 'aedt': 660}[regexp_extract(x, '([a-z]+)$', 1)]
    END AS shift
    FROM years
),
instants AS (
    SELECT capture_id, received_at, y, epoch_us(wall) - shift::BIGINT * 60000000 + micro AS us, true AS zoned FROM clocks WHERE shift IS NOT NULL AND wall IS NOT NULL AND (kind <> 'mail' OR lower(strftime(wall, '%a')) = x[:3])
    UNION
    SELECT capture_id, received_at, y, CASE WHEN len(x) = 10 THEN x::BIGINT * 1000000 ELSE x::BIGINT * 1000 END, true FROM shaped, (SELECT NULL AS y) WHERE kind = 'epoch'
    UNION
    SELECT capture_id, received_at, y, epoch_us(u) + micro, false
    FROM (SELECT *, (wall AT TIME ZONE zone) + INTERVAL (k) HOUR AS u FROM clocks, (SELECT unnest([-1, 0, 1]) AS k) WHERE shift IS NULL AND kind <> 'mail' AND wall IS NOT NULL AND zone IS NOT NULL AND (kind <> 'ctime' OR lower(strftime(wall, '%a')) = x[:3]))
    WHERE u AT TIME ZONE zone = wall
),
chosen AS (
    SELECT capture_id, CASE WHEN bool_and(zoned) THEN max(us) WHEN max(y) IS NULL AND count(*) = 1 THEN max(us) ELSE max(us) FILTER (WHERE us <= epoch_us(received_at)) END AS us
    FROM instants GROUP BY capture_id
)
SELECT capture_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_utc FROM chosen WHERE us IS NOT NULL"""

P5_REJECTS = P5.replace("SELECT rec_id, col_pos, CASE", "SELECT rec_id, col_pos, name, CASE").split(")\nSELECT rec_id, 'quoting'")[0] + """)
, told AS (
    SELECT rec_id, 'quoting' AS "desc" FROM split JOIN wanted USING (schema_name) WHERE NOT sound
    UNION ALL SELECT rec_id, 'column_count' FROM split JOIN wanted USING (schema_name) WHERE sound AND len(parts) <> n
    UNION ALL SELECT rec_id, first(reason || ': ' || name ORDER BY col_pos) FROM judged WHERE reason IS NOT NULL GROUP BY rec_id
    UNION ALL SELECT rec_id, 'no_schema' FROM records WHERE schema_name IS NULL OR schema_name NOT IN (SELECT schema_name FROM wanted))
SELECT rec_id AS row_id, "desc", raw_msg FROM told JOIN records USING (rec_id)"""
P5_VALUES = P5.split(")\nSELECT rec_id, 'quoting'")[0] + """)
SELECT rec_id AS row_id, name, nullif(v, '') AS value FROM plain JOIN parsercoldef USING (schema_name, col_pos) WHERE rec_id NOT IN (SELECT rec_id FROM judged WHERE reason IS NOT NULL)"""

ORACLES = {"p2_found": P2, "p5_found": P5, "p5_rejects": P5_REJECTS, "p5_values": P5_VALUES, "p6_found": P6}
