"""SQL of the failing and the valid records: fields by regular expressions, dates by casts.

Independent of the operators beside it but for the lists of month and zone names.
"""

from __future__ import annotations

from marlstone.functions.timestamps import MONTH_NAMES, ZONE_MINUTES

_B = r"[\s\x{85}\x{200b}\x{feff}\pZ]"
_QUOTED = r'"(?:[^"]|"")*"'
_FIELD = rf'(?:{_QUOTED}|[^"\t][^\t]*|)'
_ZONE = rf"((?:utc|gmt)?{_B}?[+\-]\d{{1,2}}(?::?\d{{2}})?|{'|'.join(sorted({*ZONE_MINUTES, 'cst', 'ist'}))})(?:{_B}*\([a-z]+\))?"
_TIME = rf"(?:(?:t|,?{_B}+(?:at{_B}+)?)(\d{{1,2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?)?(?:{_B}*([ap])\.?{_B}?m\.?)?(?:{_B}*{_ZONE})?)?"
_DOW = rf"(?:\pL{{2,10}}\.?,{_B}*)?"
#: Date patterns of three groups, and which of them are year, month and day; ``s`` is decided by size.
_FORMS = [
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "abc"),
    (rf"(\d{{4}}){_B}*[年년]{_B}*(\d{{1,2}}){_B}*[月월]{_B}*(\d{{1,2}}){_B}*[日일]", "abc"),
    (rf"{_DOW}(\d{{1,2}})(?:st|nd|rd|th|er|\.|º)?(?:{_B}+|-)(?:(?:de|of){_B}+)?(\pL{{3,12}})\.?,?(?:{_B}+|-)(?:(?:de|del){_B}+)?(\d{{4}}|\d{{2}})(?:{_B}*(?:года|г\.))?", "cBa"),
    (rf"{_DOW}(\pL{{3,12}})\.?{_B}+(\d{{1,2}})(?:st|nd|rd|th)?,?{_B}+(\d{{4}})", "cAb"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", "cba"),
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})", "css"),
]
_SLASH = f"f{len(_FORMS) - 1}"
_COMPACT = rf"^{_B}*(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?(?:{_ZONE})?)?{_B}*$"
_MONTHS = "MAP {" + ", ".join(f"'{n}': {k}" for n, k in {n: k % 12 + 1 for names in MONTH_NAMES.values() for k, n in enumerate(names.split())}.items()) + "}"


def _first(values: list[str]) -> str:
    return f"coalesce({', '.join(values)})"


def _part(which: int) -> str:
    """Year, month or day of the form that matched."""
    values = []
    for k, (_, groups) in enumerate(_FORMS):
        g = groups[which]
        if g != "s":
            values.append(f"CAST({_MONTHS}[f{k}.{g.lower()}] AS VARCHAR)" if g.isupper() else f"nullif(f{k}.{g}, '')")
    return _first([*values, f"nullif(fc.{'abc'[which]}, '')"])


def _clock(name: str) -> str:
    return _first([f"nullif(f{k}.{name}, '')" for k in range(len(_FORMS))] + ([f"nullif(fc.{name}, '')"] if name != "ap" else []))


_INT = lambda x: f"TRY_CAST({x} AS INT)"
_LATE = f"{_INT(_SLASH + '.b')} > 12"
_PARSED = ", ".join(f"regexp_extract(v, '^{_B}*{p}{_TIME}{_B}*$', ['a', 'b', 'c', 'h', 'i', 's', 'ap', 'z']) AS f{k}" for k, (p, _) in enumerate(_FORMS))
_CTES = f"""
l AS (SELECT line_id, source, line, regexp_full_match(line, '{_FIELD}(?:\\t{_FIELD})*', 's') AS good, regexp_replace(line, '(^|\\t){_QUOTED}', '\\1Q', 'g') AS bare, regexp_extract(line, '^({_QUOTED}|[^\\t]*)', 1) AS a
      FROM articles_raw WHERE line IS NOT NULL AND NOT regexp_full_match(line, '{_B}*')),
u AS (SELECT line_id, source, good, len(bare) - len(replace(bare, chr(9), '')) + 1 AS n, CASE WHEN a LIKE '"%' THEN replace(substr(a, 2, len(a) - 2), '""', '"') ELSE a END AS d,
      CASE WHEN substr(line, len(a) + 2) LIKE '"%' THEN replace(substr(line, len(a) + 3, len(line) - len(a) - 3), '""', '"') ELSE substr(line, len(a) + 2) END AS t FROM l),
x0 AS (SELECT DISTINCT d, lower(d) AS v FROM u WHERE good AND n = 2),
x AS (SELECT d, v, {_PARSED}, regexp_extract(v, '{_COMPACT}', ['a', 'b', 'c', 'h', 'i', 's', 'z']) AS fc FROM x0),
y AS (SELECT d, v, {_part(0)} AS y, CASE WHEN {_SLASH}.a <> '' THEN CASE WHEN {_LATE} THEN {_SLASH}.a ELSE {_SLASH}.b END ELSE {_part(1)} END AS m,
      CASE WHEN {_SLASH}.a <> '' THEN CASE WHEN {_LATE} THEN {_SLASH}.b ELSE {_SLASH}.a END ELSE {_part(2)} END AS dd, {_clock("h")} AS h, {_clock("i")} AS i, coalesce({_clock("s")}, '0') AS s, {_clock("ap")} AS ap FROM x),
ok AS (SELECT d, regexp_full_match(v, '{_B}*(?:\\d{{10}}|\\d{{13}}|\\d{{16}}|\\d{{19}}){_B}*')
      OR (TRY_CAST(lpad(CASE WHEN len(y) = 2 THEN '20' || y ELSE y END, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) IS NOT NULL AND {_INT("y")} > 0
        AND (h IS NULL OR {_INT("s")} < 60 AND CASE WHEN ap IS NOT NULL THEN {_INT("h")} BETWEEN 1 AND 12 AND {_INT("coalesce(i, '0')")} < 60
          ELSE i IS NOT NULL AND ({_INT("h")} < 24 AND {_INT("i")} < 60 OR {_INT("h")} = 24 AND {_INT("i")} = 0 AND {_INT("s")} = 0) END)) AS ok FROM y),
judged AS (SELECT u.*, CASE WHEN NOT good THEN 'quoting' WHEN n <> 2 THEN 'columns' WHEN NOT coalesce(ok, FALSE) OR regexp_full_match(t, '{_B}*') THEN 'value' END AS reason FROM u LEFT JOIN ok USING (d))"""
FAILED = f"WITH {_CTES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
VALID = f"WITH {_CTES} SELECT line_id, source, d AS date, CAST(length(t) AS INTEGER) AS text_chars FROM judged WHERE reason IS NULL"

_MDY = f"CASE WHEN ord = 'MDY' THEN NOT ({_INT(_SLASH + '.a')} > 12 AND {_INT(_SLASH + '.b')} <= 12) ELSE {_INT(_SLASH + '.b')} > 12 AND {_INT(_SLASH + '.a')} <= 12 END"
_ZONES = "MAP {" + ", ".join(f"'{z}': {m}" for z, m in ZONE_MINUTES.items()) + "}"
_SIGNED = "regexp_extract(z, '^(?:utc|gmt)?([+-])(\\d{1,2}):?(\\d{2})?$', ['sign', 'hh', 'mm'])"
#: Dates of both article tables in the one form. A wall time that occurs twice is looked up an hour earlier too.
MOMENTS = f"""WITH {_CTES},
rule AS (SELECT source, min(tz_name) AS tz, min(day_order) AS ord FROM sources GROUP BY source),
rec AS (SELECT 'articles_scraped' AS tbl, article_id AS row_id, date, coalesce(source, nullif(regexp_extract(lower(url), '^\\s*[a-z]+://+(?:www\\.|m\\.)?([^/?#:\\s]+)', 1), '')) AS source FROM articles_scraped
  UNION ALL SELECT 'articles', line_id, date, source FROM articles WHERE line_id IN (SELECT line_id FROM judged WHERE reason IS NULL)),
r AS (SELECT tbl, row_id, date, coalesce(tz, 'UTC') AS tz, coalesce(ord, 'DMY') AS ord, lower(date) AS v FROM rec LEFT JOIN rule USING (source)),
k0 AS (SELECT *, {_PARSED}, regexp_extract(v, '{_COMPACT}', ['a', 'b', 'c', 'h', 'i', 's', 'z']) AS fc, regexp_extract(v, '^{_B}*(\\d{{10}}|\\d{{13}}|\\d{{16}}|\\d{{19}}){_B}*$', 1) AS ep FROM r),
k AS (SELECT tbl, row_id, date, tz, ep, {_part(0)} AS y, CASE WHEN {_SLASH}.a <> '' THEN CASE WHEN {_MDY} THEN {_SLASH}.a ELSE {_SLASH}.b END ELSE {_part(1)} END AS m,
      CASE WHEN {_SLASH}.a <> '' THEN CASE WHEN {_MDY} THEN {_SLASH}.b ELSE {_SLASH}.a END ELSE {_part(2)} END AS dd, {_clock("h")} AS h, {_clock("i")} AS i, coalesce({_clock("s")}, '0') AS s, {_clock("ap")} AS ap,
      regexp_replace({_clock("z")}, '{_B}', '', 'g') AS z FROM k0),
q AS (SELECT *, {_SIGNED} AS off, TRY_CAST(lpad(CASE WHEN len(y) = 2 THEN '20' || y ELSE y END, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day,
      CASE WHEN ap IS NOT NULL THEN CASE WHEN {_INT("h")} BETWEEN 1 AND 12 THEN {_INT("h")} % 12 + CASE WHEN ap = 'p' THEN 12 ELSE 0 END END ELSE {_INT("h")} END AS hh, {_INT("CASE WHEN ap IS NOT NULL THEN coalesce(i, '0') ELSE i END")} AS mi FROM k),
w AS (SELECT *, CASE WHEN (hh < 24 AND mi < 60 OR hh = 24 AND mi = 0 AND {_INT("s")} = 0) AND {_INT("s")} < 60 THEN day + hh * INTERVAL 1 HOUR + mi * INTERVAL 1 MINUTE + {_INT("s")} * INTERVAL 1 SECOND END AS wall,
      CASE WHEN off.sign <> '' THEN (CASE WHEN off.sign = '-' THEN -1 ELSE 1 END) * ({_INT("off.hh")} * 60 + coalesce({_INT("off.mm")}, 0)) ELSE {_ZONES}[z] END AS minutes FROM q),
o AS (SELECT *, CASE WHEN ep <> '' THEN make_timestamp((CAST(left(ep, 10) AS BIGINT)) * 1000000) WHEN z IS NOT NULL THEN wall - minutes * INTERVAL 1 MINUTE
      WHEN timezone(tz, timezone(tz, wall) - INTERVAL 1 HOUR) = wall THEN timezone('UTC', timezone(tz, wall) - INTERVAL 1 HOUR) ELSE timezone('UTC', timezone(tz, wall)) END AS utc FROM w),
f AS (SELECT tbl, row_id, date, CASE WHEN ep <> '' OR h IS NOT NULL THEN strftime(utc, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(day, '%Y-%m-%d') END AS utc_text FROM o)
SELECT tbl, row_id, utc_text FROM f WHERE utc_text IS NOT NULL AND utc_text <> date"""
