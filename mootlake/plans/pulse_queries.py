"""Series, pulse, inbox and board queries over the meeting views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from .fixtures import AS_OF
from .registry import query



def day(text: str = AS_OF):
    return F.to_date(F.lit(text))


D = f"DATE '{AS_OF}'"
LABEL = "regexp_matches(owner, '(?i)^(SPEAKER|PERSON|UNKNOWN)[_ ]?')"
IN_WINDOW = f"date >= {D} - 90"

SERIES_SQL = f"""
SELECT series, n, last_date, CAST({D} - last_date AS BIGINT) AS days_since,
       CASE WHEN n > 1 THEN round_even(n / (greatest(1, last_date - first) / 7.0), 1) ELSE CAST(n AS DOUBLE) END AS per_week,
       n_actions, n_decisions
FROM (SELECT CASE WHEN category = '' THEN 'Общее' ELSE category END AS series, count(*) AS n, min(date) AS first,
             max(date) AS last_date, CAST(sum(n_actions) AS BIGINT) AS n_actions, CAST(sum(n_decisions) AS BIGINT) AS n_decisions
      FROM {{fx_meetings}} WHERE date IS NOT NULL GROUP BY 1) g"""


@query("series_stats", SERIES_SQL)
def series_stats(x):
    return series.series_stats(x["fx_meetings"], day())


# The meetings end on the day before the look-back day, so no series is silent;
# the silent report is asked for a later day.
LATER = "2001-08-20"


@query("silent_series", f"SELECT * FROM ({SERIES_SQL.replace(AS_OF, LATER)}) s WHERE days_since > 14")
def silent_series(x):
    return series.silent_series(x["fx_meetings"], day(LATER))


KPI_SQL = f"""
WITH m AS (SELECT * FROM {{fx_meetings}} WHERE {IN_WINDOW}),
t AS (SELECT * FROM {{fx_proposals}} WHERE kind = 'task' AND meeting_id IN (SELECT id FROM m)),
a AS (SELECT count(*) AS n_meetings, CAST(coalesce(sum(n_actions), 0) AS BIGINT) AS n_actions,
             CAST(coalesce(sum(n_decisions), 0) AS BIGINT) AS n_decisions FROM m),
b AS (SELECT count(*) AS n_tasks, count(*) FILTER (WHERE owner IS NULL OR owner = '' OR {LABEL}) AS no_owner FROM t)
SELECT CAST(90 AS BIGINT) AS days, n_meetings, n_actions, n_decisions, n_tasks, no_owner,
       CASE WHEN n_tasks > 0 THEN CAST(floor(no_owner * 100.0 / n_tasks + 0.5) AS BIGINT) ELSE 0 END AS no_owner_pct,
       CASE WHEN n_meetings > 0 THEN round(n_actions / n_meetings, 1) ELSE 0.0 END AS actions_per_meeting,
       CASE WHEN n_meetings > 0 THEN round(n_decisions / n_meetings, 1) ELSE 0.0 END AS decisions_per_meeting
FROM a, b"""


@query("pulse_kpis", KPI_SQL)
def pulse_kpis(x):
    return series.pulse_kpis(x["fx_meetings"], x["fx_proposals"], day())


OWNER_SQL = f"""
SELECT owner, count(*) AS n FROM {{fx_proposals}}
WHERE kind = 'task' AND owner <> '' AND NOT {LABEL} AND meeting_id IN (SELECT id FROM {{fx_meetings}} WHERE {IN_WINDOW})
GROUP BY owner ORDER BY n DESC, min((seq, id)) LIMIT 8"""
SECTION_SQL = f"""
SELECT trim(section) AS section, count(*) AS n FROM {{fx_proposals}}
WHERE trim(section) <> '' AND meeting_id IN (SELECT id FROM {{fx_meetings}} WHERE {IN_WINDOW})
GROUP BY 1 ORDER BY n DESC, min((seq, id)) LIMIT 8"""
RHYTHM_SQL = f"""
SELECT w AS week, count(m.id) AS n_meetings
FROM range(12) t(w) LEFT JOIN (SELECT id, 11 - ({D} - date) // 7 AS week FROM {{fx_meetings}}
                               WHERE {IN_WINDOW} AND date <= {D}) m ON m.week = w
GROUP BY w"""


@query("pulse_by_owner", OWNER_SQL)
def pulse_by_owner(x):
    return series.pulse_by_owner(x["fx_meetings"], x["fx_proposals"], day())


@query("pulse_by_section", SECTION_SQL)
def pulse_by_section(x):
    return series.pulse_by_section(x["fx_meetings"], x["fx_proposals"], day())


@query("weekly_rhythm", RHYTHM_SQL)
def weekly_rhythm(x):
    return series.weekly_rhythm(x["fx_meetings"], day())


@query("pulse", f"""
WITH k AS ({KPI_SQL.strip()}), s AS ({SERIES_SQL})
SELECT 'kpi' AS part, key, value FROM (UNPIVOT (SELECT days, n_meetings, n_actions, n_decisions, n_tasks, no_owner, no_owner_pct FROM k)
  ON COLUMNS(*) INTO NAME key VALUE value)
UNION ALL SELECT 'week', CAST(week AS VARCHAR), n_meetings FROM ({RHYTHM_SQL})
UNION ALL SELECT 'owner', owner, n FROM ({OWNER_SQL})
UNION ALL SELECT 'section', section, n FROM ({SECTION_SQL})
UNION ALL SELECT 'silent', series, days_since FROM s WHERE days_since > 14""")
def pulse(x):
    return series.pulse(x["fx_meetings"], x["fx_proposals"], day())


@query("inbox_meetings", """
SELECT m.id, date, title, category, count(*) AS n_total,
       count(*) FILTER (WHERE p.status = 'proposed' AND p.kind = 'task') AS n_pending,
       date_source IN ('mtime', 'processing_day') AS date_is_indirect
FROM {fx_meetings} m JOIN {fx_proposals} p ON p.meeting_id = m.id GROUP BY ALL
ORDER BY date DESC NULLS LAST, m.id DESC LIMIT 30""")
def inbox_meetings(x):
    return series.inbox_meetings(x["fx_meetings"], x["fx_proposals"])


@query("open_tasks_for_series", """
SELECT series, rank, id, text, owner, m_date, m_title FROM (
  SELECT CASE WHEN m.category = '' THEN 'Общее' ELSE m.category END AS series, p.id, p.text, p.owner, m.date AS m_date,
         m.title AS m_title,
         row_number() OVER (PARTITION BY CASE WHEN m.category = '' THEN 'Общее' ELSE m.category END
                            ORDER BY m.date DESC NULLS LAST, p.idx, p.id) AS rank
  FROM {fx_proposals} p JOIN {fx_meetings} m ON p.meeting_id = m.id
  WHERE p.kind = 'task' AND p.status IN ('proposed', 'accepted')) r
WHERE rank <= 12""")
def open_tasks_for_series(x):
    return series.open_tasks_for_series(x["fx_meetings"], x["fx_proposals"])


@query("brief_latest", """
SELECT series, rank, id, date, title FROM (
  SELECT CASE WHEN category = '' THEN 'Общее' ELSE category END AS series, id, date, title,
         row_number() OVER (PARTITION BY CASE WHEN category = '' THEN 'Общее' ELSE category END ORDER BY date DESC, id DESC) AS rank
  FROM {fx_meetings} WHERE date IS NOT NULL) r
WHERE rank <= 6""")
def brief_latest(x):
    return series.latest_per_series(x["fx_meetings"])


@query("due_drift", """
WITH j AS (SELECT * FROM {fx_journal} WHERE card_id <> '' ORDER BY seq DESC, proposal_id DESC LIMIT 50)
SELECT j.proposal_id, j.text, j.owner, j.due_v1, c.due AS current_due, coalesce(CAST(c.due - j.due_v1 AS BIGINT), 0) AS moved_days,
       coalesce(c.closed OR c.due_complete, false) AS closed, c.card_id IS NULL AS missing
FROM j LEFT JOIN {fx_cards} c ON c.card_id = j.card_id""")
def due_drift(x):
    return series.due_drift(x["fx_journal"], x["fx_cards"])


NOW = "2001-08-02 09:30:00"
OVERDUE_SQL = f"""
SELECT card_id, name, due, CAST(floor(epoch(TIMESTAMP '{NOW}' - CAST(due AS TIMESTAMP)) / 86400) AS BIGINT) AS days
FROM {{fx_cards}} c
WHERE NOT closed AND NOT due_complete AND CAST(due AS TIMESTAMP) < TIMESTAMP '{NOW}'
  AND list_id NOT IN (SELECT list_id FROM {{fx_lists}} l, (VALUES ('готово'), ('✅ готово'), ('done'), ('✅ done'), ('сделано')) d(n)
                      WHERE contains(lower(trim(l.name)), d.n))"""


@query("overdue_cards", OVERDUE_SQL)
def overdue_cards(x):
    return series.overdue_cards(x["fx_cards"], x["fx_lists"], F.to_timestamp(F.lit(NOW)))


@query("overdue_digest", f"""
WITH o AS ({OVERDUE_SQL}), t AS (SELECT * FROM o ORDER BY days DESC, card_id LIMIT 15), c AS (SELECT count(*) AS n FROM o)
SELECT n AS n_overdue, concat_ws(chr(10), concat('⏰ Просроченных задач на доске: ', n),
  (SELECT string_agg(concat('• ', name, ' — до ', strftime(due, '%d.%m'), ' (', CASE WHEN days > 0 THEN concat('+', days, ' дн.') ELSE 'сегодня' END, ')'),
                     chr(10) ORDER BY days DESC, card_id) FROM t),
  CASE WHEN n > 15 THEN concat('…и ещё ', n - 15) END, 'Статусы двигаем в Trello, бот только напоминает.') AS message
FROM c WHERE n > 0""")
def overdue_digest(x):
    return series.overdue_digest(series.overdue_cards(x["fx_cards"], x["fx_lists"], F.to_timestamp(F.lit(NOW))))


@query("meeting_search", """
WITH h AS (SELECT * FROM {fx_meetings} WHERE contains(lower(title), 'ting 10') OR contains(lower(category), 'ting 10')
           OR contains(lower(subcategory), 'ting 10') OR contains(lower(stem), 'ting 10'))
SELECT id, date, title, category, (SELECT greatest(count(*) - 40, 0) FROM h) AS n_more
FROM h ORDER BY date DESC NULLS LAST, id DESC LIMIT 40""")
def meeting_search(x):
    return series.meeting_search(x["fx_meetings"], " TING 10 ")


@query("extraction_profile", """
SELECT kind, owner_class, month, count(*) AS n, count(due) AS n_due, grouping_id(kind, owner_class, month) AS level
FROM (SELECT kind, due, strftime(due, '%Y-%m') AS month,
             CASE WHEN owner IS NULL OR owner = '' THEN 'none' WHEN regexp_matches(owner, '(?i)^(SPEAKER|PERSON|UNKNOWN)[_ ]?')
                  THEN 'label' ELSE 'person' END AS owner_class
      FROM {fx_proposals}) t
GROUP BY ROLLUP (kind, owner_class, month)""")
def extraction_profile(x):
    return series.extraction_profile(x["fx_proposals"])


@query("archive_by_category", """
SELECT CASE WHEN category = '' THEN 'Общее' ELSE category END AS series, count(*) AS n_meetings, max(date) AS last_date,
       count(*) FILTER (WHERE n_actions > 0) AS n_detailed
FROM {fx_meetings} GROUP BY 1""")
def archive_by_category(x):
    return series.archive_by_category(x["fx_meetings"])
