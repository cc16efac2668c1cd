"""Turns, transcripts, chunks and quote evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import fold_yo, normalize
from ..operators import chunking, evidence, pii, transcript
from .registry import query

WORDS = "[а-яёa-z0-9@€$%+]+"


def hms(x: str) -> str:
    return f"printf('%02d:%02d:%02d', CAST(floor({x}) AS BIGINT) // 3600, CAST(floor({x}) AS BIGINT) // 60 % 60, CAST(floor({x}) AS BIGINT) % 60)"


def written(a: str, b: str) -> str:
    return f"concat('[', {hms(a)}, ' - ', {hms(b)}, '] ', speaker, ':', chr(10), text)"


TURNS_SQL = """
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY first_seg) AS turn_no,
       CASE WHEN coalesce(speaker, '') = '' THEN 'UNKNOWN_SPEAKER' ELSE speaker END AS speaker,
       CASE WHEN run = 0 THEN 0.0 ELSE start_s END AS start_s, end_s, text
FROM (SELECT meeting_id, run, min(seg_no) AS first_seg, any_value(speaker) AS speaker, arg_min(start_s, seg_no) AS start_s,
             arg_max(end_s, seg_no) AS end_s, string_agg(trim(text), ' ' ORDER BY seg_no) FILTER (WHERE trim(text) <> '') AS text
      FROM (SELECT *, sum(CASE WHEN speaker IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END)
                      OVER (PARTITION BY meeting_id ORDER BY seg_no) AS run
            FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seg_no) AS prev FROM {fx_segments}) a) b
      GROUP BY meeting_id, run) c
WHERE text IS NOT NULL"""


@query("speaker_turns", TURNS_SQL)
def speaker_turns(x):
    return transcript.speaker_turns(x["fx_segments"])


@query("turn_offsets", f"""
WITH t AS (SELECT *, CAST(length({written('start_sec', 'end_sec')}) AS BIGINT) AS char_len FROM {{fx_turns}})
SELECT meeting_id, turn_no, start_sec, char_len,
       CAST(coalesce(sum(char_len + 2) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
FROM t""")
def turn_offsets(x):
    return transcript.turn_offsets(x["fx_turns"]).select("meeting_id", "turn_no", "start_sec", "char_len", "char_offset")


@query("render_transcript", f"""
SELECT meeting_id, concat(string_agg({written('start_s', 'end_s')}, chr(10) || chr(10) ORDER BY turn_no), chr(10)) AS text
FROM ({TURNS_SQL}) t GROUP BY meeting_id""")
def render_transcript(x):
    return transcript.render_transcript(transcript.speaker_turns(x["fx_segments"]))


@query("parse_turns", """
SELECT meeting_id, turn_no, speaker, start_sec, end_sec, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM {fx_turns}
UNION ALL
SELECT -1 - doc_id, 0, 'SPEAKER', 0, 0, text FROM documents""")
def parse_turns(x):
    written_texts = transcript.render_transcript(x["fx_turns"])
    plain = x["documents"].select((-1 - F.col("doc_id")).alias("meeting_id"), "text")
    return transcript.parse_turns(written_texts.unionByName(plain))


@query("attendees", "SELECT DISTINCT meeting_id, speaker FROM {fx_segments} WHERE speaker <> ''")
def attendees(x):
    return transcript.attendees(x["fx_segments"])


CHUNK_SIZE, CHUNK_OVERLAP = 800, 250


CHUNKS_SQL = f"""
WITH t AS (SELECT meeting_id, turn_no, start_sec, end_sec, {written('start_sec', 'end_sec')} AS line,
                  row_number() OVER (PARTITION BY meeting_id ORDER BY turn_no) - 1 AS pos FROM {{fx_turns}}),
p AS (SELECT meeting_id, pos, CAST(coalesce(sum(length(line)) OVER (PARTITION BY meeting_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t
      UNION ALL SELECT meeting_id, count(*), sum(length(line)) FROM t GROUP BY meeting_id),
m AS (SELECT meeting_id, max(pos) AS n, max(before) AS chars FROM p GROUP BY meeting_id),
e AS (SELECT a.meeting_id, a.pos AS s, greatest(a.pos + 1, max(b.pos)) AS e
      FROM p a JOIN p b ON a.meeting_id = b.meeting_id AND b.pos >= a.pos AND b.before - a.before <= {CHUNK_SIZE}
      JOIN m ON m.meeting_id = a.meeting_id WHERE a.pos < m.n GROUP BY a.meeting_id, a.pos),
f AS (SELECT e.meeting_id, e.s, e.e, greatest(e.s + 1, coalesce(max(j.pos), 0)) AS nxt
      FROM e JOIN p z ON z.meeting_id = e.meeting_id AND z.pos = e.e
      LEFT JOIN p j ON j.meeting_id = e.meeting_id AND j.pos < e.e AND z.before - j.before >= {CHUNK_OVERLAP}
      GROUP BY e.meeting_id, e.s, e.e),
w AS (SELECT f.meeting_id, CAST(1 AS BIGINT) AS chunk_id, f.s, CASE WHEN m.chars <= {2 * CHUNK_SIZE} THEN m.n ELSE f.e END AS e, f.nxt
      FROM f JOIN m USING (meeting_id) WHERE f.s = 0
      UNION ALL
      SELECT f.meeting_id, w.chunk_id + 1, f.s, f.e, f.nxt
      FROM w JOIN m USING (meeting_id) JOIN f ON f.meeting_id = w.meeting_id AND f.s = w.nxt WHERE w.e < m.n)
SELECT w.meeting_id, w.chunk_id, min(t.turn_no) AS turn_from, max(t.turn_no) AS turn_to, {hms('arg_min(t.start_sec, t.pos)')} AS start_time,
       {hms('arg_max(t.end_sec, t.pos)')} AS end_time, count(*) AS n_turns, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       string_agg(line, chr(10) || chr(10) ORDER BY t.pos) AS text
FROM w JOIN t ON t.meeting_id = w.meeting_id AND t.pos >= w.s AND t.pos < w.e GROUP BY w.meeting_id, w.chunk_id"""


@query("build_chunks", CHUNKS_SQL, recursive=True)
def build_chunks(x):
    return chunking.build_chunks(x["fx_turns"], CHUNK_SIZE, CHUNK_OVERLAP)


def word_segments(x):
    """Segments with word timings: two turns in three are timed, some words are not."""
    timed = F.transform(F.split("text", " "), lambda w, i: F.struct(
        w.alias("word"), F.when(i % 5 != 4, F.col("start_sec") + i * 0.5).alias("start")))
    return x["fx_turns"].select(
        "meeting_id", F.col("turn_no").alias("seg_no"), F.col("start_sec").cast("double").alias("start_s"), "text",
        F.when(F.col("turn_no") % 3 != 0, timed).otherwise(F.array().cast("array<struct<word:string,start:double>>")).alias("words"))


TIMED_SQL = f"""
SELECT meeting_id, seg_no, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no, i) - 1 AS word_no, word, start_s FROM (
  SELECT meeting_id, turn_no AS seg_no, i, replace(lower(trim(w, ' ,.!?—-…:;"''«»')), 'ё', 'е') AS word,
         CASE WHEN (i - 1) % 5 <> 4 THEN start_sec + (i - 1) * 0.5 ELSE start_sec END AS start_s
  FROM (SELECT *, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM {{fx_turns}} WHERE turn_no % 3 <> 0) a
  UNION ALL
  SELECT meeting_id, turn_no AS seg_no, i, replace(w, 'ё', 'е') AS word, CAST(start_sec AS DOUBLE) AS start_s
  FROM (SELECT *, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{WORDS}'), 1) AS i
        FROM {{fx_turns}} WHERE turn_no % 3 = 0) b) c
WHERE word <> ''"""


@query("word_timings", TIMED_SQL)
def word_timings(x):
    return transcript.word_timings(word_segments(x))


def runs_sql(quotes: str, hay: str) -> str:
    """Brute force over equal word pairs: (meeting_id, item_no, part_no, word_no, run_len)."""
    return f"""
SELECT meeting_id, item_no, part_no, word_no, run_len FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, item_no ORDER BY run_len DESC, qp, part_no, word_no) AS rn FROM (
    SELECT meeting_id, item_no, part_no, d, g, any_value(nq) AS nq, count(*) AS run_len, min(qp) AS qp, min(hp) AS word_no FROM (
      SELECT *, qp - row_number() OVER (PARTITION BY meeting_id, item_no, part_no, d ORDER BY qp) AS g FROM (
        SELECT q.meeting_id, q.item_no, q.nq, q.qp, h.part_no, h.hp, h.hp - q.qp AS d
        FROM {quotes} q JOIN {hay} h ON h.meeting_id = q.meeting_id AND h.word = q.word) a) b
    GROUP BY meeting_id, item_no, part_no, d, g) c
  WHERE run_len >= least(4, nq)) r
WHERE rn = 1"""


def quote_words_sql(view: str) -> str:
    arr = f"regexp_extract_all(replace(lower(quote), 'ё', 'е'), '{WORDS}')"
    return f"SELECT meeting_id, item_no, len({arr}) AS nq, unnest({arr}) AS word, generate_subscripts({arr}, 1) - 1 AS qp FROM {view}"


@query("anchor_quotes", f"""
WITH q AS ({quote_words_sql('{fx_quotes}')}),
t AS (SELECT doc_id AS meeting_id, text, regexp_extract_all(replace(lower(text), 'ё', 'е'), '{WORDS}') AS ws FROM documents),
h AS (SELECT meeting_id, CAST(0 AS BIGINT) AS part_no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS hp FROM t),
r AS ({runs_sql('q', 'h')})
SELECT r.*, CAST(length(array_to_string(string_split_regex(text, '(?i){WORDS}')[1:word_no + 1], ''))
            + length(array_to_string(regexp_extract_all(text, '(?i){WORDS}')[1:word_no], '')) AS BIGINT) AS char_pos
FROM r JOIN t USING (meeting_id)""")
def anchor_quotes(x):
    texts = x["documents"].select(F.col("doc_id").alias("meeting_id"), F.lit(0).cast("long").alias("part_no"), "text")
    return evidence.anchor_quotes(x["fx_quotes"], texts)


TIME_SQL = f"""
WITH q AS ({quote_words_sql('{fx_turn_quotes}')}),
lines AS (SELECT meeting_id, turn_no AS part_no, start_sec, regexp_extract_all(replace(lower({written('start_sec', 'end_sec')}), 'ё', 'е'), '{WORDS}') AS ws FROM {{fx_turns}}),
h AS (SELECT meeting_id, part_no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS hp FROM lines),
r AS ({runs_sql('q', 'h')}),
tw AS (SELECT meeting_id, CAST(0 AS BIGINT) AS part_no, word_no AS hp, word, start_s FROM ({TIMED_SQL}) k),
rt AS ({runs_sql('q', 'tw')})
SELECT z.meeting_id, z.item_no, r.meeting_id IS NOT NULL AS verified,
       CASE WHEN r.meeting_id IS NOT NULL THEN coalesce(CAST(floor(tw.start_s) AS BIGINT), l.start_sec) END AS t_sec
FROM {{fx_turn_quotes}} z LEFT JOIN r ON r.meeting_id = z.meeting_id AND r.item_no = z.item_no
LEFT JOIN lines l ON l.meeting_id = r.meeting_id AND l.part_no = r.part_no
LEFT JOIN rt ON rt.meeting_id = z.meeting_id AND rt.item_no = z.item_no
LEFT JOIN tw ON tw.meeting_id = rt.meeting_id AND tw.hp = rt.word_no"""


def timed_quotes(x):
    turns = x["fx_turns"].select("meeting_id", "turn_no", "start_sec", transcript.turn_text(x["fx_turns"]).alias("line"))
    return evidence.quote_time(x["fx_turn_quotes"], turns, transcript.word_timings(word_segments(x)))


@query("quote_t_sec", TIME_SQL)
def quote_t_sec(x):
    return timed_quotes(x)


@query("evidence_quality", f"""
SELECT meeting_id, count(*) FILTER (WHERE trim(quote) <> '') AS n_quotes, count(*) FILTER (WHERE trim(quote) <> '' AND verified) AS n_verified,
       count(t_sec) AS n_timed, count(*) FILTER (WHERE item_no % 4 <> 3) AS n_tasks, count(*) FILTER (WHERE item_no % 4 = 3) AS n_minor
FROM ({TIME_SQL}) v JOIN {{fx_turn_quotes}} USING (meeting_id, item_no) GROUP BY meeting_id""")
def evidence_quality(x):
    items = x["fx_turn_quotes"].withColumn("kind", F.when(F.col("item_no") % 4 != 3, "task").otherwise("minor"))
    return evidence.evidence_quality(items.join(timed_quotes(x), ["meeting_id", "item_no"]))


@query("asof_turn_time", f"""
WITH t AS (SELECT *, CAST(length({written('start_sec', 'end_sec')}) AS BIGINT) AS char_len FROM {{fx_turns}}),
o AS (SELECT meeting_id, start_sec, coalesce(sum(char_len + 2) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset FROM t),
q AS (SELECT conv_id AS meeting_id, turn AS item_no, turn * 500 + length(text) AS char_pos FROM conversations)
SELECT q.meeting_id, q.item_no, q.char_pos, o.start_sec AS t_sec
FROM q ASOF LEFT JOIN o ON o.meeting_id = q.meeting_id AND q.char_pos >= o.char_offset""")
def asof_turn_time(x):
    positions = x["conversations"].select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("item_no"),
                                          (F.col("turn") * 500 + F.length("text")).alias("char_pos"))
    return evidence.asof_turn_time(positions, transcript.turn_offsets(x["fx_turns"]))


SAMPLES_SQL = """
SELECT s.meeting_id, s.speaker, s.t_sec, coalesce(l.samples, '') AS samples FROM
 (SELECT meeting_id, speaker, arg_min(start_sec, turn_no) AS t_sec FROM {fx_turns} GROUP BY 1, 2) s LEFT JOIN
 (SELECT meeting_id, speaker, string_agg(line, ' | ' ORDER BY rn) AS samples FROM (
   SELECT meeting_id, speaker, line, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY turn_no, i) AS rn FROM (
     SELECT meeting_id, speaker, turn_no, trim(unnest(string_split(text, chr(10)))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {fx_turns}) a WHERE line <> '') b
  WHERE rn <= 3 GROUP BY 1, 2) l USING (meeting_id, speaker)"""


@query("speaker_samples", SAMPLES_SQL)
def speaker_samples(x):
    return transcript.speaker_samples(x["fx_turns"])


@query("speaker_review", f"""
SELECT s.*, coalesce(m.person, '') AS person FROM ({SAMPLES_SQL}) s
LEFT JOIN {{fx_speaker_map}} m ON m.meeting_id = s.meeting_id AND m.speaker_label = s.speaker""")
def speaker_review(x):
    return transcript.speaker_review(transcript.speaker_samples(x["fx_turns"]), x["fx_speaker_map"])


@query("apply_speaker_map", f"""
WITH u AS (SELECT meeting_id, max(CASE WHEN speaker_label = 'SPEAKER_user' THEN person END) AS pu,
                  max(CASE WHEN speaker_label = 'SPEAKER_assistant' THEN person END) AS pa,
                  max(CASE WHEN speaker_label = 'SPEAKER_system' THEN person END) AS ps FROM {{fx_speaker_map}} GROUP BY 1)
SELECT t.meeting_id, turn_no, replace(replace(replace(line, 'SPEAKER_user', coalesce(pu, 'SPEAKER_user')), 'SPEAKER_assistant', coalesce(pa, 'SPEAKER_assistant')),
         'SPEAKER_system', coalesce(ps, 'SPEAKER_system')) AS text
FROM (SELECT meeting_id, turn_no, concat({written('start_sec', 'end_sec')}, ' (SPEAKER_user, SPEAKER_assistant)') AS line FROM {{fx_turns}}) t
LEFT JOIN u ON u.meeting_id = t.meeting_id""")
def apply_speaker_map(x):
    texts = x["fx_turns"].select("meeting_id", "turn_no", F.concat(
        transcript.turn_text(x["fx_turns"]), F.lit(" (SPEAKER_user, SPEAKER_assistant)")).alias("text"))
    codes = x["fx_speaker_map"].select("meeting_id", F.col("speaker_label").alias("code"), F.col("person").alias("value"))
    return pii.replace_codes(texts, ["meeting_id", "turn_no"], codes, r"SPEAKER_\w+")


@query("content_hash", "SELECT doc_id AS meeting_id, sha256(text) AS content_hash FROM documents")
def content_hash(x):
    return x["documents"].select(F.col("doc_id").alias("meeting_id"), F.sha2("text", 256).alias("content_hash"))


@query("format_timecodes", f"""
SELECT event_id, {hms('floor(greatest(value * event_id, 0))')} AS hms, CAST(floor(greatest(value * event_id, 0)) AS BIGINT) AS seconds,
       printf('%d:%02d', event_id // 60, event_id % 60) AS timecode, '00:00:00' AS negative
FROM events""")
def format_timecodes(x):
    tag = times.hms(F.col("value") * F.col("event_id"))
    return x["events"].select("event_id", tag.alias("hms"), times.seconds_of(tag).alias("seconds"),
                              times.timecode(F.col("event_id")).alias("timecode"),
                              times.hms(-F.abs("value")).alias("negative"))


@query("normalize_text", """
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS norm,
       replace(lower(text), 'ё', 'е') AS folded FROM documents""")
def normalize_text(x):
    return x["documents"].select("doc_id", normalize(F.col("text")).alias("norm"),
                                 fold_yo(F.col("text")).alias("folded"))


