"""Personal data, people, review state, file routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import slugify, source_key
from ..operators import archive, people, pii, state, transcript
from ..session import scratch_path, stage_table
from ..streaming import dispatch
from ..streaming.common import file_stream
from .fixtures import EVENTS_AS_OF, VIEWS
from .registry import query

# --- personal data -----------------------------------------------------------

W = "\\pL\\pN_"
# (type, pattern with the match in group 2, the text before it in group 1)
PATTERNS = [
    ("EMAIL", f"(^|[^{W}])([A-Za-z0-9_][A-Za-z0-9._%+\\-]*@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b)"),
    ("URL", "()(https?://[^\\s\\])\"''>»]+)"),
    ("DOMAIN", f"(?i)(^|[^/@{W}])((?:[a-z0-9](?:[a-z0-9\\-]{{0,61}}[a-z0-9])?\\.)+(?:com|org|net|io|ru|de|uk|fr|es|it|co|gov|edu|biz|info|ai)\\b)"),
    ("PHONE", "()((?:\\+7|8)[\\s\\-]?\\(?\\d{3}\\)?[\\s\\-]?\\d{3}[\\s\\-]?\\d{2}[\\s\\-]?\\d{2}|\\+\\d{1,3}[\\s\\-]\\d{2,4}[\\s\\-]\\d{3,4}[\\s\\-]\\d{3,4})"),
    ("TRANSACTION", f"(^|[^{W}])([A-Z]{{2,6}}[-_]?\\d{{6,}}\\b|\\d{{12,}}\\b)"),
]
TIME = "()(\\[?\\d{1,2}:\\d{2}(?::\\d{2})?(?:\\s*-\\s*\\d{1,2}:\\d{2}(?::\\d{2})?)?\\]?)"


def matches_sql(kind: str, rank: int, pattern: str) -> str:
    def arr(group: int) -> str:
        return f"regexp_extract_all(text, '{pattern}', {group})"
    return f"""
SELECT meeting_id, part, '{kind}' AS type, {rank} AS rank, n, value, start, start + length(value) AS stop FROM (
  SELECT meeting_id, part, n, value, pos + length(pre) AS start FROM (
    SELECT meeting_id, part, n, value, pre, list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(alls[1:n - 1], lambda g: length(g))), 0) AS pos FROM (
      SELECT meeting_id, part, string_split_regex(text, '{pattern}') AS gaps, {arr(0)} AS alls,
             unnest({arr(0)}) AS whole, unnest({arr(1)}) AS pre, unnest({arr(2)}) AS value, generate_subscripts({arr(0)}, 1) AS n
      FROM p WHERE regexp_matches(text, '{pattern}')) a) b) c"""


def spans_ctes() -> str:
    """p(texts) -> sp(meeting_id, part, type, start, stop, value, nth)."""
    parts = [f"tc AS ({matches_sql('TIME', 0, TIME)})"]
    clear = "NOT EXISTS (SELECT 1 FROM {0} t WHERE t.meeting_id = m.meeting_id AND t.part = m.part AND t.start < m.stop AND m.start < t.stop)"
    taken: list[str] = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        name = f"k{rank}"
        rules = " AND ".join(clear.format(t) for t in ["tc", *taken])
        parts.append(f"m{rank} AS ({matches_sql(kind, rank, pattern)}), {name} AS (SELECT * FROM m{rank} m WHERE {rules})")
        taken.append(name)
    union = " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken)
    parts.append(f"""sp AS (SELECT meeting_id, part, type, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value,
       row_number() OVER (PARTITION BY meeting_id, part ORDER BY rank, n) - 1 AS nth FROM ({union}) u)""")
    return ",\n".join(parts)


SPANS = f"WITH p AS (SELECT * FROM {{fx_pii}}), {spans_ctes()}"
TOKENS = f"""{SPANS},
f AS (SELECT meeting_id, value, arg_min(type, (part, nth)) AS type, min((part, nth)) AS seen FROM sp GROUP BY 1, 2),
tk AS (SELECT meeting_id, type, row_number() OVER (PARTITION BY meeting_id, type ORDER BY seen) AS n, value FROM f),
tm AS (SELECT *, concat(type, '_', printf('%03d', n)) AS token FROM tk)"""


def spans(x):
    return pii.pii_spans(x["fx_pii"])


@query("pii_spans", f"{SPANS} SELECT meeting_id, part, nth, type, start, stop, value FROM sp")
def pii_spans(x):
    return spans(x)


@query("pii_tokens", f"{TOKENS} SELECT meeting_id, type, n, token, value FROM tm")
def pii_tokens(x):
    return pii.pii_tokens(spans(x))


MASKED = f"""{TOKENS},
pc AS (SELECT sp.meeting_id, sp.part, sp.start, sp.stop, token,
       coalesce(lag(sp.stop) OVER (PARTITION BY sp.meeting_id, sp.part ORDER BY sp.start), 0) AS before
       FROM sp JOIN tm ON tm.meeting_id = sp.meeting_id AND tm.value = sp.value),
mk AS (SELECT p.meeting_id, p.part, CASE WHEN count(pc.start) = 0 THEN any_value(p.text)
              ELSE concat(string_agg(concat(substring(p.text, before + 1, pc.start - before), token), '' ORDER BY pc.start),
                          substring(any_value(p.text), max(pc.stop) + 1)) END AS text
       FROM p LEFT JOIN pc ON pc.meeting_id = p.meeting_id AND pc.part = p.part GROUP BY p.meeting_id, p.part)"""


def span_table(x):
    """The spans are a stage of their own: found once, used for map and mask."""
    return stage_table(spans(x), "spans")


def masked(x, found):
    return pii.pii_mask(x["fx_pii"], found, pii.pii_tokens(found))


@query("pii_masked", f"{MASKED} SELECT meeting_id, part, text FROM mk")
def pii_masked(x):
    return masked(x, span_table(x))


@query("deanonymize", "SELECT meeting_id, part, text FROM {fx_pii}")
def deanonymize(x):
    found = span_table(x)
    return pii.restore(masked(x, found), ["meeting_id", "part"], pii.pii_tokens(found))


@query("unresolved_tokens", f"""{TOKENS},
a AS (SELECT doc_id AS meeting_id, unnest([concat('EMAIL_00', CAST(1 + doc_id % 3 AS VARCHAR)), 'URL_001', 'PERSON_014']) AS token FROM documents)
SELECT meeting_id, token FROM a ANTI JOIN tm USING (meeting_id, token)""")
def unresolved_tokens(x):
    texts = x["documents"].select(F.col("doc_id").alias("meeting_id"), F.concat(
        F.lit("ask EMAIL_00"), (1 + F.col("doc_id") % 3).cast("string"), F.lit(", PERSON_014 or URL_001, not XURL_001, PERSON_014")).alias("text"))
    return pii.unresolved_tokens(texts, ["meeting_id"], pii.pii_tokens(spans(x))).select("meeting_id", "token")


@query("invented_owners", f"""{TOKENS},
a AS (SELECT doc_id AS meeting_id, CASE doc_id % 3 WHEN 0 THEN 'EMAIL_001' WHEN 1 THEN lang ELSE NULL END AS owner FROM documents)
SELECT a.meeting_id, CASE WHEN owner = 'EMAIL_001' AND tm.token IS NULL THEN NULL ELSE owner END AS owner,
       CASE WHEN owner = 'EMAIL_001' AND tm.token IS NULL THEN 'модель вернула несуществующий токен: EMAIL_001' END AS owner_note
FROM a LEFT JOIN tm ON tm.meeting_id = a.meeting_id AND tm.token = a.owner""")
def invented_owners(x):
    rows = x["documents"].select(F.col("doc_id").alias("meeting_id"), F.when(F.col("doc_id") % 3 == 0, "EMAIL_001").when(
        F.col("doc_id") % 3 == 1, F.col("lang")).alias("owner"))
    return pii.clear_invented_owners(rows, ["meeting_id"], pii.pii_tokens(spans(x)))


VIEWS["fx_entities"] = """
SELECT value, min(label) AS label FROM (
  SELECT split_part(text, ' ', 1) AS value, 'PERSON' AS label FROM {benchmark}
  UNION ALL SELECT concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS value, 'COMPANY' AS label FROM {benchmark}) t
GROUP BY value"""
ENT_WORD = f"[{W}''’-]+"
DICT = f"""
w AS (SELECT meeting_id, part, text, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, ws, gaps FROM (
        SELECT *, regexp_extract_all(text, '{ENT_WORD}') AS ws, string_split_regex(text, '{ENT_WORD}') AS gaps FROM p) a),
g AS (SELECT meeting_id, part, text, ws, gaps, i, array_to_string(ws[i:i + k - 1], ' ') AS value FROM w, range(1, 4) r(k) WHERE i + k - 1 <= len(ws)),
es AS (SELECT meeting_id, part, type, value, start, start + length(value) AS stop FROM (
        SELECT meeting_id, part, text, label AS type, g.value, CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(ws[1:i - 1], '')) AS BIGINT) AS start
        FROM g JOIN {{fx_entities}} e ON e.value = g.value
        WHERE length(trim(e.value)) >= 3 AND lower(e.value) NOT IN ('yes', 'no', 'ok', 'info', 'error', 'warn')) b
       WHERE substring(text, start + 1, length(value)) = value)"""


@query("pii_dictionary", f"WITH p AS (SELECT * FROM {{fx_pii}}), {DICT} SELECT meeting_id, part, start, stop, type, value FROM es")
def pii_dictionary(x):
    return pii.dictionary_spans(x["fx_pii"], x["fx_entities"])


@query("pii_entity_spans", f"""
WITH RECURSIVE p AS (SELECT * FROM {{fx_pii}}), {spans_ctes()}, {DICT},
fe AS (SELECT m.*, row_number() OVER (PARTITION BY m.meeting_id, m.part ORDER BY m.start, m.stop, m.type) AS rn FROM es m
       WHERE NOT EXISTS (SELECT 1 FROM tc t WHERE t.meeting_id = m.meeting_id AND t.part = m.part AND t.start < m.stop AND m.start < t.stop)
         AND NOT EXISTS (SELECT 1 FROM sp t WHERE t.meeting_id = m.meeting_id AND t.part = m.part AND t.start < m.stop AND m.start < t.stop)),
st AS (SELECT meeting_id, part, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS reach, CAST(false AS BOOLEAN) AS took FROM (SELECT DISTINCT meeting_id, part FROM fe) z
       UNION ALL SELECT st.meeting_id, st.part, fe.rn, CASE WHEN fe.start >= st.reach THEN fe.stop ELSE st.reach END, fe.start >= st.reach
       FROM st JOIN fe ON fe.meeting_id = st.meeting_id AND fe.part = st.part AND fe.rn = st.rn + 1)
SELECT meeting_id, part, type, start, stop, value FROM sp
UNION ALL SELECT fe.meeting_id, fe.part, fe.type, fe.start, fe.stop, fe.value FROM fe JOIN st USING (meeting_id, part, rn) WHERE took""".replace("WITH RECURSIVE ", "WITH "), recursive=True)
def pii_entity_spans(x):
    found = pii.dictionary_spans(x["fx_pii"], x["fx_entities"])
    return pii.with_entities(x["fx_pii"], found).drop("nth")


# --- people ------------------------------------------------------------------


@query("dim_people", """
SELECT arg_min(trim(name), ord) AS name, min(ord) AS ord FROM (
  SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('  ', p_name, ' ') ELSE p_name END AS name, p_partkey AS ord FROM part) t
WHERE trim(name) <> '' GROUP BY lower(trim(name))""")
def dim_people(x):
    name = (F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name"))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_name")))
    return people.registry(x["part"].select(name.alias("name"), F.col("p_partkey").alias("ord")))


@query("registry_additions", """
SELECT DISTINCT trim(raw) AS name FROM {fx_raw_owners} WHERE trim(raw) <> '' AND trim(raw) NOT IN (SELECT name FROM {fx_people})""")
def registry_additions(x):
    return people.registry_additions(x["fx_people"], x["fx_raw_owners"].select(F.col("raw").alias("name")))


STEM = "coalesce(nullif(regexp_extract(replace(lower({0}), 'ё', 'е'), '^(.{{2}}.*?)[аеиоуыэюяйь]*$', 1), ''), replace(lower({0}), 'ё', 'е'))"


def owners_sql(raws: str, registry: str) -> str:
    """raw, owner, matched of every distinct spelling."""
    return f"""
WITH c AS (SELECT DISTINCT raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS flat FROM {raws} WHERE raw IS NOT NULL),
l AS (SELECT raw, CASE WHEN lower(flat) NOT IN ('', '-', '—', 'null', 'none', 'не назначен', 'не назначено', 'не указан', 'не указано', 'unknown', 'n/a', 'tbd') THEN flat END AS clean FROM c),
b AS (SELECT raw, clean, coalesce(nullif(trim(string_split_regex(clean, '[(,/]| или | и ')[1]), ''), clean) AS base FROM l
      WHERE clean IS NOT NULL AND NOT regexp_matches(clean, '(?i)^(SPEAKER|PERSON|UNKNOWN)[_ ]?')),
t AS (SELECT raw, 0 AS attempt, base AS word FROM b UNION ALL SELECT raw, 1, split_part(base, ' ', 1) FROM b WHERE contains(base, ' ')),
s AS (SELECT raw, attempt, replace(lower(word), 'ё', 'е') AS f, {STEM.format('word')} AS st FROM t),
p AS (SELECT name, ord, replace(lower(name), 'ё', 'е') AS f, {STEM.format('name')} AS st FROM {registry}),
m AS (SELECT raw, name, attempt, CASE WHEN p.f = s.f THEN 0 ELSE 1 END AS rule, ord FROM s JOIN p ON p.f = s.f OR p.st = s.st
        OR (least(length(p.st), length(s.st)) >= 3 AND abs(length(p.st) - length(s.st)) <= 3 AND (starts_with(p.st, s.st) OR starts_with(s.st, p.st)))),
h AS (SELECT raw, arg_min(name, (attempt, rule, ord)) AS person FROM m GROUP BY raw)
SELECT l.raw, coalesce(h.person, l.clean) AS owner, h.person IS NOT NULL AS matched FROM l LEFT JOIN h ON h.raw = l.raw"""


@query("normalize_owner", f"""
SELECT o.meeting_id, o.idx, o.part_no, o.supp_no, o.raw, w.owner, coalesce(w.matched, false) AS matched
FROM {{fx_raw_owners}} o LEFT JOIN ({owners_sql('{fx_raw_owners}', '{fx_people}')}) w ON w.raw = o.raw""")
def normalize_owner(x):
    return people.normalize_owner(x["fx_raw_owners"], x["fx_people"])


@query("match_members", """
WITH o AS (SELECT DISTINCT owner, lower(trim(owner)) AS n FROM {fx_proposals} WHERE owner IS NOT NULL),
m AS (SELECT concat('m', s_suppkey) AS member_id, s_suppkey AS ord, lower(concat('Team ', s_name)) AS full_name, concat('user', s_suppkey) AS username FROM supplier)
SELECT owner, arg_min(member_id, ord) AS member_id FROM o JOIN m ON n = full_name OR n = username OR list_contains(string_split(full_name, ' '), n)
WHERE NOT starts_with(n, 'speaker_') AND NOT starts_with(n, 'person_') GROUP BY owner""")
def match_members(x):
    members = x["supplier"].select(F.concat(F.lit("m"), "s_suppkey").alias("member_id"), F.col("s_suppkey").alias("ord"),
                                   F.concat(F.lit("Team "), "s_name").alias("full_name"), F.concat(F.lit("user"), "s_suppkey").alias("username"))
    return people.match_members(x["fx_proposals"], members)


@query("match_labels", """
WITH l AS (SELECT lower(trim(p_brand)) AS key, arg_min(concat('lb', p_partkey), p_partkey) AS label_id FROM part GROUP BY 1)
SELECT DISTINCT section, label_id FROM {fx_proposals} JOIN l ON l.key = lower(trim(section)) WHERE trim(section) <> ''""")
def match_labels(x):
    labels = x["part"].select(F.concat(F.lit("lb"), "p_partkey").alias("label_id"), F.col("p_partkey").alias("ord"),
                              F.concat(F.lit(" "), F.upper("p_brand")).alias("name"))
    return people.match_labels(x["fx_proposals"], labels)


# --- review state ------------------------------------------------------------

SRC = "substring(sha1(replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ё', 'е')), 1, 16)"


@query("src_key", f"SELECT doc_id, {SRC.format('text')} AS src_key FROM documents")
def src_key(x):
    return x["documents"].select("doc_id", source_key(F.col("text")).alias("src_key"))


@query("upsert_meetings", """
WITH n AS (SELECT dir, stem, coalesce(nullif(last(title ORDER BY batch_no), ''), stem) AS title, coalesce(last(category ORDER BY batch_no), '') AS category,
             last(date ORDER BY batch_no) FILTER (WHERE date IS NOT NULL) AS date, last(coalesce(date_source, '') ORDER BY batch_no) FILTER (WHERE date IS NOT NULL) AS date_source,
             last(content_hash ORDER BY batch_no) FILTER (WHERE content_hash <> '') AS content_hash FROM {fx_meeting_batch} GROUP BY dir, stem)
SELECT dir, stem, coalesce(n.title, o.title) AS title, coalesce(n.category, o.category) AS category, coalesce(n.date, o.date) AS date,
       CASE WHEN n.date IS NOT NULL THEN n.date_source ELSE coalesce(o.date_source, '') END AS date_source, coalesce(n.content_hash, o.content_hash) AS content_hash
FROM {fx_old_meetings} o FULL JOIN n USING (dir, stem)""")
def upsert_meetings(x):
    return state.upsert_meetings(x["fx_old_meetings"], x["fx_meeting_batch"])


def first_fields(src: str, status: str) -> str:
    return f"""SELECT * FROM (SELECT meeting_id, {SRC.format('task')} AS src_key, idx, trim(task) AS text, nullif(owner, '') AS owner, lower(confidence) AS confidence,
  CASE WHEN owner <> '' AND lower(confidence) = 'high' THEN 'task' ELSE 'minor' END AS kind{status},
  row_number() OVER (PARTITION BY meeting_id, {SRC.format('task')} ORDER BY idx, part_no, supp_no, qty) AS rn FROM {src} WHERE trim(task) <> '') z WHERE rn = 1"""


SYNC = f"""
WITH o AS ({first_fields('{fx_old_actions}', ', status')}), n AS ({first_fields('{fx_new_actions}', '')}),
t AS (SELECT DISTINCT meeting_id FROM {{fx_new_actions}}),
j AS (SELECT coalesce(o.meeting_id, n.meeting_id) AS meeting_id, coalesce(o.src_key, n.src_key) AS src_key, o.status AS os, o.src_key AS ok, n.src_key AS nk,
        o.idx AS oi, n.idx AS ni, o.text AS ot, n.text AS nt, o.owner AS oo, n.owner AS no, o.confidence AS oc, n.confidence AS nc, o.kind AS okind, n.kind AS nkind
      FROM o FULL JOIN n ON o.meeting_id = n.meeting_id AND o.src_key = n.src_key),
r AS (SELECT *, CASE WHEN ok IS NULL THEN 'inserted' WHEN nk IS NOT NULL AND os = 'proposed' THEN 'updated'
        WHEN nk IS NULL AND os = 'proposed' AND meeting_id IN (SELECT meeting_id FROM t) THEN 'deleted' ELSE 'kept' END AS outcome FROM j)
SELECT meeting_id, src_key, coalesce(os, 'proposed') AS status, outcome, CASE WHEN outcome = 'kept' THEN oi ELSE ni END AS idx,
       CASE WHEN outcome = 'kept' THEN ot ELSE nt END AS text, CASE WHEN outcome = 'kept' THEN oo ELSE no END AS owner,
       CASE WHEN outcome = 'kept' THEN oc ELSE nc END AS confidence, CASE WHEN outcome = 'kept' THEN okind ELSE nkind END AS kind
FROM r WHERE outcome <> 'deleted'"""


def review_fields(actions):
    fields = state.action_fields(actions.withColumn("tie", F.struct("part_no", "supp_no", "qty")))
    # only these columns travel
    return state.keep_first(fields.select("meeting_id", "src_key", "idx", "text", "owner", "confidence", "kind",
                                          *[c for c in ("status", "tie") if c in fields.columns]))


@query("sync_proposals", SYNC)
def sync_proposals(x):
    return state.sync_proposals(review_fields(x["fx_old_actions"]), review_fields(x["fx_new_actions"]),
                                x["fx_new_actions"].select("meeting_id"))


# Two assignments of a label; the later one counts.
VIEWS["fx_assignments"] = """
SELECT o_orderkey AS meeting_id, concat('SPEAKER_0', CAST(o_custkey % 4 AS STRING)) AS speaker_label,
       concat('Person ', CAST(o_custkey % 9 AS STRING)) AS person, CAST(1 AS BIGINT) AS seq FROM {orders}
UNION ALL
SELECT o_orderkey AS meeting_id, concat('SPEAKER_0', CAST(o_custkey % 4 AS STRING)) AS speaker_label,
       concat('Renamed ', CAST(o_custkey % 5 AS STRING)) AS person, CAST(2 AS BIGINT) AS seq FROM {orders} WHERE o_custkey % 2 = 0"""


@query("assign_speakers", """
WITH m AS (SELECT meeting_id, speaker_label, last(person ORDER BY seq) AS person FROM {fx_assignments} GROUP BY 1, 2)
SELECT p.id, p.status, CASE WHEN m.person IS NOT NULL AND p.status IN ('proposed', 'accepted') THEN m.person ELSE p.owner END AS owner,
       p.seq % 3 = 0 OR (m.person IS NOT NULL AND p.status IN ('proposed', 'accepted')) AS owner_matched
FROM {fx_proposals} p LEFT JOIN m ON m.meeting_id = p.meeting_id AND m.speaker_label = p.owner""")
def assign_speakers(x):
    before = x["fx_proposals"].withColumn("owner_matched", F.col("seq") % 3 == 0)
    return state.assign_speakers(before, x["fx_assignments"], "seq").select("id", "status", "owner", "owner_matched")


@query("rename_attendees", """
SELECT DISTINCT t.meeting_id, coalesce(person, speaker) AS attendee FROM {fx_turns} t
LEFT JOIN {fx_speaker_map} m ON m.meeting_id = t.meeting_id AND m.speaker_label = t.speaker""")
def rename_attendees(x):
    return state.rename_attendees(transcript.attendees(x["fx_turns"]), x["fx_speaker_map"])


VIEWS["fx_patches"] = """
SELECT id, CAST(1 AS BIGINT) AS patch_no,
       CASE seq % 6 WHEN 0 THEN '{"status": "accepted", "due": "2001-03-04", "secret": "x"}' WHEN 1 THEN '{"status": "lost", "criterion": "seen"}'
            WHEN 2 THEN '{"due": "04.03.2001", "owner": "nobody"}' WHEN 3 THEN '{"owner": null, "kind": "task"}'
            WHEN 4 THEN '{"due": " ", "text": "new text"}' ELSE '{}' END AS patch FROM {fx_proposals}
UNION ALL
SELECT id, CAST(2 AS BIGINT) AS patch_no, concat('{"owner": "late ', CAST(seq % 3 AS STRING), '"}') AS patch FROM {fx_proposals} WHERE status = 'accepted'"""


def patched(c: str, test: str = "true", value: str | None = None) -> str:
    v = value or f"patch->>'{c}'"
    return f"arg_max(struct_pack(v := {v}), patch_no) FILTER (WHERE json_exists(patch, '$.{c}') AND {test}) AS {c}"


@query("apply_patches", f"""
WITH g AS (SELECT id, patch_no, CAST(patch AS JSON) AS patch FROM {{fx_patches}}
           WHERE trim(coalesce(patch->>'due', '')) = '' OR regexp_full_match(trim(patch->>'due'), '20\\d{{2}}-\\d{{2}}-\\d{{2}}')),
e AS (SELECT id, {patched('status', "patch->>'status' IN ('proposed', 'accepted', 'rejected', 'sent')")}, {patched('due', value="nullif(trim(patch->>'due'), '')")},
        {patched('owner')}, {patched('kind')}, {patched('criterion')}, {patched('text')} FROM g GROUP BY id)
SELECT p.id, CASE WHEN e.status IS NOT NULL THEN e.status.v ELSE p.status END AS status, CASE WHEN e.due IS NOT NULL THEN CAST(e.due.v AS DATE) ELSE p.due END AS due,
       CASE WHEN e.owner IS NOT NULL THEN e.owner.v ELSE p.owner END AS owner, CASE WHEN e.kind IS NOT NULL THEN e.kind.v ELSE p.kind END AS kind,
       CASE WHEN e.criterion IS NOT NULL THEN e.criterion.v ELSE p.criterion END AS criterion, CASE WHEN e.text IS NOT NULL THEN e.text.v ELSE p.text END AS text
FROM {{fx_proposals}} p LEFT JOIN e ON e.id = p.id""")
def apply_patches(x):
    return state.apply_patches(x["fx_proposals"], x["fx_patches"]).select("id", "status", "due", "owner", "kind", "criterion", "text")


GATE = """
SELECT q.meeting_id, q.id, text, owner, due, CASE WHEN p.status IS NULL THEN 'не найдено' WHEN p.status = 'sent' THEN 'уже отправлено'
  WHEN p.kind <> 'task' THEN 'мелочь — сначала «В приёмку»' WHEN trim(coalesce(p.criterion, '')) = '' THEN 'нет критерия готовности'
  WHEN p.due IS NULL THEN 'нет срока' END AS skip_reason
FROM (SELECT id, CASE WHEN seq % 23 = 0 THEN meeting_id + 1 ELSE meeting_id END AS meeting_id FROM {fx_proposals}) q
LEFT JOIN {fx_proposals} p ON p.id = q.id AND p.meeting_id = q.meeting_id"""


def gated(x):
    asked = x["fx_proposals"].select("id", F.when(F.col("seq") % 23 == 0, F.col("meeting_id") + 1).otherwise(F.col("meeting_id")).alias("meeting_id"))
    return state.dispatch_gate(x["fx_proposals"], asked)


@query("dispatch_gate", f"SELECT meeting_id, id, skip_reason FROM ({GATE}) g")
def dispatch_gate(x):
    return gated(x).select("meeting_id", "id", "skip_reason")


@query("dispatch_journal", f"""
SELECT proposal_id, meeting_id, text, owner, due_v1 FROM {{fx_journal}}
UNION ALL
SELECT id, meeting_id, text, coalesce(owner, ''), due FROM ({GATE}) g WHERE skip_reason IS NULL AND id NOT IN (SELECT proposal_id FROM {{fx_journal}})""")
def dispatch_journal(x):
    cols = ["proposal_id", "meeting_id", "text", "owner", "due_v1"]
    ready = gated(x).filter("skip_reason IS NULL").select(
        F.col("id").alias("proposal_id"), "meeting_id", "text", F.coalesce("owner", F.lit("")).alias("owner"), F.col("due").alias("due_v1"))
    spark, landing, checkpoint = x.spark, scratch_path(x.spark, "sent"), scratch_path(x.spark, "journal-checkpoint")
    journal = dispatch.journal_sink(spark, scratch_path(spark, "journal"))
    # the entries so far, then the ready ones twice over and messages about entries that are there
    earlier = x["fx_journal"].select(*cols)
    again = earlier.withColumn("text", F.lit("sent again"))
    for wave in (earlier, ready.unionByName(ready).unionByName(again), ready):
        wave.write.mode("append").parquet(landing)
        dispatch.append_journal(file_stream(spark, landing, dispatch.JOURNAL, "parquet"), journal, checkpoint)
    return journal.read()


@query("due_v1_audit", """
WITH h AS (SELECT proposal_id, 1 AS version, due_v1 FROM {fx_journal} UNION ALL
           SELECT proposal_id, 2, CASE WHEN seq % 29 = 0 THEN due_v1 + 1 ELSE due_v1 END FROM {fx_journal})
SELECT proposal_id, count(*) AS n_versions, arg_min(due_v1, version) AS due_v1, count(DISTINCT due_v1) > 1 AS violated FROM h GROUP BY proposal_id""")
def due_v1_audit(x):
    again = F.when(F.col("seq") % 29 == 0, F.date_add("due_v1", 1)).otherwise(F.col("due_v1"))
    first = x["fx_journal"].select("proposal_id", F.lit(1).alias("version"), "due_v1")
    return state.due_v1_audit(first.unionByName(x["fx_journal"].select("proposal_id", F.lit(2).alias("version"), again.alias("due_v1"))))


@query("card_text", """
SELECT p.id, concat_ws(chr(10) || chr(10), concat('Ответственный: ', coalesce(nullif(owner, ''), '—')),
  CASE WHEN criterion <> '' THEN concat('Критерий готовности: ', criterion) END,
  concat('Из планёрки: ', rtrim(concat(coalesce(nullif(m.title, ''), m.stem, ''), ' · ', coalesce(CAST(m.date AS VARCHAR), '')), ' ·'),
         CASE WHEN t_sec IS NOT NULL THEN printf(' · таймкод %d:%02d', t_sec // 60, t_sec % 60) ELSE '' END),
  CASE WHEN quote <> '' THEN concat('Цитата: «', quote, '»') END, '— создано транскрайбером, статусы ведём в Trello') AS description
FROM {fx_proposals} p LEFT JOIN (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE title END AS title, stem, date FROM {fx_meetings} WHERE id % 50 <> 7) m
  ON m.id = p.meeting_id""")
def card_text(x):
    some = x["fx_meetings"].where("id % 50 <> 7").withColumn("title", F.expr("CASE WHEN id % 10 = 0 THEN NULL ELSE title END"))
    return state.card_text(x["fx_proposals"], some)


# --- dates -------------------------------------------------------------------

NAME_DATES = " , ".join("list_transform(range(1, len(regexp_extract_all(name, '{0}', 2)) + 1), lambda i: TRY_CAST(concat(regexp_extract_all(name, '{0}', {1})[i], '-', lpad(regexp_extract_all(name, '{0}', {2})[i], 2, '0'), '-', lpad(regexp_extract_all(name, '{0}', {3})[i], 2, '0')) AS DATE))".format(*a) for a in [
    ("(^|\\D)(20\\d{2})[-_.](\\d{1,2})[-_.](\\d{1,2})(?:\\D|$)", 2, 3, 4),
    ("(^|\\D)(\\d{1,2})[-_.](\\d{1,2})[-_.](20\\d{2})(?:\\D|$)", 4, 3, 2),
    ("(^|\\D)(20\\d{2})(\\d{2})(\\d{2})(?:\\D|$)", 2, 3, 4)])
E_DAY = f"DATE '{EVENTS_AS_OF}'"


@query("dates_from_names", f"""
WITH d AS (SELECT *, list_filter(list_concat({NAME_DATES}), lambda d: d IS NOT NULL AND year(d) >= 2020 AND d <= {E_DAY} + 2)[1] AS from_name,
                  CASE WHEN regexp_full_match(explicit, '20\\d{{2}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(explicit AS DATE) <= {E_DAY} + 2 THEN TRY_CAST(explicit AS DATE) END AS ex FROM {{fx_names}})
SELECT id, from_name, coalesce(ex, stored, from_name, CAST(mtime AS DATE)) AS date,
       CASE WHEN ex IS NOT NULL THEN 'explicit' WHEN stored IS NOT NULL THEN 'meta' WHEN from_name IS NOT NULL THEN 'filename' ELSE 'mtime' END AS date_source
FROM d""")
def dates_from_names(x):
    day = F.to_date(F.lit(EVENTS_AS_OF))
    r = times.resolve_date(F.col("explicit"), F.col("stored"), F.lit(None).cast("string"), F.col("name"), F.col("mtime"), day)
    return x["fx_names"].select("id", times.date_from_name(F.col("name"), day).alias("from_name"), r.alias("r")).select(
        "id", "from_name", F.col("r.date").alias("date"), F.col("r.source").alias("date_source"))


HINTS = ["Завтра", "на этой неделе", "к понедельнику: в понедельник", "до конца месяца", "потом"]


@query("due_presets", f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {HINTS!r}[1 + o_orderkey % 5] AS hint FROM orders),
p AS (SELECT *, day + 1 AS tomorrow, day + CASE WHEN (5 - dayofweek(day) + 7) % 7 = 0 THEN 7 ELSE CAST((5 - dayofweek(day) + 7) % 7 AS INT) END AS week, last_day(day) AS month FROM d)
SELECT o_orderkey, tomorrow, week, month, CASE o_orderkey % 5 WHEN 0 THEN tomorrow WHEN 1 THEN week WHEN 2 THEN week WHEN 3 THEN month END AS hinted FROM p""")
def due_presets(x):
    day, hint = F.to_date("o_orderdate"), F.get(F.array(*[F.lit(h) for h in HINTS]), (F.col("o_orderkey") % 5).cast("int"))
    return x["orders"].select("o_orderkey", F.date_add(day, 1).alias("tomorrow"), times.next_friday(day).alias("week"),
                              F.last_day(day).alias("month"), times.due_from_hint(hint, day).alias("hinted"))


@query("next_occurrence", """
WITH s AS (SELECT event_id, ts AS now, CASE WHEN event_id % 9 = 0 THEN [] ELSE [CAST(user_id % 7 AS INT), CAST(event_id % 7 AS INT)] END AS days,
             CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '10:30' ELSE '18:05' END AS clock,
             CASE event_id % 3 WHEN 0 THEN 9999 WHEN 1 THEN 630 ELSE 1085 END AS minute_of FROM events),
a AS (SELECT event_id, any_value(clock) AS clock, any_value(now) AS now, min(k) FILTER (WHERE list_contains(days, CAST((isodow(now) - 1 + k) % 7 AS INT))
        AND NOT (k = 0 AND hour(now) * 60 + minute(now) > minute_of)) AS days_ahead
      FROM s, range(8) r(k) GROUP BY event_id)
SELECT event_id, days_ahead, CASE WHEN days_ahead IS NOT NULL THEN concat(CASE days_ahead WHEN 0 THEN 'сегодня' WHEN 1 THEN 'завтра'
   ELSE ['Пн', 'Вт', 'Ср', 'Чт', 'Пт', 'Сб', 'Вс'][1 + (isodow(now) - 1 + days_ahead) % 7] END, CASE WHEN clock <> '' THEN concat(' в ', clock) ELSE '' END) END AS label
FROM a""")
def next_occurrence(x):
    days = F.when(F.col("event_id") % 9 == 0, F.array().cast("array<int>")).otherwise(
        F.array((F.col("user_id") % 7).cast("int"), (F.col("event_id") % 7).cast("int")))
    at = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "10:30").otherwise("18:05")
    rows = x["events"].select("event_id", "ts", days.alias("days"), at.alias("at"))
    add = times.next_occurrence(F.col("days"), F.col("at"), F.col("ts"))
    return rows.withColumn("days_ahead", add).select(
        "event_id", F.col("days_ahead").cast("long").alias("days_ahead"), times.occurrence_label(F.col("days_ahead"), F.col("at"), F.col("ts")).alias("label"))


# --- files -------------------------------------------------------------------

NAME = "string_split(path, '/')[-1]"
EXT = f"lower(regexp_extract({NAME}, '[^/.](\\.[^./]+)$', 1))"
KIND = f"CASE WHEN {EXT} IN ('.mp3', '.wav', '.m4a', '.ogg', '.mp4', '.mkv', '.flac', '.aac', '.webm') THEN 'audio' WHEN {EXT} = '.json' THEN 'transcript_json' WHEN {EXT} = '.txt' THEN 'transcript_txt' END"
STEM_SQL = f"regexp_replace({NAME}, '([^/.])\\.[^./]+$', '\\1')"


@query("classify_source", f"SELECT id, path, {KIND} AS kind FROM {{fx_paths}}")
def classify_source(x):
    return archive.route_files(x["fx_paths"]).select("id", "path", "kind")


@query("meeting_stem", f"""
SELECT id, coalesce(nullif(CASE WHEN {EXT} = '.txt' THEN regexp_replace({STEM_SQL}, '(_anonymized_speakers|_speakers)$', '') ELSE {STEM_SQL} END, ''), 'transcript') AS stem
FROM {{fx_paths}}""")
def stems(x):
    return archive.route_files(x["fx_paths"]).select("id", "stem")


def place_sql(i: int, default: str) -> str:
    raw = f"nullif(CASE WHEN len(string_split(path, '/')) > {i} THEN trim(string_split(path, '/')[{i}]) END, '')"
    return f"CASE WHEN {raw} IS NULL OR length({raw}) > 80 OR {raw} IN ('.', '..') OR regexp_matches({raw}, '[<>:\"/\\\\|?*\\x00-\\x1f]') THEN '{default}' ELSE {raw} END"


@query("route_category", f"SELECT id, {place_sql(1, 'Общее')} AS category, {place_sql(2, 'Без подкатегории')} AS subcategory FROM {{fx_paths}}")
def route_category(x):
    return archive.route_files(x["fx_paths"]).select("id", "category", "subcategory")


@query("keyword_category", f"""
SELECT id, CASE WHEN contains(lower({NAME}), 'logistics') THEN 'Логистика' WHEN contains(lower({NAME}), 'marketing') THEN 'Маркетинг'
  WHEN contains(lower({NAME}), 'finance') THEN 'Финансы' ELSE 'Общее' END AS keyword_category FROM {{fx_paths}}""")
def by_keyword(x):
    return archive.route_files(x["fx_paths"]).select("id", "keyword_category")


@query("slugify_names", """
WITH s AS (SELECT doc_id, regexp_replace(trim(trim(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '-', 'g')), '.'), '\\s+', ' ', 'g') AS n FROM documents)
SELECT doc_id, coalesce(nullif(CASE WHEN length(n) > 80 THEN rtrim(substring(n, 1, 80)) ELSE n END, ''), 'meeting') AS slug FROM s""")
def slugify_names(x):
    return x["documents"].select("doc_id", slugify(F.col("text")).alias("slug"))


@query("watch_filter", f"""
SELECT id, path FROM {{fx_paths}} WHERE NOT starts_with({NAME}, '.') AND {KIND} IS NOT NULL
  AND NOT regexp_matches(lower({NAME}), '\\.(tmp|part|crdownload|download|partial)$')""")
def watch_filter(x):
    return archive.route_files(x["fx_paths"]).filter("is_watched").select("id", "path")


VIEWS["fx_files"] = """
SELECT concat(top, '/', stem, '_meta.json') AS path, mtime FROM {fx_runs} WHERE status <> 'P'
UNION ALL SELECT concat(top, '/', stem, '_summary.md') AS path, mtime FROM {fx_runs} WHERE status = 'F'
UNION ALL SELECT concat(top, '/', stem, '_audio.mp3') AS path, mtime FROM {fx_runs}
UNION ALL SELECT concat(top, '/', stem, '_speakers.txt') AS path, mtime FROM {fx_runs} WHERE status = 'O'
UNION ALL SELECT concat(top, '/intermediate/', stem, '_chunk_01.json') AS path, mtime FROM {fx_runs}"""
VIEWS["fx_runs"] = """
SELECT CASE o_orderkey % 9 WHEN 0 THEN '_obsidian' WHEN 1 THEN 'backups/x' WHEN 2 THEN 'Sales'
            ELSE concat(o_orderpriority, '/room ', CAST(o_custkey % 3 AS STRING)) END AS top,
       concat('rec ', CAST(o_orderkey AS STRING)) AS stem, o_orderstatus AS status, o_orderdate AS mtime FROM {orders}"""
LIVE = "top NOT IN ('_obsidian', 'backups/x')"


@query("archive_list", f"""
SELECT top AS dir, stem, split_part(top, '/', 1) AS category, split_part(top, '/', 2) AS subcategory, mtime AS summary_mtime
FROM {{fx_runs}} WHERE status = 'F' AND {LIVE}""")
def archive_list(x):
    return archive.archive_list(x["fx_files"])


@query("interrupted_runs", f"""
SELECT top AS dir, stem, concat(top, '/', stem, '_audio.mp3') AS path FROM {{fx_runs}}
WHERE status = 'P' AND {LIVE} AND stem NOT IN (SELECT concat('rec ', event_id) FROM events WHERE event_type = 'view')""")
def interrupted_runs(x):
    inbox = x["events"].filter("event_type = 'view'").select(F.concat(F.lit("Sales/rec "), F.col("event_id").cast("string"), F.lit(".mp3")).alias("path"))
    return archive.interrupted_runs(x["fx_files"], inbox)


@query("meeting_files", """
WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, string_split(path, '/')[-1] AS name FROM {fx_files} WHERE NOT contains(path, '/intermediate/'))
SELECT r.top AS dir, r.stem, f.name, f.name IN (concat(r.stem, '_summary.md'), concat(r.stem, '_speakers.txt'), concat(r.stem, '_anonymized_speakers.txt')) AS is_primary
FROM {fx_runs} r JOIN f ON f.dir = r.top AND starts_with(f.name, r.stem)""")
def meeting_files(x):
    return archive.meeting_files(x["fx_files"], x["fx_runs"].select(F.col("top").alias("dir"), "stem"))


VIEWS["fx_sidecars"] = """
SELECT doc_id AS meeting_id, 'actions' AS kind, CASE n_chars % 4 WHEN 0 THEN '[{"task": "a"}, {"task": "b"}]' WHEN 1 THEN '[{"task": ' WHEN 2 THEN '[]'
   ELSE concat('["', lang, '", {"task": "c"}, null]') END AS body FROM {documents}
UNION ALL
SELECT doc_id AS meeting_id, 'decisions' AS kind, CASE WHEN n_chars % 3 = 0 THEN '["x"]' ELSE 'oops' END AS body FROM {documents} WHERE lang <> 'de'"""


@query("sidecar_counts", """
SELECT d.doc_id AS meeting_id, coalesce(max(CASE WHEN kind = 'actions' AND json_valid(body) THEN json_array_length(body) END), 0)::BIGINT AS n_actions,
       coalesce(max(CASE WHEN kind = 'decisions' AND json_valid(body) THEN json_array_length(body) END), 0)::BIGINT AS n_decisions
FROM documents d LEFT JOIN {fx_sidecars} s ON s.meeting_id = d.doc_id GROUP BY d.doc_id""")
def sidecar_counts(x):
    return archive.sidecar_counts(x["documents"].select(F.col("doc_id").alias("meeting_id")), x["fx_sidecars"])


