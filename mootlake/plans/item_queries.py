"""Extracted items: decoding, merging, near duplicates, ranking, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_title, strip_leading_front_matter
from ..operators import dedup, items, pii
from ..session import small_side, stage_table
from .fixtures import VIEWS
from .registry import query

CLEAN = "regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
DECODED = f"""
SELECT meeting_id, chunk_id, raw, NOT json_valid(body) AS parse_error, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j
FROM (SELECT meeting_id, chunk_id, raw,
             CASE WHEN regexp_matches({CLEAN}, '```(?:json)?\\s*([\\s\\S]+?)\\s*```')
                  THEN regexp_extract({CLEAN}, '```(?:json)?\\s*([\\s\\S]+?)\\s*```', 1) ELSE {CLEAN} END AS body
      FROM {{fx_responses}}) c"""


def exploded(kind: str, key: str | None) -> str:
    text = f"it->>'{key}'" if key else "it->>'$'"
    more = ", ".join(f"it->>'{c}' AS {c}" if key else f"NULL AS {c}" for c in ("owner", "deadline", "confidence", "evidence"))
    speak = "it->'speakers'" if key else "NULL"
    return f"""SELECT meeting_id, chunk_id, '{kind}' AS kind, n - 1 AS item_no, {text} AS key_text, {more}, {speak} AS speakers
FROM (SELECT meeting_id, chunk_id, unnest(from_json(j->'{kind}', '["JSON"]')) AS it,
             generate_subscripts(from_json(j->'{kind}', '["JSON"]'), 1) AS n FROM d WHERE j IS NOT NULL) x"""


MERGED = "\nUNION ALL ".join([exploded("decisions", "decision"), exploded("action_items", "task"), exploded("mentioned_topics", None)])
WITH_D = f"WITH d AS ({DECODED}), i AS ({MERGED})"
NORM = "regexp_replace(regexp_replace(lower(coalesce({0}, 'none')), '[^\\pL\\pN_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def greedy_sql(src: str, group: str, order: str, text: str) -> str:
    """First-wins near-duplicate rule, one item per step: CTEs ending in ``gk(g, ord)``."""
    words = f"list_sort(list_distinct(list_filter(string_split_regex({NORM.format(text)}, '\\s+'), lambda w: w <> '')))"
    return f"""
gw AS (SELECT {group} AS g, {order} AS ord, {words} AS ws, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {src}),
gs AS (SELECT b.g, b.ord AS b, list(a.ord) AS before FROM gw a JOIN gw b ON a.g = b.g AND a.ord < b.ord
       WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) >= 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9
       GROUP BY b.g, b.ord),
gi AS (SELECT gw.g, gw.ord, gw.rn, coalesce(gs.before, []) AS before FROM gw LEFT JOIN gs ON gs.g = gw.g AND gs.b = gw.ord),
gr AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM gw
       UNION ALL SELECT gr.g, gi.rn, CASE WHEN list_has_any(gr.kept, gi.before) THEN gr.kept ELSE list_append(gr.kept, gi.ord) END
       FROM gr JOIN gi ON gi.g = gr.g AND gi.rn = gr.rn + 1),
gk AS (SELECT g, unnest(kept) AS ord FROM (SELECT g, arg_max(kept, rn) AS kept FROM gr GROUP BY g) z)"""


@query("extraction_decode", f"""
WITH d AS ({DECODED})
SELECT meeting_id, chunk_id, parse_error, CASE WHEN parse_error THEN substring(raw, 1, 500) ELSE j->>'summary' END AS summary,
       j->>'meeting_type' AS meeting_type, j->'time_range'->>'start' AS time_start,
       coalesce(json_array_length(j->'decisions'), 0)::BIGINT AS n_decisions, coalesce(json_array_length(j->'action_items'), 0)::BIGINT AS n_actions,
       coalesce(json_array_length(j->'mentioned_topics'), 0)::BIGINT AS n_topics
FROM d""")
def extraction_decode(x):
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return items.decode_extractions(x["fx_responses"]).select(
        "meeting_id", "chunk_id", "parse_error", "summary", "meeting_type", F.col("time_range.start").alias("time_start"),
        n("decisions").alias("n_decisions"), n("action_items").alias("n_actions"), n("mentioned_topics").alias("n_topics"))


def merged(x):
    return items.merge_chunks(items.decode_extractions(x["fx_responses"]))


@query("merge_chunks", f"{WITH_D} SELECT meeting_id, chunk_id, kind, item_no, key_text, owner, deadline, confidence, evidence FROM i")
def merge_chunks(x):
    return merged(x).select("meeting_id", "chunk_id", "kind", "item_no", "key_text", "owner", "deadline", "confidence", "evidence")


@query("merged_fields", f"""
WITH d AS ({DECODED}), k AS (SELECT meeting_id, chunk_id, unnest(['decisions', 'action_items']) AS kind, j FROM d WHERE j IS NOT NULL),
i AS (SELECT meeting_id, chunk_id, kind, unnest(from_json(j->kind, '["JSON"]')) AS it, generate_subscripts(from_json(j->kind, '["JSON"]'), 1) - 1 AS item_no FROM k)
SELECT meeting_id, chunk_id, kind, item_no, field, it->>concat('$.', field) AS value FROM (SELECT *, unnest(json_keys(it)) AS field FROM i) f""")
def merged_fields(x):
    """Every field of every item, absent ones left out and explicit nulls kept."""
    return merged(x).filter("fields IS NOT NULL").select("meeting_id", "chunk_id", "kind", "item_no", F.explode("fields").alias("field", "value"))


VIEWS["fx_null_answers"] = """
SELECT source AS meeting_id, doc_id AS chunk_id, concat('{"decisions": [{"decision": ', CASE n_chars % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN '"None!"'
  ELSE concat('"', lang, ' said so"') END, ', "confidence": "high"}, {"confidence": "low"}, {"decision": "', lang, ' and ', source, '"}]}') AS raw FROM {documents}"""


@query("dedup_null_keys", f"""
WITH d AS (SELECT meeting_id, chunk_id, CAST(raw AS JSON)->'decisions' AS j FROM {{fx_null_answers}}),
i AS (SELECT meeting_id, chunk_id, unnest(from_json(j, '["JSON"]')) AS it, generate_subscripts(from_json(j, '["JSON"]'), 1) - 1 AS item_no FROM d),
n AS (SELECT coalesce(meeting_id, '') AS meeting_id, chunk_id, item_no, chunk_id * 10 + item_no AS ord, it->>'decision' AS key_text,
        CASE WHEN NOT list_contains(json_keys(it), 'decision') THEN '' ELSE coalesce(it->>'decision', 'None') END AS t FROM i),
{greedy_sql('n', 'meeting_id', 'ord', 't')}
SELECT meeting_id, chunk_id, item_no, key_text FROM n JOIN gk ON gk.g = n.meeting_id AND gk.ord = n.ord""", recursive=True)
def dedup_null_keys(x):
    """Decisions without a text, with an empty one and with an explicit null, which repeats the word."""
    answers = x["fx_null_answers"].withColumn("meeting_id", F.coalesce("meeting_id", F.lit("")))
    found = items.deduplicate(items.merge_chunks(items.decode_extractions(answers)))
    return found.select("meeting_id", "chunk_id", "item_no", "key_text")


@query("artefact_actions", f"""{WITH_D}
SELECT meeting_id, chunk_id, item_no, key_text AS task, owner, deadline, confidence, evidence, 'open' AS status, 'model-a' AS extractor
FROM i WHERE kind = 'action_items'""")
def artefact_actions(x):
    return items.artefact_actions(merged(x), "model-a")


@query("meeting_type_vote", f"""
WITH d AS ({DECODED}), v AS (SELECT meeting_id, lower(trim(j->>'meeting_type')) AS vote, chunk_id FROM d WHERE j->>'meeting_type' <> ''),
c AS (SELECT meeting_id, vote, count(*) AS n, min(chunk_id) AS first FROM v GROUP BY 1, 2)
SELECT m.meeting_id, vote AS meeting_type, CASE vote WHEN 'audit' THEN 'Аудит / разбор' WHEN 'retro' THEN 'Ретро' WHEN 'planning' THEN 'Планёрка'
       ELSE 'Рабочая встреча' END AS label
FROM (SELECT DISTINCT meeting_id FROM {{fx_responses}}) m LEFT JOIN
     (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, first) AS rn FROM c) r ON r.meeting_id = m.meeting_id AND rn = 1""")
def meeting_type_vote(x):
    return items.meeting_type_vote(items.decode_extractions(x["fx_responses"]))


@query("meeting_span", f"""
WITH d AS ({DECODED})
SELECT meeting_id, first(s ORDER BY chunk_id) AS time_start, last(e ORDER BY chunk_id) AS time_end
FROM (SELECT meeting_id, chunk_id, j->'time_range'->>'start' AS s, j->'time_range'->>'end' AS e FROM d
      WHERE parse_error OR j->>'summary' <> '') t GROUP BY meeting_id""")
def meeting_span(x):
    return items.meeting_span(items.decode_extractions(x["fx_responses"]))


@query("participants", f"""{WITH_D}
SELECT DISTINCT meeting_id, trim(name) AS participant FROM (
  SELECT meeting_id, unnest(from_json(speakers, '["VARCHAR"]')) AS name FROM i WHERE kind = 'decisions'
  UNION ALL SELECT meeting_id, owner FROM i WHERE kind = 'action_items' AND lower(owner) NOT IN ('null', 'none')) n
WHERE name <> ''""")
def participants(x):
    return items.participants(merged(x))


@query("distinct_topics", f"""{WITH_D}
SELECT meeting_id, chunk_id, item_no, key_text AS topic FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, {NORM.format('key_text')} ORDER BY chunk_id, item_no) AS rn
  FROM i WHERE kind = 'mentioned_topics') r WHERE rn = 1""")
def distinct_topics(x):
    return items.distinct_topics(merged(x))


@query("meeting_context", f"""
WITH d AS ({DECODED}), p AS (SELECT meeting_id, chunk_id, trim(j->>'meeting_context') AS part FROM d WHERE trim(j->>'meeting_context') <> ''),
{greedy_sql('p', 'meeting_id', 'chunk_id', 'part')}
SELECT p.meeting_id, string_agg(part, ' ' ORDER BY chunk_id) AS meeting_context
FROM p JOIN gk ON gk.g = p.meeting_id AND gk.ord = p.chunk_id GROUP BY p.meeting_id""", recursive=True)
def meeting_context(x):
    return items.meeting_context(items.decode_extractions(x["fx_responses"]))


def told(x):
    """Items of the older fixture, where a NULL is an absent text."""
    return x["fx_items"].withColumn("told", F.coalesce("key_text", F.lit("")))


@query("dedup_items", f"""
WITH {greedy_sql('{fx_items}', 'meeting_id', 'item_no', 'key_text')}
SELECT meeting_id, item_no, key_text FROM {{fx_items}} f JOIN gk ON gk.g = f.meeting_id AND gk.ord = f.item_no""", recursive=True)
def dedup_items(x):
    return dedup.dedup_greedy(told(x), ["meeting_id"], "item_no", "told").select("meeting_id", "item_no", "key_text")


@query("near_dup_pairs", f"""
WITH {greedy_sql('{fx_items}', '1', 'item_no', 'key_text')}
SELECT item_no, kept, len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) AS similarity
FROM (SELECT gs.b AS item_no, min(gk.ord) AS kept FROM (SELECT g, b, unnest(before) AS a FROM gs) gs JOIN gk ON gk.ord = gs.a GROUP BY gs.b) p
JOIN gw a ON a.ord = p.item_no JOIN gw b ON b.ord = p.kept""", recursive=True)
def near_dup_pairs(x):
    """Across all meetings: no group column."""
    return dedup.near_dup_pairs(told(x), [], "item_no", "told")


FOLD = "list_reduce(list({0} ORDER BY ord) FILTER (WHERE {0} <> ''), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE trim(concat(a, ' | ', b), ' |') END)"


@query("merge_section_status", f"""
WITH s AS (SELECT *, {NORM.format('section')} AS section_key FROM {{fx_sections}})
SELECT meeting_id, section_key, min(ord) AS first_ord, arg_min(section, ord) AS section,
       first(status ORDER BY ord) FILTER (WHERE status <> '') AS status, first(priority ORDER BY ord) FILTER (WHERE priority <> '') AS priority,
       first(source_time ORDER BY ord) FILTER (WHERE source_time <> '') AS source_time,
       first(evidence ORDER BY ord) FILTER (WHERE evidence <> '') AS evidence,
       {FOLD.format('reasoning')} AS reasoning, {FOLD.format('notes')} AS notes
FROM s WHERE section_key <> '' GROUP BY meeting_id, section_key""")
def merge_section_status(x):
    return items.merge_section_status(x["fx_sections"])


@query("evidence_downgrade", """
SELECT meeting_id, item_no, kind, CASE WHEN kind IN ('action_items', 'decisions') AND coalesce(evidence, '') = '' AND coalesce(source_time, '') = ''
       AND confidence IN ('high', 'medium') THEN 'low' ELSE confidence END AS confidence FROM {fx_items}""")
def evidence_downgrade(x):
    return items.evidence_downgrade(x["fx_items"]).select("meeting_id", "item_no", "kind", "confidence")


@query("task_minor_split", """
SELECT meeting_id, item_no, CASE WHEN owner <> '' AND lower(confidence) = 'high' THEN 'task' ELSE 'minor' END AS kind FROM {fx_items}""")
def task_minor_split(x):
    return x["fx_items"].select("meeting_id", "item_no", items.task_or_minor(F.col("owner"), F.col("confidence")).alias("kind"))


@query("label_owners", """
SELECT id, owner, coalesce(regexp_matches(owner, '(?i)^(SPEAKER|PERSON|UNKNOWN)[_ ]?'), false) AS is_label FROM {fx_proposals}""")
def label_owners(x):
    return items.label_owners(x["fx_proposals"]).select("id", "owner", "is_label")


@query("orphan_stats", """
SELECT meeting_id, count(*) AS n_actions, count(*) FILTER (WHERE owner IS NULL OR lower(owner) IN ('null', 'none', '') OR deadline IS NULL
       OR lower(deadline) IN ('null', 'none', '')) AS n_orphaned,
       CAST(round_even(100.0 * count(*) FILTER (WHERE owner IS NULL OR lower(owner) IN ('null', 'none', '') OR deadline IS NULL
       OR lower(deadline) IN ('null', 'none', '')) / count(*), 0) AS BIGINT) AS orphan_pct
FROM {fx_items} WHERE kind = 'action_items' GROUP BY meeting_id""")
def orphan_stats(x):
    return items.orphan_stats(x["fx_items"].filter("kind = 'action_items'"))


LEVEL = "CASE {0} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY
  CASE kind WHEN 'decisions' THEN CASE WHEN quote <> '' THEN 0 ELSE 1 END WHEN 'risks' THEN CASE WHEN inferred THEN 1 ELSE 0 END
    WHEN 'blockers' THEN CASE WHEN inferred THEN 1 ELSE 0 END WHEN 'meta_observations' THEN {LEVEL.format('severity')}
    WHEN 'section_statuses' THEN {LEVEL.format('priority')} ELSE 0 END,
  CASE kind WHEN 'decisions' THEN CASE WHEN source_time <> '' THEN 0 ELSE 1 END WHEN 'risks' THEN {LEVEL.format('severity')} ELSE 0 END,
  CASE kind WHEN 'decisions' THEN {LEVEL.format('confidence')} ELSE 0 END, item_no) AS rank
FROM {{fx_items}} WHERE kind <> 'section_statuses' OR priority IN ('high', 'medium')"""
COMPACT_SQL = f"""
SELECT meeting_id, kind, item_no, key_text, CASE WHEN kind <> 'action_items' THEN rank END AS rank FROM ({RANKED}) r
WHERE rank <= CASE kind WHEN 'decisions' THEN 7 WHEN 'risks' THEN 7 WHEN 'blockers' THEN 5 WHEN 'open_questions' THEN 5
  WHEN 'meta_observations' THEN 3 WHEN 'section_statuses' THEN 10 WHEN 'sequence' THEN 8 WHEN 'action_items' THEN 1e18 ELSE 0 END"""


@query("trim_compact", COMPACT_SQL)
def trim_compact(x):
    return items.trim_compact(x["fx_items"]).select("meeting_id", "kind", "item_no", "key_text", "rank")


CONCRETE = "(lower(trim(coalesce(owner, ''))) NOT IN ('null', 'none', '') OR lower(trim(coalesce(deadline, ''))) NOT IN ('null', 'none', ''))"


@query("trim_minimal", f"""
WITH r AS ({RANKED}), a AS (SELECT *, {CONCRETE} AS c FROM r WHERE kind = 'action_items'),
m AS (SELECT meeting_id, bool_or(c) AS any_c FROM a GROUP BY 1)
SELECT meeting_id, kind, item_no, key_text, rank FROM r
WHERE rank <= CASE kind WHEN 'decisions' THEN 3 WHEN 'risks' THEN 3 WHEN 'blockers' THEN 2 WHEN 'meta_observations' THEN 3 ELSE 0 END
UNION ALL
SELECT meeting_id, kind, item_no, key_text, NULL FROM a JOIN m USING (meeting_id)
WHERE CASE WHEN any_c THEN c ELSE rank <= 5 END""")
def trim_minimal(x):
    return items.trim_minimal(x["fx_items"]).select("meeting_id", "kind", "item_no", "key_text", "rank")


@query("summary_payload", f"""
WITH t AS ({COMPACT_SQL})
SELECT meeting_id, to_json(struct_pack({', '.join(f"{k} := coalesce(list(key_text ORDER BY coalesce(rank, 0), item_no) FILTER (WHERE kind = '{k}'), [])" for k in
  ['section_statuses', 'sequence', 'business_context', 'decisions', 'action_items', 'blockers', 'risks', 'open_questions',
   'meta_observations', 'important_facts', 'mentioned_topics'])})) AS payload
FROM t GROUP BY meeting_id""")
def summary_payload(x):
    return items.summary_payload(items.trim_compact(x["fx_items"]))


FACTS_SQL = f"""
v AS (SELECT meeting_id, vote AS type_key FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, first) AS rn FROM (
        SELECT meeting_id, lower(trim(j->>'meeting_type')) AS vote, count(*) AS n, min(chunk_id) AS first FROM d WHERE j->>'meeting_type' <> '' GROUP BY 1, 2) c) r WHERE rn = 1),
su AS (SELECT meeting_id, chunk_id, CASE WHEN parse_error THEN substring(raw, 1, 500) ELSE j->>'summary' END AS summary, j->'time_range'->>'start' AS s FROM d),
sp AS (SELECT meeting_id, arg_min(coalesce(s, ''), chunk_id) AS time_start, string_agg(summary, ' / ' ORDER BY chunk_id) AS summaries FROM su WHERE summary <> '' GROUP BY 1),
pa AS (SELECT meeting_id, string_agg(DISTINCT trim(name), ';' ORDER BY trim(name)) AS participants FROM (
  SELECT meeting_id, unnest(from_json(speakers, '["VARCHAR"]')) AS name FROM i WHERE kind = 'decisions'
  UNION ALL SELECT meeting_id, owner FROM i WHERE kind = 'action_items' AND lower(owner) NOT IN ('null', 'none')) n WHERE name <> '' GROUP BY 1),
ac AS (SELECT meeting_id, count(*) AS total, count(*) FILTER (WHERE owner IS NULL OR lower(owner) IN ('null', 'none', '') OR deadline IS NULL OR lower(deadline) IN ('null', 'none', '')) AS orphaned
       FROM i WHERE kind = 'action_items' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY CASE WHEN kind = 'decisions' THEN CASE confidence WHEN 'high' THEN 0 ELSE 1 END ELSE 0 END, chunk_id, item_no) AS rk,
        lower(trim(coalesce(owner, ''))) NOT IN ('null', 'none', '') OR lower(trim(coalesce(deadline, ''))) NOT IN ('null', 'none', '') AS concrete FROM i),
li AS (SELECT meeting_id, mode, string_agg(key_text, ' | ' ORDER BY rk) FILTER (WHERE kind = 'decisions' AND rk <= CASE mode WHEN 'full' THEN 1e9 WHEN 'compact' THEN 7 ELSE 3 END) AS decisions,
         string_agg(key_text, ' | ' ORDER BY rk) FILTER (WHERE kind = 'action_items' AND (mode <> 'minimal' OR concrete)) AS actions,
         count(*) FILTER (WHERE kind = 'mentioned_topics') AS n_topics
       FROM r, (SELECT unnest(['full', 'compact', 'minimal']) AS mode) m GROUP BY 1, 2),
z AS (SELECT DISTINCT meeting_id, mode FROM d, (SELECT unnest(['full', 'compact', 'minimal']) AS mode) m)"""


def payload_inputs(x):
    """Answers, items and facts, each made once."""
    decoded = stage_table(items.decode_extractions(x["fx_responses"]), "decoded", "zstd")
    rows = stage_table(items.merge_chunks(decoded), "items", "zstd")
    return decoded, rows, stage_table(items.meta_facts(decoded, rows), "facts")


def field_texts(key: str):
    return F.transform(items.section_list("map<string,string>"), lambda it: F.try_element_at(it, F.lit(key)))


def payload_lists():
    return {"decisions": ("decisions", field_texts("decision"), " | "), "actions": ("action_items", field_texts("task"), " | ")}


@query("final_payload", f"""{WITH_D}, {FACTS_SQL}
SELECT z.meeting_id, z.mode, coalesce(v.type_key, '') AS type_key, sp.time_start, coalesce(pa.participants, '') AS participants, coalesce(ac.total, 0) AS total,
       coalesce(ac.orphaned, 0) AS orphaned, coalesce(CAST(round_even(100.0 * orphaned / total, 0) AS BIGINT), 0) AS orphan_pct, coalesce(sp.summaries, '') AS summaries,
       coalesce(decisions, '') AS decisions, coalesce(actions, '') AS actions, coalesce(n_topics, 0) AS n_topics
FROM z LEFT JOIN li ON li.meeting_id = z.meeting_id AND li.mode = z.mode LEFT JOIN v ON v.meeting_id = z.meeting_id LEFT JOIN sp ON sp.meeting_id = z.meeting_id
LEFT JOIN pa ON pa.meeting_id = z.meeting_id LEFT JOIN ac ON ac.meeting_id = z.meeting_id""")
def final_payload(x):
    """The three lengths of the report's input, read back from their JSON."""
    decoded, rows, facts = payload_inputs(x)
    made = [items.final_payload(decoded, rows, facts, mode).withColumn("mode", F.lit(mode)) for mode in items.MODES]
    meta = ("meeting_type_key string, time_start string, participants array<string>, action_items_total bigint, "
            "action_items_orphaned bigint, orphan_pct bigint")
    whole = made[0].unionByName(made[1]).unionByName(made[2])
    of = lambda section, value: F.when(F.col("section") == section, value)
    told = items.joined_sections(
        whole, ["meeting_id", "mode"], {"summaries": ("chunk_summaries", items.section_list("string"), " / "), **payload_lists()},
        F.first(of("meta", F.from_json("text", meta)), ignorenulls=True).alias("m"),
        F.coalesce(F.sum(of("mentioned_topics", F.size(items.section_list("string")))), F.lit(0)).cast("long").alias("n_topics"))
    return told.select(
        "meeting_id", "mode", F.coalesce("m.meeting_type_key", F.lit("")).alias("type_key"), F.coalesce("m.time_start", F.lit("")).alias("time_start"),
        F.array_join("m.participants", ";").alias("participants"), F.col("m.action_items_total").alias("total"),
        F.col("m.action_items_orphaned").alias("orphaned"), F.col("m.orphan_pct").alias("orphan_pct"), "summaries", "decisions", "actions", "n_topics")


@query("restored_payload", f"""{WITH_D}, {FACTS_SQL}
SELECT z.meeting_id, z.mode, coalesce(decisions, '') AS decisions, coalesce(actions, '') AS actions
FROM z LEFT JOIN li ON li.meeting_id = z.meeting_id AND li.mode = z.mode WHERE z.mode = 'full'""")
def restored_payload(x):
    """Tokens deep inside a JSON text are restored like any others."""
    made = stage_table(items.final_payload(*payload_inputs(x), "full"), "payload", "zstd")
    words = made.select("meeting_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0)))).alias("value"))
    longest = words.groupBy("meeting_id").agg(F.max_by("value", F.struct(F.length("value"), "value")).alias("value"))
    kept = longest.filter("value NOT IN ('chunk_summaries', 'decision', 'decisions', 'speakers', 'confidence', 'evidence', 'orphaned')").withColumn("token", F.lit("PERSON_001"))
    kept = small_side(kept, "hidden")
    hidden = made.join(kept, "meeting_id", "left").withColumn("text", F.coalesce(F.replace("text", "value", "token"), "text"))
    key = ["meeting_id", "section", "part"]
    back = pii.restore(hidden.select(*key, "text"), key, kept)
    return items.joined_sections(back, ["meeting_id"], payload_lists()).select("meeting_id", F.lit("full").alias("mode"), "decisions", "actions")


@query("brief_extras", """
WITH a AS (SELECT doc_id AS meeting_id, CASE WHEN n_chars % 3 = 0 THEN concat('---', chr(10), 'title: x', chr(10), '---', chr(10), chr(10), text) ELSE text END AS md,
                  regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]+', 'x', 'g') AS w1, regexp_replace(split_part(text, ' ', 2), '[^A-Za-z]+', 'y', 'g') AS w2 FROM documents)
SELECT meeting_id, substring(CASE WHEN md LIKE '---%' THEN regexp_replace(md, '(?s)^---.*?\\n---\\s*', '') ELSE md END, 1, 6000) AS summary,
       concat_ws(' | ', w1, CASE WHEN w2 = '' THEN 't' ELSE w2 END, 'plain', w1, w2, w1) AS decisions, concat_ws(' | ', w1, nullif(w2, '')) AS open_questions, w2 AS risks, '' AS blockers FROM a""")
def brief_extras(x):
    w = lambda i, r: F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(i)), "[^A-Za-z]+", r)
    doc = lambda t: F.format_string(t, w(1, "x"), w(2, "y"))
    md = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("---\ntitle: x\n---\n\n"), "text")).otherwise(F.col("text"))
    return items.brief_extras(x["documents"].select(
        F.col("doc_id").alias("meeting_id"), md.alias("summary_md"),
        doc('[{"decision": "%1$s"}, {"text": "%2$s", "title": "t"}, "plain", {"decision": "", "title": "%1$s"}, {"other": "z"}, '
            '"%2$s", "%1$s", "seventh"]').alias("decisions"),
        doc('[{"question": "%1$s"}, {"text": "%2$s"}, {}]').alias("open_questions"),
        doc('[{"risk": null, "description": "%2$s"}]').alias("risks"), F.lit("not json").alias("blockers")))


@query("strip_frontmatter", """
WITH a AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN concat('---', chr(10), 'title: x', chr(10), '---', chr(10), text)
  WHEN 1 THEN concat('---', chr(10), 'open ', text) ELSE text END AS md FROM documents)
SELECT doc_id, CASE WHEN md LIKE '---' || chr(10) || 'title%' THEN regexp_replace(md, '(?s)^---\\s*\\n.*?\\n---\\s*\\n', '') ELSE md END AS body FROM a""")
def strip_frontmatter(x):
    md = (F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("---\ntitle: x\n---\n"), "text"))
          .when(F.col("n_chars") % 4 == 1, F.concat(F.lit("---\nopen "), "text")).otherwise(F.col("text")))
    return x["documents"].select("doc_id", strip_leading_front_matter(md).alias("body"))


@query("clean_titles", """
WITH a AS (SELECT doc_id, regexp_replace(split_part(CASE n_chars % 4 WHEN 0 THEN concat('"', text, '"') WHEN 1 THEN concat('<think>x', chr(10), '</think> ', text) WHEN 2 THEN '' ELSE text END, chr(10), 1), '^<think>x$', '') AS l, n_chars, text FROM documents),
b AS (SELECT doc_id, CASE WHEN n_chars % 4 = 1 THEN trim(split_part(text, chr(10), 1)) ELSE trim(l) END AS l FROM a),
c AS (SELECT doc_id, regexp_replace(trim(trim(l, '"'), ''''), '\\.+$', '') AS t FROM b)
SELECT doc_id, CASE WHEN t = '' THEN 'Совещание' WHEN length(t) > 120 THEN concat(rtrim(substring(t, 1, 120)), '…') ELSE t END AS title FROM c""")
def clean_titles(x):
    raw = (F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit('"'), "text", F.lit('"')))
           .when(F.col("n_chars") % 4 == 1, F.concat(F.lit("<think>x\n</think> "), "text"))
           .when(F.col("n_chars") % 4 == 2, F.lit("")).otherwise(F.col("text")))
    return x["documents"].select("doc_id", clean_title(raw).alias("title"))


@query("title_inputs", f"""{WITH_D},
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY chunk_id, item_no) AS rn FROM i),
s AS (SELECT source AS meeting_id, substring(arg_min(text, doc_id), 1, 1500) AS summary_preview FROM documents GROUP BY 1)
SELECT r.meeting_id, string_agg(key_text, ' | ' ORDER BY rn) FILTER (WHERE kind = 'mentioned_topics' AND rn <= 8) AS mentioned_topics,
       string_agg(key_text, ' | ' ORDER BY rn) FILTER (WHERE kind = 'decisions' AND rn <= 5) AS decisions,
       string_agg(key_text, ' | ' ORDER BY rn) FILTER (WHERE kind = 'action_items' AND rn <= 5) AS action_items, any_value(s.summary_preview) AS summary_preview
FROM r JOIN s ON s.meeting_id = r.meeting_id GROUP BY r.meeting_id""")
def title_inputs(x):
    first = x["documents"].groupBy(F.col("source").alias("meeting_id")).agg(F.min_by("text", "doc_id").alias("summary"))
    return items.title_inputs(merged(x), first)
