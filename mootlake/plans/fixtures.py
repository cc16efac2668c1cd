"""Meeting-shaped views over the given tables.

Each view is one SQL text that Spark and DuckDB both accept; ``{name}`` marks a
table or another view.  Spark binds the names to DataFrames (no catalog entry),
the SQL check chains them as common table expressions.  Every view reads whole
tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The day the analytics look back from, one per time line of the data.
AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"

VIEWS: dict[str, str] = {}

VIEWS["fx_meetings"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS category,
       CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('team ', CAST(o_custkey % 7 AS STRING)) END AS subcategory,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       CASE o_orderkey % 5 WHEN 0 THEN 'mtime' WHEN 1 THEN 'processing_day' ELSE 'filename' END AS date_source,
       concat('Meeting ', CAST(o_custkey AS STRING)) AS title,
       CAST(o_orderkey % 7 AS BIGINT) AS n_actions, CAST(o_orderkey % 3 AS BIGINT) AS n_decisions,
       concat('rec_', CAST(CAST(o_orderdate AS DATE) AS STRING), '_', CAST(o_orderkey AS STRING)) AS stem
FROM {orders}"""

VIEWS["fx_proposals"] = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING),
                 CAST(CAST(l_shipdate AS DATE) AS STRING)) AS id,
       l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS meeting_id, CAST(l_linenumber AS BIGINT) AS idx,
       CASE WHEN l_quantity > 20 THEN 'task' ELSE 'minor' END AS kind,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 5 = 0
            THEN concat('SPEAKER_0', CAST(l_suppkey % 4 AS STRING)) ELSE s_name END AS owner,
       CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'sent'
            ELSE CASE WHEN l_linestatus = 'O' THEN 'proposed' ELSE 'accepted' END END AS status,
       CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE p_brand END AS section, p_name AS text,
       CASE WHEN l_partkey % 4 = 0 THEN '' ELSE p_type END AS criterion,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS due,
       CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 7 ELSE NULL END AS t_sec,
       CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat(p_name, ' until ', p_type) END AS quote
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey"""

VIEWS["fx_journal"] = """
SELECT id AS proposal_id, seq, meeting_id, text, owner, due AS due_v1, t_sec,
       CASE WHEN seq % 19 = 0 THEN '' ELSE concat('c', id) END AS card_id
FROM {fx_proposals} WHERE status = 'sent' AND kind = 'task' AND due IS NOT NULL"""

VIEWS["fx_cards"] = """
SELECT card_id, text AS name, CAST(due_v1 + CAST(seq % 6 AS INT) AS DATE) AS due, seq % 4 = 0 AS due_complete,
       seq % 17 = 0 AS closed, concat('list', CAST(seq % 5 AS STRING)) AS list_id
FROM {fx_journal} WHERE card_id <> '' AND due_v1 > DATE '1996-01-01'"""

VIEWS["fx_lists"] = """
SELECT concat('list', CAST(r_regionkey AS STRING)) AS list_id,
       CASE r_regionkey WHEN 0 THEN 'To do' WHEN 1 THEN 'In work' WHEN 2 THEN ' DONE ' WHEN 3 THEN 'Almost done 2'
                        ELSE r_name END AS name
FROM {region}"""

# seg_no is the position inside the meeting; Spark numbers it block-wise.
VIEWS["fx_segments"] = """
SELECT user_id AS meeting_id, seg_no, CAST(seg_no * 7 AS DOUBLE) AS start_s,
       CAST(seg_no * 7 AS DOUBLE) + value AS end_s,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS speaker,
       CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat('w', CAST(event_id AS STRING)) END AS text
FROM {numbered_events}"""

VIEWS["numbered_events"] = """
SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seg_no
FROM {events}"""

VIEWS["fx_turns"] = """
SELECT conv_id AS meeting_id, turn AS turn_no, concat('SPEAKER_', role) AS speaker,
       turn * 60 AS start_sec, turn * 60 + 59 AS end_sec, text
FROM {conversations}"""

# Items for de-duplication: one group per source, original order = doc_id.
VIEWS["fx_items"] = """
SELECT source AS meeting_id, doc_id AS item_no, substring(text, 1, 80) AS key_text,
       CASE doc_id % 9 WHEN 0 THEN 'action_items' WHEN 1 THEN 'decisions' WHEN 2 THEN 'risks' WHEN 3 THEN 'blockers'
            WHEN 4 THEN 'open_questions' WHEN 5 THEN 'meta_observations' WHEN 6 THEN 'section_statuses'
            WHEN 7 THEN 'sequence' ELSE 'business_context' END AS kind,
       CASE WHEN n_chars % 3 = 0 THEN 'high' WHEN n_chars % 3 = 1 THEN 'medium'
            WHEN n_chars % 2 = 0 THEN 'low' ELSE NULL END AS confidence,
       CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars % 4 = 1 THEN ' None ' ELSE lang END AS owner,
       CASE WHEN n_chars % 5 = 0 THEN 'null' WHEN n_chars % 5 = 1 THEN NULL WHEN n_chars % 5 = 2 THEN ''
            ELSE '2024-01-15' END AS deadline,
       CASE WHEN n_chars % 6 < 2 THEN NULL WHEN n_chars % 6 = 2 THEN '' ELSE substring(text, 1, 20) END AS evidence,
       CASE WHEN n_chars % 7 < 3 THEN NULL WHEN n_chars % 7 = 3 THEN '' ELSE '00:01:05' END AS source_time,
       CASE WHEN n_chars % 8 < 4 THEN NULL ELSE substring(text, 5, 15) END AS quote,
       CASE n_chars % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE NULL END AS severity,
       CASE n_chars % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'none' ELSE NULL END AS priority,
       n_chars % 3 = 1 AS inferred
FROM {documents}"""

VIEWS["fx_sections"] = """
SELECT source AS meeting_id, doc_id AS ord,
       CASE WHEN n_chars % 11 = 0 THEN '?!' WHEN n_chars % 2 = 0 THEN concat(upper(lang), '!') ELSE lang END AS section,
       CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'exists' ELSE 'missing' END AS status,
       CASE n_chars % 3 WHEN 0 THEN NULL WHEN 1 THEN 'high' ELSE 'low' END AS priority,
       CASE n_chars % 5 WHEN 0 THEN '00:00:10' WHEN 1 THEN '' ELSE NULL END AS source_time,
       CASE n_chars % 6 WHEN 0 THEN text ELSE NULL END AS evidence,
       CASE n_chars % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS reasoning,
       CASE n_chars % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('see ', lang) ELSE text END AS notes
FROM {documents}"""

# Quotes: a foreign passage, an own passage behind two changed words, two leading words.
VIEWS["fx_quotes"] = """
SELECT doc_id AS meeting_id, 0 AS item_no, b.text AS quote
FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM {benchmark}) AS nth FROM {documents}) d JOIN {benchmark} b ON d.nth = b.item_id
UNION ALL
SELECT doc_id AS meeting_id, 1 AS item_no, concat('zz yy ', substring(text, CAST(1 + (doc_id * 37) % 200 AS INT), 90)) AS quote
FROM {documents}
UNION ALL
SELECT doc_id AS meeting_id, 2 AS item_no, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS quote
FROM {documents}"""

VIEWS["fx_turn_quotes"] = """
SELECT conv_id AS meeting_id, turn * 2 AS item_no, substring(text, CAST(1 + (conv_id * 13) % 60 AS INT), 70) AS quote
FROM {conversations}
UNION ALL
SELECT conv_id AS meeting_id, turn * 2 + 1 AS item_no, concat(role, ' bought a tractor and a red lorry') AS quote
FROM {conversations}"""

VIEWS["fx_pii"] = """
SELECT doc_id AS meeting_id, CAST(1 AS BIGINT) AS part, text FROM {documents}
UNION ALL
SELECT page_id AS meeting_id, CAST(2 AS BIGINT) AS part,
       concat('see ', url, ' at 00:01:05, call +7 (900) 123-45-', CAST(10 + page_id % 90 AS STRING), ' or 8 900 555 12 34, bill AB_',
              CAST(1234567 + page_id % 100 AS STRING), ' of shop-', CAST(page_id % 5 AS STRING), '.example.ru today') AS text
FROM {pages}"""

VIEWS["fx_names"] = """
SELECT event_id AS id, event_type,
       CASE event_id % 6 WHEN 0 THEN concat('rec ', CAST(CAST(ts AS DATE) AS STRING), ' v1')
            WHEN 1 THEN concat('call 2024-13-45 ', CAST(event_id AS STRING))
            WHEN 2 THEN concat(replace(CAST(CAST(ts AS DATE) AS STRING), '-', ''), '_planning')
            WHEN 3 THEN concat('sync 0', CAST(1 + event_id % 9 AS STRING), '.1.2024 finance')
            WHEN 4 THEN concat('plan 2030-01-01 then 2023_7_', CAST(1 + event_id % 28 AS STRING), ' Logistics?')
            ELSE 'notes: <raw>' END AS name,
       CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 1 THEN '01.02.2024' ELSE NULL END AS explicit,
       CASE WHEN event_id % 5 = 0 THEN DATE '2023-05-05' END AS stored, ts AS mtime
FROM {events}"""

VIEWS["fx_paths"] = """
SELECT id, name, mtime,
       concat(CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(event_type, '/') WHEN 2 THEN concat(event_type, '/ /')
                   WHEN 3 THEN concat(event_type, '/', 'room|', CAST(id % 3 AS STRING), '/')
                   ELSE concat('Sales/week ', CAST(id % 4 AS STRING), '/') END,
              CASE id % 7 WHEN 0 THEN '.' ELSE '' END, replace(name, '/', ' '),
              CASE id % 8 WHEN 0 THEN '.MP3' WHEN 1 THEN '_speakers.txt' WHEN 2 THEN '.json' WHEN 3 THEN '.docx'
                   WHEN 4 THEN '_anonymized_speakers.txt' WHEN 5 THEN '.wav.part' WHEN 6 THEN '.ogg' ELSE '' END) AS path
FROM {fx_names}"""

VIEWS["fx_people"] = """
SELECT split_part(p_name, ' ', 2) AS name, min(p_partkey) AS ord FROM {part} GROUP BY 1"""

VIEWS["fx_raw_owners"] = """
SELECT l_orderkey AS meeting_id, l_linenumber AS idx, l_partkey AS part_no, l_suppkey AS supp_no,
       CASE l_suppkey % 10 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN concat(split_part(p_name, ' ', 2), 'у')
            WHEN 2 THEN concat(upper(split_part(p_name, ' ', 2)), 'ов') WHEN 3 THEN concat('  ', split_part(p_name, ' ', 2), '  (подрядчик)')
            WHEN 4 THEN concat('SPEAKER_0', CAST(l_suppkey % 3 AS STRING)) WHEN 5 THEN 'Не назначен'
            WHEN 6 THEN concat(split_part(p_name, ' ', 2), 'ом ', p_brand) WHEN 7 THEN concat(split_part(p_name, ' ', 1), ' или ', split_part(p_name, ' ', 2))
            WHEN 8 THEN NULL ELSE p_name END AS raw
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

# Two runs of the extractor over one review queue, split by ship date.
VIEWS["fx_old_actions"] = """
SELECT l_orderkey AS meeting_id, CAST(l_linenumber AS BIGINT) AS idx, l_partkey AS part_no, l_suppkey AS supp_no, l_quantity AS qty, p_name AS task,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('owner ', CAST(l_suppkey % 10 AS STRING)) END AS owner,
       CASE WHEN l_quantity > 20 THEN 'High' ELSE 'low' END AS confidence,
       CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'proposed' END AS status
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) < DATE '2000-01-01'"""

VIEWS["fx_new_actions"] = """
SELECT l_orderkey AS meeting_id, CAST(l_linenumber AS BIGINT) AS idx, l_partkey AS part_no, l_suppkey AS supp_no, l_quantity AS qty,
       CASE WHEN l_partkey % 10 = 0 THEN '  ' WHEN l_partkey % 10 = 1 THEN upper(p_name) ELSE p_name END AS task,
       CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('person ', CAST(l_suppkey % 10 AS STRING)) END AS owner,
       CASE WHEN l_quantity > 25 THEN 'high' ELSE 'medium' END AS confidence
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) >= DATE '1997-01-01'"""

VIEWS["fx_old_meetings"] = """
SELECT concat('dir', CAST(o_custkey % 5 AS STRING)) AS dir, concat('m', CAST(o_orderkey AS STRING)) AS stem,
       concat('Old ', CAST(o_custkey AS STRING)) AS title, o_orderpriority AS category,
       CAST(o_orderdate AS DATE) AS date, 'filename' AS date_source, concat('h', CAST(o_orderkey AS STRING)) AS content_hash
FROM {orders} WHERE CAST(o_orderdate AS DATE) < DATE '1999-01-01'"""

VIEWS["fx_meeting_batch"] = """
SELECT concat('dir', CAST(o_custkey % 5 AS STRING)) AS dir, concat('m', CAST(o_orderkey AS STRING)) AS stem,
       CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('New ', CAST(o_custkey AS STRING)) END AS title,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS category,
       CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'explicit' END AS date_source,
       CASE WHEN o_custkey % 6 = 0 THEN '' ELSE concat('n', CAST(o_orderkey AS STRING)) END AS content_hash,
       CAST(1 AS BIGINT) AS batch_no
FROM {orders} WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'
UNION ALL
SELECT concat('dir', CAST(o_custkey % 5 AS STRING)) AS dir, concat('m', CAST(o_orderkey AS STRING)) AS stem,
       concat('Again ', o_orderstatus) AS title, o_orderpriority AS category, CAST(NULL AS DATE) AS date,
       CAST(NULL AS STRING) AS date_source, CAST(NULL AS STRING) AS content_hash, CAST(2 AS BIGINT) AS batch_no
FROM {orders} WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01'"""

VIEWS["fx_speaker_map"] = """
SELECT DISTINCT conv_id AS meeting_id, concat('SPEAKER_', role) AS speaker_label,
       concat(CASE role WHEN 'user' THEN 'Anna ' ELSE 'Boris ' END, CAST(conv_id % 50 AS STRING)) AS person
FROM {conversations} WHERE NOT (role = 'assistant' AND conv_id % 3 = 0)"""

# Raw extractor answers, one per document, made of its whole text: plain, fenced, after thinking, broken.  Only the background
# remark is two words: near duplicates of whole texts take minutes already at a thousand documents.
VIEWS["fx_responses"] = """
SELECT meeting_id, chunk_id,
       CASE chunk_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('```json\n', body, '\n```')
            WHEN 2 THEN concat('<think>let me see {</think>\n', body) WHEN 3 THEN concat('Sorry, no JSON: ', substring(body, 2))
            ELSE concat('<think>a</think>Here:\n```\n', body, '\n```\nbye') END AS raw
FROM (
  SELECT source AS meeting_id, doc_id AS chunk_id,
         concat('{"chunk_id": ', CAST(doc_id AS STRING), ', "time_range": {"start": "00:0', CAST(doc_id % 10 AS STRING),
           ':00", "end": "00:1', CAST(doc_id % 10 AS STRING), ':00"}, "summary": "', w1, ' and ', w2, '", "meeting_type": ',
           CASE n_chars % 5 WHEN 0 THEN 'null' WHEN 1 THEN '" Audit "' WHEN 2 THEN '"retro"' WHEN 3 THEN '"AUDIT"' ELSE '"planning"' END,
           ', "meeting_context": ', CASE WHEN n_chars % 4 = 0 THEN 'null' ELSE concat('" ', f1, ' ', f2, ' ', lang, ' "') END,
           ', "decisions": [{"decision": "', w1, ' ', lang, '", "speakers": ["', lang, '", " ', source, ' ", null], "confidence": "high", "quote": null, "evidence": "', w2,
           '"}], "action_items": [{"task": "', w2, ' now", "owner": ', CASE n_chars % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"None"' ELSE concat('"', lang, '"') END,
           ', "deadline": "', CASE WHEN n_chars % 2 = 0 THEN 'null' ELSE 'tomorrow' END, '", "confidence": "',
           CASE WHEN n_chars % 2 = 0 THEN 'high' ELSE 'low' END, '", "evidence": "', w1, '"}, {"task": "', w1, ' later", "owner": "', source,
           '", "confidence": "medium"}], "mentioned_topics": ["', w1, '", "', w1, '!", "', w2, '"]}') AS body
  FROM (SELECT doc_id, source, lang, n_chars, substring(clean, 1, CAST(floor(n_chars / 2) AS INT)) AS w1,
               substring(clean, CAST(floor(n_chars / 2) AS INT) + 1) AS w2, f1, f2
        FROM (SELECT doc_id, source, lang, n_chars, regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]+', 'x') AS f1,
                     regexp_replace(split_part(text, ' ', 2), '[^A-Za-z]+', 'y') AS f2, translate(text, concat(chr(34), chr(92), chr(9), chr(10), chr(13)), '     ') AS clean FROM {documents}) c) t
) u"""

_NAME = re.compile(r"\{(\w+)\}")


def needed(names: list[str]) -> list[str]:
    """The named views and all views below them, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for child in _NAME.findall(VIEWS[name]):
            if child in VIEWS or child in TABLES:
                visit(child)
        order.append(name)

    for n in names:
        visit(n)
    return order


def sql_text(name: str) -> str:
    return _NAME.sub(lambda m: m.group(1) if m.group(1) in VIEWS or m.group(1) in TABLES else m.group(0),
                     VIEWS[name])


def check_sql(body: str, recursive: bool = False) -> str:
    """DuckDB text: ``body`` behind the views it names as ``{fx_...}``."""
    names = [n for n in dict.fromkeys(_NAME.findall(body)) if n in VIEWS]
    parts = [f"{n} AS ({_for_duckdb(sql_text(n))})" for n in needed(names)]
    text = body
    for n in names:
        text = text.replace("{" + n + "}", n)
    own = text.strip()
    if own[:5].upper() == "WITH ":
        own = own[5:]
        joined = ",\n".join([*parts, own])
    else:
        joined = (",\n".join(parts) + "\n" + own) if parts else own
        if not parts:
            return own
    return ("WITH RECURSIVE " if recursive else "WITH ") + joined


def _for_duckdb(text: str) -> str:
    """DuckDB replaces one match unless told otherwise."""
    return text.replace("'[^A-Za-z]+', 'x')", "'[^A-Za-z]+', 'x', 'g')").replace(
        "'[^A-Za-z]+', 'y')", "'[^A-Za-z]+', 'y', 'g')")


class Inputs:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        special = _SPARK_VIEWS.get(name)
        if special:
            return special(self)
        below = {c: self[c] for c in dict.fromkeys(_NAME.findall(VIEWS[name]))
                 if c in VIEWS or c in TABLES}
        literal = VIEWS[name].replace("{", "{{").replace("}", "}}")
        text = re.sub(r"\{\{(\w+)\}\}", lambda m: "{" + m.group(1) + "}" if m.group(1) in below else m.group(0), literal)
        return self.spark.sql(text, **below)


def _numbered_events(inputs: Inputs) -> DataFrame:
    events = inputs["events"].drop("props")
    return scan.row_numbers(events, ["user_id"], "event_id", "seg_no")


_SPARK_VIEWS: dict[str, Callable[[Inputs], DataFrame]] = {"numbered_events": _numbered_events}
