"""Readers of documents, side-cars, boards and dim files."""

import datetime as dt
import json

from pyspark.sql.types import StructType

from mootlake.operators import archive, transcript
from mootlake.sources import artefacts, files
from mootlake.streaming import ingest
from mootlake.streaming.common import BatchSink


def put(root, path, body):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")


def document(*texts):
    return {"segments": [{"start": float(i), "end": i + 0.5, "speaker": "A", "text": t, "words": [{"word": t, "start": float(i)}]} for i, t in enumerate(texts)]}


def test_best_named_document_is_read(spark, tmp_path):
    for path, said in (("a/m1.json", "plain"), ("a/m1.words.json", "words"), ("a/m1 old.json", "old"), ("b/m2.words.json", "words"),
                       ("b/m2 b.json", "b"), ("b/m3 z.json", "z"), ("b/m3 c.json", "c"), ("a/m3.json", "elsewhere"), ("b/m4.txt", "no")):
        put(tmp_path, path, document(said, "x") if path.endswith("json") else said)
    meetings = spark.createDataFrame([(1, "a", "m1"), (2, "b", "m2"), (3, "b", "m3"), (4, "b", "m4")], "meeting_id long, dir string, stem string")
    listed = files.list_files(spark, str(tmp_path))
    assert listed.count() == 9 and listed.filter("size > 0 AND mtime IS NOT NULL").count() == 9
    chosen = transcript.prefer_document(archive.recognition_files(listed, meetings))
    assert {r.meeting_id: r.path for r in chosen.collect()} == {1: "a/m1.json", 2: "b/m2.words.json", 3: "b/m3 c.json"}
    rows = files.read_documents(spark, str(tmp_path), chosen).orderBy("meeting_id", "seg_no").collect()
    assert [(r.meeting_id, r.seg_no, r.text) for r in rows] == [(1, 1, "plain"), (1, 2, "x"), (2, 1, "words"), (2, 2, "x"), (3, 1, "c"), (3, 2, "x")]


def test_side_cars_keep_broken_rows(spark, tmp_path):
    put(tmp_path, "Ops/t 1_actions.json", [{"task": "a"}, "b"])
    put(tmp_path, "Ops/t 1_decisions.json", "[{")
    put(tmp_path, "t2_actions.json", {"task": "no list"})
    put(tmp_path, "t2_meta.json", {})
    got = {(r.dir, r.stem, r.kind): r.broken for r in files.read_sidecars(spark, str(tmp_path)).collect()}
    assert got == {("Ops", "t 1", "actions"): False, ("Ops", "t 1", "decisions"): True, ("", "t2", "actions"): True}


def test_board_snapshot(spark, tmp_path):
    put(tmp_path, "cards/1.json", [{"id": "c1", "name": "n", "due": "2024-05-06T07:00:00.000Z", "dueComplete": True, "idList": "l1", "shortUrl": "u"},
                                   {"id": "c2", "name": None, "due": None, "idList": "l2"}])
    put(tmp_path, "lists/1.json", [{"id": "l1", "name": "Done"}])
    cards = {r.card_id: r for r in files.read_board(spark, str(tmp_path / "cards"), "cards").collect()}
    assert cards["c1"].due == dt.date(2024, 5, 6) and cards["c1"].due_complete and not cards["c1"].closed and cards["c1"].url == "u"
    assert cards["c2"].due is None and not cards["c2"].due_complete and cards["c2"].list_id == "l2"
    assert [tuple(r) for r in files.read_board(spark, str(tmp_path / "lists"), "lists").collect()] == [("l1", "Done")]


def test_dim_files(spark, tmp_path):
    put(tmp_path, "people.json", ["Anna", " Boris "])
    put(tmp_path, "tree.json", {"Sales ": ["week", ""], "Ops": [], " ": ["x"]})
    put(tmp_path, "maps/12_speakers.json", {"SPEAKER_00": " Anna", "SPEAKER_01": "", "SPEAKER_02": None})
    assert [(r.ord, r.name) for r in files.read_people(spark, str(tmp_path / "people.json")).collect()] == [(0, "Anna"), (1, " Boris ")]
    assert {tuple(r) for r in files.read_categories(spark, str(tmp_path / "tree.json")).collect()} == {("Sales", "week"), ("Sales", None), ("Ops", None)}
    assert [tuple(r) for r in files.read_speaker_map(spark, str(tmp_path / "maps")).collect()] == [("12", "SPEAKER_00", "Anna")]


def test_files_named_after_no_meeting(spark):
    paths = spark.createDataFrame([("a/x.json",), ("y.json",)], "path string")
    nobody = spark.createDataFrame([], "meeting_id long, dir string, stem string")
    assert archive.recognition_files(paths, nobody).count() == 0
    assert archive.meeting_files(paths, nobody).count() == 0


def parts(path):
    return [p for p in path.rglob("part-*") if not p.name.endswith(".crc")]


def test_packs_hold_many_documents_in_few_files(spark, tmp_path):
    names = [f"a b/m{i}{end}" for i in range(300) for end in (".json", ".words.json")]
    root = str(tmp_path / "packs")
    rows = spark.createDataFrame([(p, json.dumps(document(p, None), ensure_ascii=False)) for p in names] + [("x/m0.txt", "no")], "path string, body string")
    files.write_packed(rows.coalesce(2), root)
    assert len(parts(tmp_path / "packs")) <= 2
    meetings = spark.createDataFrame([(i, "a b", f"m{i}") for i in (7, 70)], "meeting_id long, dir string, stem string")
    listed = files.list_files(spark, root, "*.json", packed=True)
    assert {r.path for r in listed.collect()} == set(names) and listed.filter("size > 0 AND mtime IS NOT NULL").count() == 600
    chosen = transcript.prefer_document(archive.recognition_files(listed, meetings))
    got = {(r.meeting_id, r.seg_no): r.text for r in files.read_documents(spark, root, chosen, packed=True).collect()}
    assert got == {(7, 1): "a b/m7.json", (7, 2): None, (70, 1): "a b/m70.json", (70, 2): None}
    segments = files.read_segment_documents(spark, root, packed=True)
    assert segments.count() == 1200 and {r.text for r in segments.filter("seg_no = 1").collect()} == set(names)
    cars = str(tmp_path / "cars")
    files.write_packed(spark.createDataFrame([("Ops/t 1_actions.json", '[{"task": "a"}]'), ("t2_decisions.json", "[{"), ("t2_meta.json", "{}")], "path string, body string"), cars)
    assert {(r.dir, r.stem, r.kind): r.broken for r in files.read_sidecars(spark, cars, packed=True).collect()} == {
        ("Ops", "t 1", "actions"): False, ("", "t2", "decisions"): True}


def test_numbered_runs_replace_their_own_meetings(spark, tmp_path):
    path = str(tmp_path / "artefacts")
    lines = lambda rows: spark.createDataFrame(rows, "meeting_id string, line string").coalesce(1)
    for _ in range(2):  # a repeated run replaces itself
        artefacts.write_artefacts(path, run=1, meta=lines([(f"m{i}", "old\u0000 \n") for i in range(200)] + [(None, "none")]), summary=lines([("m1", "s")]))
    artefacts.write_artefacts(path, run=2, meta=lines([("m1", "new"), ("m1", "more")]))
    assert len(parts(tmp_path / "artefacts")) <= 3
    got = sorted((r.meeting_id or "", r.line) for r in artefacts.read_artefacts(spark, path, "meta", runs=True).collect())
    assert got == sorted([("", "none"), ("m1", "new"), ("m1", "more")] + [(f"m{i}", "old\u0000 \n") for i in range(200) if i != 1])
    assert [tuple(r) for r in artefacts.read_artefacts(spark, path, "summary", runs=True).collect()] == [("m1", "s")]


def test_packed_transcripts_are_filed_away(spark, tmp_path):
    made = lambda name, ddl: BatchSink(spark, str(tmp_path / name), StructType.fromDDL(ddl))
    work, inbox = ingest.Workplace(made("filed", ingest.FILED), made("turns", ingest.TURNS), made("chunks", ingest.CHUNKS)), str(tmp_path / "inbox")
    for n in (40, 2):
        files.write_packed(spark.createDataFrame([(f"Sales/r {i}/t.txt", f"said {i}\n") for i in range(n)], "path string, body string").coalesce(1), inbox)
        ingest.ingest_transcripts(ingest.watch_transcripts(spark, inbox, packed=True), work, str(tmp_path / "checkpoint"))
    targets = [r.target for r in work.filed.read().collect()]
    assert len(set(targets)) == 42 and {f"processed/Sales/r {i}/t.txt" for i in range(40)} < set(targets)
    assert work.turns.read().count() == 42
