"""Streams that are stopped, repeated and started over; files that arrive twice; late updates."""

import datetime as dt
import re
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mootlake.operators.transcript import speaker_turns
from mootlake.sources.artefacts import item_lines, read_artefacts, read_items, write_artefacts
from mootlake.sources.hooks import ResultStore, answer_requests
from mootlake.sources.tokenmap import TokenMap
from mootlake.streaming import digest, dispatch, ingest, turns, updates
from mootlake.streaming.common import Batch, BatchSink, drain, file_stream

SCHEMA = "id bigint, text string"


def schema(ddl):
    return T.StructType.fromDDL(ddl)


def landed(spark, path, rows, ddl=SCHEMA, files=1):
    spark.createDataFrame(rows, ddl).repartition(files).write.mode("append").parquet(path)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after_write", [True, False])
def test_killed_run_is_taken_up_again(spark, tmp_path, after_write):
    landing, sink = str(tmp_path / "in"), BatchSink(spark, str(tmp_path / "out"), schema(SCHEMA), ["id"])
    for i in range(4):
        landed(spark, landing, [(10 * i + j, f"t{j}") for j in range(5)])
    stream = lambda: file_stream(spark, landing, SCHEMA, "parquet", files_per_trigger=1)

    def failing(rows, batch):
        if batch.number == 2:
            if after_write:
                sink.write(rows, batch)
            raise Stopped("killed between batches")
        sink.write(rows, batch)

    checkpoint = str(tmp_path / "checkpoint")
    with pytest.raises(StreamingQueryException):
        drain(stream(), failing, "kill", checkpoint)
    assert sink.read().count() == (15 if after_write else 10)
    drain(stream(), sink.write, "kill", checkpoint)
    want = sorted((10 * i + j, f"t{j}") for i in range(4) for j in range(5))
    assert sorted(map(tuple, sink.read().collect())) == want
    assert sorted(r.batch for r in sink.batches().collect()) == [0, 1, 2, 3]
    # A new checkpoint reads everything again and adds nothing but what is new.
    landed(spark, landing, [(99, "new")])
    drain(stream(), sink.write, "kill", str(tmp_path / "another"))
    assert sorted(map(tuple, sink.read().collect())) == sorted([*want, (99, "new")])


def test_new_checkpoint_after_half_a_run(spark, tmp_path):
    landing, sink = str(tmp_path / "in"), BatchSink(spark, str(tmp_path / "out"), schema(SCHEMA), ["id"])
    for i in range(3):
        landed(spark, landing, [(i, "a")])

    def failing(rows, batch):
        if batch.number == 1:
            raise Stopped("killed")
        sink.write(rows, batch)

    stream = lambda: file_stream(spark, landing, SCHEMA, "parquet", files_per_trigger=1)
    with pytest.raises(StreamingQueryException):
        drain(stream(), failing, "half", str(tmp_path / "one"))
    drain(stream(), sink.write, "half", str(tmp_path / "two"))
    assert sorted(r.id for r in sink.read().collect()) == [0, 1, 2]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    sink = BatchSink(spark, str(tmp_path / "out"), schema(SCHEMA), ["id"])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    for _ in range(3):
        sink.write(rows, Batch("r", 0))
    assert sink.read().count() == 2
    assert BatchSink(spark, str(tmp_path / "out"), schema(SCHEMA)).read().count() == 2  # opening it again clears nothing


def test_journal_has_every_proposal_once(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    journal = dispatch.journal_sink(spark, str(tmp_path / "journal"))
    day = dt.date(2024, 1, 2)
    run = lambda c: dispatch.append_journal(file_stream(spark, landing, dispatch.JOURNAL, "parquet", 1), journal, c)
    landed(spark, landing, [("a", 1, "x", "o", day), ("b", 1, "y", "o", None)], dispatch.JOURNAL)
    run(checkpoint)
    landed(spark, landing, [("a", 1, "again", "p", None), ("c", 2, "z", "", day), ("c", 2, "z", "", day)], dispatch.JOURNAL)
    run(checkpoint)
    run(checkpoint)
    want = [("a", 1, "x", "o", day), ("b", 1, "y", "o", None), ("c", 2, "z", "", day)]
    assert sorted(map(tuple, journal.read().collect()), key=str) == want
    run(str(tmp_path / "new"))
    assert sorted(r.proposal_id for r in journal.read().collect()) == ["a", "b", "c"]


def test_updates_come_once_and_late_ones_are_kept(spark, tmp_path):
    landing, checkpoint, kind = str(tmp_path / "in"), str(tmp_path / "checkpoint"), "update_id bigint, message struct<date:bigint,text:string>"
    out = BatchSink(spark, str(tmp_path / "out"), schema("update_id bigint, message struct<date:bigint,text:string>, late boolean"))
    day = 24 * 3600
    waves = [[(i, (100 * day + i, "a")) for i in (1, 2, 3, 5000, 2)], [(4, (98 * day, "late")), (6, (100 * day - 60, "in time")), (1, (100 * day + 1, "again")), (9000, (101 * day, "b"))],
             [(7, (99 * day, "late")), (4, (98 * day, "again")), (8, (100 * day + 60, "in time"))]]
    for rows in waves:
        landed(spark, landing, rows, kind)
        drain(updates.once_or_late(file_stream(spark, landing, kind, "parquet"), "1 day"), out.write, "late", checkpoint)
    got = {r.update_id: (r.message.text, r.late) for r in out.read().collect()}
    assert out.read().count() == len(got) == 9
    assert {i for i, (_, late) in got.items() if late} == {4, 7}
    assert got[1] == ("a", False) and got[4] == ("late", True)


def test_digest_goes_out_once_a_day(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    sent = BatchSink(spark, str(tmp_path / "out"), schema(digest.SENT), ["board", "day"])
    kind = "board bigint, checked_at timestamp, check_no bigint, n_overdue bigint"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    waves = [[(1, at(1, 9), 1, 0), (2, at(1, 9), 1, 4)], [(1, at(1, 12), 3, 7), (1, at(1, 10), 2, 5), (2, at(1, 11), 2, 9)],
             [(1, at(1, 13), 4, 8), (1, at(2, 9), 5, 2), (3, at(2, 9), 1, 0)]]
    for rows in waves:
        landed(spark, landing, rows, kind, 3)
        digest.send_daily(file_stream(spark, landing, kind, "parquet"), sent, checkpoint)
    want = {(1, dt.date(2024, 1, 1)): 5, (2, dt.date(2024, 1, 1)): 4, (1, dt.date(2024, 1, 2)): 2}
    assert {(r.board, r.day): r.n_overdue for r in sent.read().collect()} == want and sent.read().count() == 3


def test_turns_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    kind = "meeting_id bigint, seg_no bigint, start_s double, end_s double, speaker string, text string"
    voices = [None, None, "A", "A", "B", None, "B", "B", "A", "A", "", "A"]
    rows = [(m, i + 1, float(i), float(i) + 0.5, voices[(i * m) % 12] if m > 1 else voices[i], f" w{i} " if i % 5 else " ")
            for m in (1, 2, 3) for i in range(12)]
    waves = [[r for r in rows if r[1] in (1, 2, 5)], [r for r in rows if r[1] in (3, 8, 9, 12)], [r for r in rows if r[1] in (4, 5, 6)], [r for r in rows if r[1] in (7, 10, 11)]]
    landing, sink, checkpoint = str(tmp_path / "in"), BatchSink(spark, str(tmp_path / "out"), schema(turns.RUNS)), str(tmp_path / "checkpoint")
    for wave in waves:
        landed(spark, landing, wave, kind, 2)
        turns.run_turns(file_stream(spark, landing, kind, "parquet"), sink, checkpoint)
    want = speaker_turns(spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, turns.all_turns(sink).collect())) == sorted(map(tuple, want.collect()))


# ------------------------------------------------------------ files

TALK = "[00:00:00 - 00:00:05] SPEAKER_A:\n{0} begins\n\n[00:00:05 - 00:00:09] SPEAKER_B:\nand ends\n"


def workplace(spark, tmp_path):
    made = lambda name, ddl, key: BatchSink(spark, str(tmp_path / name), schema(ddl), key)
    return ingest.Workplace(made("filed", ingest.FILED, ["path", "modified"]), made("turns", ingest.TURNS, ["meeting_id", "turn_no"]),
                            made("chunks", ingest.CHUNKS, ["meeting_id", "chunk_id"]))


def put(inbox, path, text):
    file = inbox / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")


def test_files_are_filed_away_under_free_names(spark, tmp_path):
    inbox, archive, work, checkpoint = tmp_path / "inbox", tmp_path / "archive", workplace(spark, tmp_path), str(tmp_path / "checkpoint")
    run = lambda: ingest.ingest_transcripts(ingest.watch_transcripts(spark, str(inbox), archive=str(archive)), work, checkpoint)
    put(inbox, "Sales/week 1/name=talk+a.txt/part-0.txt", TALK.format("one"))
    put(inbox, "notes.docx", "no transcript")
    put(inbox, "plain.txt", "just words")
    put(inbox, ".hidden.txt", "waits")
    run()
    assert {r.target: r.reason for r in work.filed.read().collect()} == {
        "processed/Sales/week 1/talk+a.txt": None, "failed/notes.docx": "unsupported kind", "processed/plain.txt": None}
    said = {(r.meeting_id, r.turn_no): (r.speaker, r.text) for r in work.turns.read().collect()}
    assert said[("processed/Sales/week 1/talk+a.txt", 0)] == ("SPEAKER_A", "one begins")
    assert said[("processed/plain.txt", 0)] == ("SPEAKER", "just words") and len(said) == 3
    assert work.chunks.read().count() == 2
    # The next run clears what the one before finished, and meets one of the names again.
    for i in range(2):
        put(inbox, f"Sales/week 1/more{i}.txt", TALK.format("more"))
        put(inbox, "other/talk+a.txt", TALK.format("other"))
        time.sleep(1.1)
        put(inbox, f"Sales/week 1/name=talk+a.txt/part-{i + 1}.txt", TALK.format(f"again {i}"))
        run()
    targets = [r.target for r in work.filed.read().collect()]
    assert len(set(targets)) == len(targets)
    plain = Counter(re.sub(r"_\d{8}-\d{6}", "_T", t) for t in targets)
    assert plain["processed/Sales/week 1/talk+a.txt"] == 1 and plain["processed/Sales/week 1/talk+a_T.txt"] == 2
    assert not (inbox / "plain.txt").exists() and any(p.name == "plain.txt" for p in archive.rglob("*.txt"))
    assert (inbox / ".hidden.txt").exists()


def test_names_of_one_second_and_names_with_a_stamp(spark, tmp_path):
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    kind = ", ".join(ingest.FILED.split(", ")[:8])
    rows = [(p, p.split("/")[-1], at, "s", "audio", "c", "d", reason) for p, reason in
            [("a/x.mp3", None), ("a/x_20240506-070809.mp3", None), ("a/x.mp3", None), ("a/x.mp3", None), ("x.mp3", None), ("a/x.mp3", "empty")]]
    landing, sink = str(tmp_path / "in"), BatchSink(spark, str(tmp_path / "out"), schema(ingest.FILED))
    for row in rows:
        landed(spark, landing, [row], kind)
        files = file_stream(spark, landing, kind, "parquet").withColumn("text", F.lit("t"))
        drain(ingest.file_away(files), sink.write, "names", str(tmp_path / "checkpoint"))
    assert sorted(r.target for r in sink.read().collect()) == sorted([
        "processed/a/x.mp3", "processed/a/x_20240506-070809.mp3", "processed/a/x_20240506-070809_2.mp3", "processed/a/x_20240506-070809_3.mp3",
        "processed/x.mp3", "failed/a/x.mp3"])


# ------------------------------------------------------------ what is kept between runs

def test_only_new_texts_are_asked(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), ResultStore(spark, str(tmp_path / "answers"))

    def extract(texts):
        import os
        import uuid
        os.makedirs(calls, exist_ok=True)
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return texts.str.upper()

    def asked():
        lines = sorted(line for p in (tmp_path / "calls").glob("*") for line in p.read_text().split("\n")) if (tmp_path / "calls").exists() else []
        for p in (tmp_path / "calls").glob("*"):
            p.unlink()
        return lines

    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")]
    make = lambda rows: spark.createDataFrame(rows, "meeting_id bigint, chunk_id bigint, request string")
    first = answer_requests(make(rows), store, extract, "one").collect()
    assert sorted((r.meeting_id, r.chunk_id, r.raw) for r in first) == [(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (2, 2, "C")]
    assert asked() == ["a", "b", "c"]
    rows[3] = (2, 2, "d")
    second = answer_requests(make(rows), store, extract, "two").collect()
    assert sorted((r.raw, r.asked) for r in second) == [("A", "one"), ("A", "one"), ("B", "one"), ("D", "two")] and asked() == ["d"]
    answer_requests(make(rows), store, extract, "two")  # a repeated run asks the same once more and adds nothing
    assert store.rows().count() == 4 and asked() == ["d"]


def test_token_map_goes_on(spark, tmp_path):
    kept = TokenMap(spark, str(tmp_path / "map"))
    kind = "meeting_id bigint, part bigint, nth bigint, type string, start bigint, stop bigint, value string"
    span = lambda m, nth, t, v: (m, 1, nth, t, 0, 1, v)
    kept.add(spark.createDataFrame([span(1, 0, "EMAIL", "a@b.c"), span(1, 1, "EMAIL", "d@e.f"), span(2, 0, "URL", "u")], kind), "one")
    more = spark.createDataFrame([span(1, 0, "EMAIL", "new@x.y"), span(1, 1, "EMAIL", "a@b.c"), span(1, 2, "URL", "d@e.f"), span(3, 0, "EMAIL", "a@b.c")], kind)
    want = {(1, "a@b.c"): "EMAIL_001", (1, "d@e.f"): "EMAIL_002", (2, "u"): "URL_001", (1, "new@x.y"): "EMAIL_003", (3, "a@b.c"): "EMAIL_001"}
    for _ in range(2):  # a repeated run adds nothing
        rows = kept.add(more, "two").collect()
        assert {(r.meeting_id, r.value): r.token for r in rows} == want and len(rows) == 5


def test_artefacts_of_other_meetings_stay(spark, tmp_path):
    path = str(tmp_path / "artefacts")
    items = lambda rows: spark.createDataFrame(rows, "meeting_id string, kind string, item_no bigint, key_text string")
    write_artefacts(path, actions=item_lines(items([("a", "action_items", 0, "x\n\"y\""), ("b", "action_items", 0, "z"), ("b", "decisions", 0, "d")]), "actions", "m1"))
    write_artefacts(path, actions=item_lines(items([("a", "action_items", 0, "new"), ("a", "action_items", 1, None)]), "actions", "m2"))
    got = read_items(spark, path, "actions", "item_no bigint, key_text string, status string, extractor string").collect()
    assert sorted((r.meeting_id, r.key_text or "", r.status, r.extractor, r.broken) for r in got) == [
        ("a", "", "open", "m2", None), ("a", "new", "open", "m2", None), ("b", "z", "open", "m1", None)]
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{path}/kind=actions/meeting_id=c")
    assert [(r.meeting_id, r.broken) for r in read_items(spark, path, "actions", "item_no bigint").filter("broken IS NOT NULL").collect()] == [("c", "{broken")]
    assert read_artefacts(spark, path, "decisions").count() == 0
    with pytest.raises(ValueError):
        write_artefacts(path, other=items([]))
