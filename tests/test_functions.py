"""Scalar rules on small tables of input and expectation."""

import datetime as dt
import time

from pyspark.sql import functions as F

from mootlake.functions import text, times
from mootlake.operators import people, pii


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_dates_in_names(spark):
    day = F.to_date(F.lit("2024-05-20"))
    d = dt.date
    cases = {"hall_2024-03-09_part2": d(2024, 3, 9), "stand-up 7.4.2024": d(2024, 4, 7), "x20240131y": d(2024, 1, 31),
             "log_2023_12_1": d(2023, 12, 1), "no digits": None, "run 2024-00-10": None, "run 31.31.2024": None,
             "tape 2018-02-02": None, "next 2028-01-01": None, "2024-02-30 or 2024-02-28": d(2024, 2, 28), "9202401311": None}
    got = column(spark, list(cases), lambda c: times.date_from_name(c, day))
    assert got == list(cases.values())
    asked = {"2024-05-01": d(2024, 5, 1), "01.05.2024": None, "2027-02-02": None, " 2024-05-22 ": d(2024, 5, 22),
             "2024-05-23": None, None: None}
    assert column(spark, list(asked), lambda c: times.explicit_date(c, day)) == list(asked.values())


def test_times_and_presets(spark):
    assert column(spark, [None, -5.0, 59.9, 3661.0, 400000.0], times.hms, "double") == [
        "00:00:00", "00:00:00", "00:00:59", "01:01:01", "111:06:40"]
    friday, monday = dt.date(2026, 8, 7), dt.date(2026, 8, 10)
    assert column(spark, [friday, monday], times.next_friday, "date") == [dt.date(2026, 8, 14), dt.date(2026, 8, 14)]
    assert column(spark, ["сегодня", "к пятнице", "до конца месяца", "позже", None],
                  lambda c: times.due_from_hint(c, F.lit(friday))) == [
        dt.date(2026, 8, 8), dt.date(2026, 8, 14), dt.date(2026, 8, 31), None, None]
    assert column(spark, ["в пятницу"], lambda c: times.due_from_hint(c, F.lit(friday))) == [dt.date(2026, 8, 14)]


def test_text_rules(spark):
    assert column(spark, ["Ёлка, да!", "  a_b  "], text.normalize) == ["ёлка да", "a_b"]
    assert column(spark, ["SPEAKER_00", "person 1", "Personal", "Anna", None, "unknown"], text.is_speaker_label) == [
        True, True, True, False, False, True]
    assert column(spark, ["a", "", "x" * 81, "..", "a/b", " ok "], text.is_valid_name) == [
        True, False, False, False, False, True]
    assert column(spark, ["<think>x</think> ```json\n{\"a\":1}\n```", "plain", "```\nz\n``` tail"], text.clean_response) == [
        '{"a":1}', "plain", "z"]
    assert column(spark, ["---\na: 1\n---\nbody", "---\nopen", "text"], text.strip_leading_front_matter) == [
        "body", "---\nopen", "text"]
    assert column(spark, ['"Итог."\nmore', "", "x" * 130], text.clean_title) == ["Итог", "Совещание", "x" * 120 + "…"]
    assert column(spark, ["a_speakers.txt", "b_anonymized_speakers.txt", "c.mp3", "_speakers.txt"], text.meeting_stem) == [
        "a", "b", "c", "transcript"]


def stem(word):
    """Trailing vowels and soft signs go, two letters stay."""
    low = word.lower().replace("ё", "е")
    return low[:2] + low[2:].rstrip("аеиоуыэюяйь")


def person_of(word, registry):
    """The first entry with the same letters, else the first whose stem is the beginning of the other's, three letters at least
    and three of difference at most, or the same."""
    fold = lambda w: w.lower().replace("ё", "е")
    for name in registry:
        if fold(name) == fold(word):
            return name, 0
    for name in registry:
        x, y = sorted((stem(name), stem(word)), key=len)
        if x == y or (len(x) >= 3 and len(y) - len(x) <= 3 and y.startswith(x)):
            return name, 1
    return None, None


# Stems of two, three and four letters and entries that begin alike, in an order that matters.
STEMS = ["пк", "пкт", "пктр", "пктрсд", "лмн", "лмнёр", "qrst", "qrstvwx"]
ENDINGS = ["", "а", "ой", "вб", "вбг", "вбгд"]


def test_owners_by_the_rule(spark):
    registry = ["Пктр", "пк", "ПКТа", "лмнерг", "Лмн", "Qrst", "пктрвб", "qrstvwxz"]
    words = [s + e for s in STEMS for e in ENDINGS]
    cases = {}
    for i, word in enumerate(words):
        raw = [word, f"  {word.upper()} ", f"{word} (зм)", f"{word} или {words[-1 - i]}", f"{word} {words[-1 - i]}", f"zz {word}"][i % 6]
        base = [word, word.upper(), word, word, f"{word} {words[-1 - i]}", f"zz {word}"][i % 6]
        clean = " ".join(raw.split())
        hits = [(t, h[1], h[0]) for t, w in enumerate([base, *([base.split(" ")[0]] if " " in base else [])]) if (h := person_of(w, registry))[0]]
        cases[raw] = (min(hits, key=lambda h: h[:2])[2], True) if hits else (clean, False)
    cases |= {None: (None, False), "": (None, False), " — ": (None, False), "n/a": (None, False), "speaker 3": ("speaker 3", False),
              "Person_пктр": ("Person_пктр", False)}
    assert sum(matched for _, matched in cases.values()) > 20 and sum(not matched for _, matched in cases.values()) > 10
    people_rows = spark.createDataFrame(list(enumerate(registry)), "ord int, name string").select("name", "ord")
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(cases)], "i int, raw string")
    assert {r.raw: (r.owner, r.matched) for r in people.normalize_owner(rows, people_rows).collect()} == cases


def test_pii_round_trip(spark):
    texts = spark.createDataFrame([
        (1, 1, "00:05:55 - 00:06:05 write a.b@mail.ru or see https://x.org/a?b=c, shop.example.com"),
        (1, 2, "again a.b@mail.ru; call +7 900 123-45-67 or 8 (900) 555 44 33, bill AB-1234567"),
        (2, 1, "no data, версия 1.2"), (2, 2, "другой a.b@mail.ru")], "meeting_id long, part long, text string")
    spans = pii.pii_spans(texts)
    tokens = pii.pii_tokens(spans)
    got = {(r.meeting_id, r.value): r.token for r in tokens.collect()}
    assert got == {(1, "a.b@mail.ru"): "EMAIL_001", (1, "https://x.org/a?b=c,"): "URL_001",
                   (1, "shop.example.com"): "DOMAIN_001", (1, "+7 900 123-45-67"): "PHONE_001",
                   (1, "8 (900) 555 44 33"): "PHONE_002", (1, "AB-1234567"): "TRANSACTION_001",
                   (2, "a.b@mail.ru"): "EMAIL_001"}
    masked = pii.pii_mask(texts, spans, tokens)
    text_of = {(r.meeting_id, r.part): r.text for r in masked.collect()}
    assert text_of[1, 1] == "00:05:55 - 00:06:05 write EMAIL_001 or see URL_001 DOMAIN_001"
    back = pii.restore(masked, ["meeting_id", "part"], tokens)
    assert {tuple(r) for r in back.select("meeting_id", "part", "text").collect()} == {tuple(r) for r in texts.collect()}
    more = pii.pii_tokens(pii.pii_spans(spark.createDataFrame(
        [(1, 9, "new z@mail.ru and a.b@mail.ru")], texts.schema)), tokens)
    assert {r.token for r in more.filter("value = 'z@mail.ru'").collect()} == {"EMAIL_002"}


def test_long_token_numbers(spark):
    names = spark.createDataFrame([(1, "PERSON_001", "Anna"), (1, "PERSON_0012", "Boris")], "meeting_id long, token string, value string")
    texts = spark.createDataFrame([(1, 1, "PERSON_0012 and PERSON_001 and PERSON_0019, PERSON_777")], "meeting_id long, part long, text string")
    assert pii.restore(texts, ["meeting_id", "part"], names).first().text == "Boris and Anna and Anna9, PERSON_777"
    assert [r.token for r in pii.unresolved_tokens(texts, ["meeting_id", "part"], names).orderBy("token").collect()] == [
        "PERSON_0019", "PERSON_777"]


def test_hooks(spark):
    import pandas as pd

    from mootlake.sources import hooks
    chunks = spark.createDataFrame([(1, 1, "00:00:00", "00:01:00", "hello"), (1, 2, "00:01:00", "00:02:00", "bye")],
                                   "meeting_id long, chunk_id long, start_time string, end_time string, text string")
    asked = hooks.extraction_requests(chunks)
    assert "Фрагмент 1 из 2 [00:00:00 — 00:01:00]:\n\nhello" in {r.request for r in asked.collect()}
    answers = hooks.run_extractor(asked, lambda s: s.str.len().astype(str))
    assert answers.count() == 2
    texts = spark.createDataFrame([(1, 1, "Anna met Boris")], "meeting_id long, part long, text string")
    found = hooks.recognize_entities(texts, lambda s: pd.Series([[("PER", 0, 4), ("MISC", 9, 14)]] * len(s)), {"PER": "PERSON"})
    assert [(r.type, r.value) for r in found.collect()] == [("PERSON", "Anna")]


def test_answers_full_of_blanks_take_linear_time(spark):
    gap = " " * 300_000
    cases = {"```json\n{\"a\":" + gap + "1}\n``` bye": "{\"a\":" + gap + "1}", "Sorry ``` {" + gap + "}": "Sorry ``` {" + gap + "}",
             "a" + gap + "b\n": "a" + gap + "b", "x ```json``` y": "json", "``` ``` ": "", "```\n z \n\n```": "z", None: None}
    began = time.monotonic()
    assert column(spark, list(cases), text.clean_response) == list(cases.values())
    assert time.monotonic() - began < 30
