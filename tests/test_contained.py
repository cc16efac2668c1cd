"""Containment of texts, and notes of sections, against brute force."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mootlake.operators import contained as module
from mootlake.operators.contained import contained
from mootlake.operators.items import merge_section_status


def parts_of(rng, whole):
    a = rng.randrange(len(whole))
    return whole[a:a + rng.choice([1, 2, 5, 9, 22, 23, 24, 60, 200])]


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 9)))
    out = [" ".join(word() for _ in range(rng.choice([1, 3, 10, 60]))) for _ in range(n)]
    out += [parts_of(rng, rng.choice(out)) for _ in range(n)]
    near = "the same long passage again and again with one word "
    out += [near * 3 + word() for _ in range(20)] + ["aaaa" * k for k in range(1, 30)]
    rng.shuffle(out)
    return [t for t in out if t]


@pytest.mark.parametrize("seed", [1, 2])
def test_contained(spark, seed):
    rows = [(i % 2 if i % 7 else None, i, t) for i, t in enumerate(dict.fromkeys(texts(seed)))]
    got = contained(spark.createDataFrame(rows, "g int, o long, t string").repartition(5), ["g"], "o", "t").collect()
    want = {(g, o) for g, o, t in rows if any(h == g and p < o and t in u for h, p, u in rows)}
    assert len(want) > 20 and {(r.g, r.o) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("many", [0, 512])
def test_short_texts_are_looked_for_themselves(spark, monkeypatch, many):
    long = "an outer text without any end in sight and more words than a window holds"
    monkeypatch.setattr(module, "SHORT_TEXTS", many)
    df = spark.createDataFrame([(1, 1, long), (1, 2, "end in"), (1, 3, "see en"), (1, 4, "e"), (2, 5, "end in"), (None, 6, long), (None, 7, "sight")],
                               "g int, o long, t string")
    assert {r.o for r in contained(df, ["g"], "o", "t").collect()} == {2, 4, 7}
    rows = df.filter("g = 1").selectExpr("o AS id", "t AS text", "array() AS lengths", "array('end in', 'see en', 'e') AS shorts").collect()
    told = pa.RecordBatch.from_pylist([{**r.asDict(), "lengths": []} for r in rows])
    answers = [x for b in module._grams([told]) for x in b.to_pylist()]
    assert sorted((a["id"], a["size"]) for a in answers if a["size"]) == [(1, 1), (1, 6), (2, 1), (2, 6), (3, 1), (3, 6), (4, 1)]


def folded(notes):
    acc = ""
    for t in notes:
        if t and t not in acc:
            acc = f"{acc} | {t}".strip(" |") if acc else t
    return acc or None


@pytest.mark.parametrize("odd", [False, True])
def test_notes_of_sections(spark, odd):
    rng = random.Random(odd)
    pool = [t.strip() for t in texts(5, 60)]
    if odd:
        pool += ["a | b", " lead", "trail ", "| x", "|", " ", "b | c"]
    rows = [(m, i, rng.choice(["S", "s!", "T"]), rng.choice([*pool, None, ""]), rng.choice([*pool[:9], None]))
            for m in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "meeting_id int, ord long, section string, reasoning string, notes string")
    for c in ("status", "priority", "source_time", "evidence"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    lists = defaultdict(list)
    for m, i, s, r, n in rows:
        lists[m, s.strip("!").lower(), "reasoning"].append(r)
        lists[m, s.strip("!").lower(), "notes"].append(n)
    got = {(r.meeting_id, r.section_key, f): r[f] for r in merge_section_status(df.repartition(4)).collect() for f in ("reasoning", "notes")}
    assert got == {k: folded([t for t in v if t]) for k, v in lists.items()}
