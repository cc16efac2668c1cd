"""Skew-safe operators against brute force on seeded random data."""

import random

from pyspark.sql import functions as F

from mootlake.operators import chunking, dedup, evidence, pii, scan, transcript


def test_block_scans_equal_plain_loops(spark):
    rng = random.Random(1)
    rows = [(g, p, rng.choice(["a", "b", None, ""]), rng.randint(0, 9)) for g, n in ((1, 90), (2, 7), (3, 1))
            for p in sorted(rng.sample(range(300), n))]
    df = spark.createDataFrame(rows, "g int, p long, s string, v int")
    out = scan.running_total(df, ["g"], "p", F.col("v"), "total", size=16)
    out = scan.row_numbers(out, ["g"], "p", "n", size=16)
    out = scan.with_previous(out, ["g"], "p", ["s", "v"], "prev", size=16)
    out = scan.run_numbers(out, ["g"], "p", "s", "run", size=16)
    got = {(r.g, r.p): (r.total, r.n, tuple(r.prev) if r.prev else None, r.run) for r in out.collect()}
    want, state = {}, {}
    for g, p, s, v in rows:
        total, n, prev, run = state.get(g, (0, 0, None, 0))
        run += int(prev is not None and prev[0] != s)
        want[g, p] = (total, n + 1, prev, run)
        state[g] = (total + v, n + 1, (s, v), run)
    assert got == want


def turns_by_hand(segments):
    out, cur = [], None
    for meeting, _, start, end, speaker, words in segments:
        if cur is None or cur["m"] != meeting:
            cur = {"m": meeting, "s": None, "a": 0.0, "z": None, "t": []}
            out.append(cur)
        if speaker != cur["s"]:
            cur = {"m": meeting, "s": speaker, "a": start, "z": None, "t": []}
            out.append(cur)
        cur["z"] = end
        if words.strip():
            cur["t"].append(words.strip())
    return sorted((c["m"], c["s"] or "UNKNOWN_SPEAKER", c["a"], c["z"], " ".join(c["t"])) for c in out if c["t"])


def random_segments(seed, n):
    rng = random.Random(seed)
    return [(m, i, float(i), i + 0.5, rng.choice(["A", "A", "B", None, ""]), rng.choice(["x", "y z", " "]))
            for m in (1, 2, 3) for i in range(1, n)]


SEGMENT = "meeting_id long, seg_no long, start_s double, end_s double, speaker string, text string"


def test_turns(spark, monkeypatch):
    monkeypatch.setattr(scan.blocked, "__defaults__", (8,))
    segments = random_segments(5, 60)
    got = transcript.speaker_turns(spark.createDataFrame(segments, SEGMENT)).collect()
    assert sorted((r.meeting_id, r.speaker, r.start_s, r.end_s, r.text) for r in got) == turns_by_hand(segments)
    assert sorted(r.turn_no for r in got if r.meeting_id == 2) == list(range(1, 1 + sum(r.meeting_id == 2 for r in got)))


def test_live_turns_equal_batch(spark):
    from mootlake.streaming.turns import RUNS
    segments = random_segments(9, 40)
    whole = spark.createDataFrame(segments, SEGMENT)
    opened, closed = spark.createDataFrame([], RUNS), spark.createDataFrame([], RUNS)
    for a, b in ((0, 7), (7, 8), (8, 25), (25, 99)):
        ended, opened = transcript.advance_turns(whole.filter((F.col("seg_no") > a) & (F.col("seg_no") <= b)), opened)
        opened = spark.createDataFrame(opened.select(*closed.columns).collect(), RUNS)
        closed = spark.createDataFrame(closed.collect() + ended.select(*closed.columns).collect(), RUNS)
    live = transcript.finish_turns(closed.unionByName(opened))
    assert sorted(map(repr, live.collect())) == sorted(map(repr, transcript.speaker_turns(whole).collect()))


def chunks_by_hand(sizes, size, overlap):
    n, start, out = len(sizes), 0, []
    if sum(sizes) <= 2 * size:
        return [(0, n)]
    while start < n:
        end, used = start, 0
        while end < n and (end == start or used + sizes[end] <= size):
            used += sizes[end]
            end += 1
        out.append((start, end))
        if end >= n:
            return out
        back, covered = end, 0
        while back > start + 1:
            back -= 1
            covered += sizes[back]
            if covered >= overlap:
                break
        start = back
    return out


def test_chunks(spark):
    rng = random.Random(3)
    turns, want = [], []
    for m in range(12):
        texts = ["t" * rng.choice([1, 5, 40, 200, 900]) for _ in range(rng.choice([1, 3, 30, 120, 700]))]
        turns += [(m, i * 2, "S", i, i, t) for i, t in enumerate(texts)]
        sizes = [len(f"[00:00:00 - 00:00:00] S:\n{t}") for t in texts]
        want += [(m, a, b) for a, b in chunks_by_hand(sizes, 600, 150)]
    df = spark.createDataFrame(turns, "meeting_id long, turn_no long, speaker string, start_sec long, end_sec long, text string")
    for block in (65_536, 64):
        ranges, _ = chunking.chunk_ranges(df, 600, 150, block)
        assert sorted((r.meeting_id, r.pos_from, r.pos_to) for r in ranges.collect()) == sorted(want)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_greedy_dedup(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for g in (1, 2):
        seeds = [[rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(rng.randint(1, 9))] for _ in range(12)]
        for i in range(150):
            words = list(rng.choice(seeds))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice("abcdefuvwxyz") * 2
            rows.append((g, i, " ".join(words) if rng.random() > 0.05 else rng.choice(["", "?!", None])))
    df = spark.createDataFrame(rows, "g int, i long, t string")
    want, pairs = set(), {}
    for g in (1, 2):
        kept = []
        for h, i, t in rows:
            if h == g:
                words = set(("none" if t is None else t.replace("?!", "")).split())
                hit = [k for k, w in kept if jaccard(w, words) >= 0.6]
                if hit:
                    pairs[g, i] = hit[0]
                else:
                    kept.append((i, words))
                    want.add((g, i))
    for per_entry in (32, 0):
        monkeypatch.setattr(dedup, "PAIRS_PER_ENTRY", per_entry)
        got = {(r.g, r.i) for r in dedup.dedup_greedy(df, ["g"], "i", "t").collect()}
        assert got == want
    found = {(r.g, r.i): r.kept for r in dedup.near_dup_pairs(df, ["g"], "i", "t").collect()}
    assert found == pairs


def test_signatures_lose_no_similar_pair_and_drop_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows = []
    for i in range(400):
        a = list({word() for _ in range(rng.choice([2, 5, 13, 40, 200]))})
        b = a[rng.randint(0, len(a) // 2):] + [word() for _ in range(rng.randint(0, len(a) // 3))]
        rows.append((i, a, list(dict.fromkeys(b if i % 2 else [word() for _ in a]))))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    may = dedup._may_match(F.size("a"), F.size("b"), dedup._signature(F.col("a")), dedup._signature(F.col("b")), 0.6)
    passed = {r.i for r in df.filter(may).collect()}
    similar = {i for i, a, b in rows if jaccard(set(a), set(b)) >= 0.6}
    assert similar <= passed and len(similar) > 100
    assert {i for i in passed if i % 2 == 0} <= similar  # sets of unrelated words


def test_anchor_search(spark):
    rng = random.Random(7)
    vocabulary = ["да", "нет", "ёж", "мы", "план", "a1"]
    texts, quotes, want = [], [], {}
    for m in range(40):
        hay = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        q = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5 and len(hay) > 6:
            at = rng.randrange(len(hay) - 5)
            q = ["zz"] + hay[at:at + 6]
        texts.append((m, 0, ", ".join(hay)))
        quotes.append((m, 1, " ".join(q).upper()))
        need, best = min(4, len(q)), None
        for qp in range(len(q)):
            for hp in range(len(hay)):
                n = 0
                while qp + n < len(q) and hp + n < len(hay) and q[qp + n] == hay[hp + n]:
                    n += 1
                if n >= need and (best is None or n > best[1]):
                    best = (hp, n)
        if best:
            want[m] = (*best, len(", ".join(hay[:best[0]])) + (2 if best[0] else 0))
    got = evidence.anchor_quotes(spark.createDataFrame(quotes, "meeting_id long, item_no long, quote string"),
                                 spark.createDataFrame(texts, "meeting_id long, part_no long, text string")).collect()
    assert {r.meeting_id: (r.word_no, r.run_len, r.char_pos) for r in got} == want


def test_text_grams_without_a_quote_stay_out(spark):
    rng = random.Random(3)
    hay = [f"w{rng.randrange(10 ** 6)}" for _ in range(5000)]
    quotes = spark.createDataFrame([(1, 0, " ".join(hay[2400:2410])), (1, 1, "w7 zz")], "meeting_id long, item_no long, quote string")
    texts = spark.createDataFrame([(1, 0, " ".join(hay)), (2, 0, " ".join(hay))], "meeting_id long, part_no long, text string")
    asked = evidence._quotes(quotes, 4)
    grams = evidence._text_grams(texts, asked, 4).collect()
    assert {(r.hp, r.gram) for r in grams} >= {(i, " ".join(hay[i:i + 4])) for i in range(2400, 2407)}
    assert len(grams) < 1000  # 9,996 of lengths 2 and 4 without the filter
    words = spark.createDataFrame([(1, i, w, float(i)) for i, w in enumerate(hay)], "meeting_id long, word_no long, word string, start_s double")
    timed = evidence._timed_grams(words, asked, 4, block=100).collect()
    assert {(r.hp, r.gram) for r in timed} >= {(i, " ".join(hay[i:i + 4])) for i in range(2400, 2407)}
    assert len(timed) < 1000 and all(r.start_s == r.hp for r in timed)


def test_anchors_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(evidence, "FILTER_SLOTS", 1)
    rng = random.Random(5)
    hay = [f"w{rng.randrange(10 ** 6)}" for _ in range(900)]
    turns = spark.createDataFrame([(1, n, 10 * n, " ".join(hay[n * 300:n * 300 + 300])) for n in range(3)],
                                  "meeting_id long, turn_no long, start_sec long, line string")
    words = spark.createDataFrame([(1, i, w, i / 2) for i, w in enumerate(hay)], "meeting_id long, word_no long, word string, start_s double")
    starts = range(0, 890, 7)
    quotes = spark.createDataFrame([(1, i, " ".join(hay[i:i + 9])) for i in starts], "meeting_id long, item_no long, quote string")
    got = {r.item_no: (r.verified, r.t_sec) for r in evidence.quote_time(quotes, turns, words).collect()}
    assert got == {i: (True, i // 2) for i in starts}

def test_dictionary_forms_names_at_first_words_only(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    words[100:103], words[2000:2002] = ["Anna", "Maria", "Brown"], ["Acme", "Ltd"]
    texts = spark.createDataFrame([(1, 1, " ".join(words)), (2, 1, None), (3, 1, "")], "meeting_id long, part long, text string")
    names = spark.createDataFrame([("Anna", "PERSON"), ("Anna Maria Brown", "PERSON"), ("Acme Ltd", "COMPANY"), ("Maria Ltd", "COMPANY")],
                                  "value string, label string")
    got = {(r.start, r.stop, r.type, r.value) for r in pii.dictionary_spans(texts, names).collect()}
    at = lambda n: len(" ".join(words[:n])) + 1
    assert got == {(at(i), at(i) + len(v), k, v) for i, v, k in [(100, "Anna", "PERSON"), (100, "Anna Maria Brown", "PERSON"), (2000, "Acme Ltd", "COMPANY")]}
    tokens = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h"))
    mask = pii.FIRST_WORD_SLOTS * 64 - 1
    bits = spark.range(1).select(pii._first_word_bits(names).alias("bits"))
    passed = tokens.crossJoin(bits).filter(F.getbit(F.get("bits", F.shiftright(F.col("h").bitwiseAND(mask), 6).cast("int")),
                                                    F.col("h").bitwiseAND(63).cast("int")) == 1).count()
    assert 3 <= passed < 30
