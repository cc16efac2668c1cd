"""Token files, importance resampling and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mootlake.llm import ngram_join, repair, resample, tokenfiles

SF = "/root/testdata/sf0.001"
CLASHING = ("key", "size", "part", "place", "ident", "rank", "n", "start", "tokens", "said", "first", "times", "blank", "before", "bucket")
HARD = [None, "", "  ", "a b", "A  b\tc", "word " * 30, "x" * 30_000, "y z " * 9_000, "Ünï 中文字 a1 β", "word " * 30, "İ ǅ ﬁ́ ́a",
        "a<|endoftext|>b <|im_end|>", "\x1c\x1d\u0085 x y​z", "it's 'S 12,5 we'LL\r\n", "한글 각"]


def docs_of(spark, texts, ids=None, parts=3):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return df.withColumns({c: F.lit(1) for c in CLASHING})


# ------------------------------------------------------------ 11 token files

def encoded(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.vocabulary())
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def raw(texts):
    return pa.array(texts, pa.string())


def test_parts_are_encoded_like_whole_texts():
    rng = random.Random(3)
    plain = "abcdeFGH'sTlLvm0129.,!?-_<|>éÀßŸıŁ×÷²½ſŉ  "
    texts = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [chr(i) + " x" + chr(i) + "y" for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000]
    ids, counts = tokenfiles.Encoder("word_bpe_49k.json").encode(raw(texts), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == encoded(texts)
    letters = "abAB'sé́İΣσς1２‍👍🏽-<|>_ 　 \n\t\x0b\x1c字ﬀ가"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    ids, counts = tokenfiles.Encoder("word_bpe_49k.json").encode(raw(texts), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == encoded(texts)


def test_cache_is_bounded_and_harmless(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED_IDS", 9)
    monkeypatch.setattr(tokenfiles, "CACHED_PARTS", 5)
    encoder = tokenfiles.Encoder("word_bpe_49k.json")
    for texts in (["a b c d e"], HARD, ["c d"], HARD):
        ids, counts = encoder.encode(raw(texts), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == encoded(texts)


def token_rows(texts, ids):
    """Documents by id (null first), and of equal ids any order of texts."""
    made = encoded(texts)
    return {(ids[i], zlib.crc32(np.array(t, "<u4").tobytes()), len(t)) for i, t in enumerate(made)}


@pytest.mark.parametrize("ids", [None, [None, 5, 5, 5, None, -3, 9, 0, 5, 5, 2, 3, 4, 1 << 40, 7]])
def test_token_files(spark, ids):
    got = tokenfiles.round_trip(docs_of(spark, HARD, ids)).collect()
    assert len(got) == len(HARD)
    ids = ids or list(range(len(HARD)))
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == token_rows(HARD, ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_empty_token_files(spark):
    assert tokenfiles.round_trip(docs_of(spark, HARD).where("false")).collect() == []


def test_layout_and_selective_reads(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenfiles.write(docs, path, row_group_bytes=64 << 10, page_bytes=4 << 10, page_rows=20)
    groups = 0
    for file in (tmp_path / "tokens" / "tokens").glob("part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert groups > len(list((tmp_path / "tokens" / "tokens").glob("part-*.parquet")))
    plan = tokenfiles.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:" not in plan.split("ReadSchema")[1].replace("n_tokens:", "")
    some = tokenfiles.read(spark, path, first=50, last=59)
    assert "GreaterThanOrEqual(doc_id,50)" in some._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = encoded([texts[i] for i in sorted(texts)])
    starts = dict(zip(sorted(texts), itertools.accumulate(map(len, want), initial=0)))
    got = {r.doc_id: (r.start, r.tokens) for r in some.collect()}
    assert got == {i: (starts[i], want[sorted(texts).index(i)]) for i in range(50, 60) if i in texts}
    assert tokenfiles.metadata(spark, path).agg(F.sum("n_tokens")).first()[0] == sum(map(len, want))


# ------------------------------------------------------------ 12 resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, target):
    """doc_id -> n_features, weight, score, rank; distinct ids."""
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(buckets_of(text)[1])
    for text in target:
        want.update(buckets_of(text)[1])
    big_s, big_t = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (big_s + 10000) / ((raw[b] + 1) * (big_t + 10000)))) for b in raw}
    out, able = {}, []
    for doc_id, text in docs:
        words, found = buckets_of(text)
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out[doc_id] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if words >= 20:
            able.append((-out[doc_id][2], doc_id))
    for rank, (_, doc_id) in enumerate(sorted(able)[:5 * len(able) // 100], 1):
        out[doc_id][3] = rank
    return out


def test_resample_is_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    docs, target = docs.unionByName(extra), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id: [r.n_features, r.weight, r.score, r.rank] for r in resample.resample(
        docs.repartition(7).withColumns({c: F.lit(1) for c in CLASHING}), target).collect()}
    assert got == resampled([tuple(r) for r in docs.collect()], [r.text for r in target.collect()])
    assert sum(v[3] is not None for v in got.values()) > 5


def test_checksums_follow_from_words():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 2, 3, 9, 300, 70_000]))) for _ in range(40)]
    texts = [b" ".join(words), None, b"", words[0], b" ".join(words[:2]), b" ".join(words[5:8])]
    sizes, runs, owners = resample.word_runs(texts, resample.Shifts())
    assert sizes.tolist() == [40, 0, 0, 1, 2, 3]
    want = defaultdict(list)
    for i, text in enumerate(texts):
        own = (text or b"").split()
        for n in (1, 2, 3):
            want[n] += [(i, zlib.crc32(b" ".join(own[j:j + n]))) for j in range(len(own) - n + 1)]
    for n in (1, 2, 3):
        assert sorted(zip(owners[n - 1].tolist(), runs[n - 1].tolist())) == sorted(want[n])


@pytest.mark.parametrize("spread", [1, 5, 10**9])
def test_cutoff_is_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(resample, "RESTAGE", 3)
    rng = random.Random(spread)
    keys = [(rng.randint(-spread, spread), rng.choice([i, i % 7, resample.LAST_ID])) for i in range(700)]
    df = resample.stage_table(spark.createDataFrame(keys, "score bigint, ident bigint").repartition(6), "keys").cache()
    order = sorted((-s, i) for s, i in keys)
    for rank in (1, 2, 35, 350, 700):
        assert resample.cutoff(df, rank) == order[rank - 1]


def test_ties_at_the_cutoff_fit_exactly(spark):
    same = "one two three " * 10
    docs = docs_of(spark, [same] * 100 + [None, ""] + ["q " * 30] * 40, [7] * 60 + [None] * 40 + list(range(100, 142)))
    got = resample.resample(docs, spark.createDataFrame([("one two",)], "text string")).collect()
    assert len(got) == 142
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 5 * 140 // 100 + 1))
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(ranked, ranked[1:]))
    least = min((r.score for r in ranked))
    assert all(r.score <= least for r in got if r.rank is None and r.n_words >= 20)


def test_resample_of_little(spark):
    target = spark.createDataFrame([("one two",)], "text string")
    assert resample.resample(docs_of(spark, HARD).where("false"), target).collect() == []
    got = resample.resample(docs_of(spark, HARD), target.where("false")).collect()
    assert len(got) == len(HARD) and all(r.rank is None for r in got)


# ------------------------------------------------------------ 13 conversation repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """(conv, turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def cheapest(rows):
    """Cost, audit and turns by uniform-cost search over (row, state), least audit first."""
    done, heap, number = set(), [(0, "", 0, "", ())], itertools.count()
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if (at, state) in done:
            continue
        if at == len(rows) and state in ("", "a"):
            return cost, audit, turns
        # Entries come by cost, then audit, so the first one at a place and state is the best of those that go on alike.
        done.add((at, state))
        if at < len(rows):
            role, text, forced, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
            if not forced:
                if role[:1] and role[0] in grammar[state]:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, role[0], (*turns, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in grammar[state]:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, name[0], (*turns, f"{name}:{text}")))
        for name in ("user", "assistant"):
            if name[0] in grammar[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, name[0], (*turns, f"{name}:")))
    raise AssertionError(next(number))


def repaired(rows):
    """conv -> the contract's columns."""
    out = {}
    for conv, kept in damaged(rows).items():
        seen, marked, counts = set(), [], Counter()
        for _, role, text in kept:
            letters = BLANK.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, texts = cheapest(marked)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"
SAYINGS = ["Yes.", "No", "  ", "", None, "Why?", "Well...", "one. ", "two\n!\t", "ü.  "]
SPEAKERS = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula", "s"]


def random_talk(rng, convs, longest):
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(SPEAKERS), rng.choice(SAYINGS)))
    return rows


def talk(spark, rows, parts=4):
    return spark.createDataFrame(rows, TURNS).repartition(parts).withColumns({c: F.lit(1) for c in (*CLASHING, "cost", "audit", "last", "block")})


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_search_is_least_among_equals():
    """The search above against every edit string up to a length."""
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        best = (99, "")
        for n in range(len(rows) + 3):
            for audit in itertools.product("DIKR", repeat=n):
                ways = [(0, 0, "")]
                for edit in audit:
                    step = []
                    for at, cost, roles in ways:
                        if edit == "I":
                            step += [(at, cost + 3, roles + r) for r in "ua"]
                        elif at < len(rows):
                            role, _, forced, cut = rows[at]
                            if edit == "D":
                                step.append((at + 1, cost + 4, roles))
                            elif not forced:
                                step += [(at + 1, cost + 3 * cut, roles + role[0])] if edit == "K" else [(at + 1, cost + 3 + 3 * cut, roles + r) for r in "ua"]
                    ways = step
                for at, cost, roles in ways:
                    if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
                        best = min(best, (cost, "".join(audit)))
        assert cheapest(rows)[:2] == best


def test_divide_and_conquer_is_least():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randint(0, 30))]
        tables = [repair.row_table("" if forced or role == "tool" else role[0], cut and not forced, forced) for role, _, forced, cut in rows]
        rows = [(role, text, forced, cut and not forced) for role, text, forced, cut in rows]
        cost, edits, state = repair.solve(tables, repair.NOTHING, repair.CLOSING)
        audit = "".join(edits) + "I" * (repair.CLOSING[state] // 3)
        want = cheapest(rows)
        assert (cost + repair.CLOSING[state], audit) == want[:2]
        kept = [(i, role, text) for i, (role, text, forced, _) in enumerate(rows) if not forced]
        assert tuple(f"{r}:{t}" for r, t in repair.apply(audit, repair.NOTHING, kept)) == want[2]


def test_conversations_are_repaired(spark):
    rows = random_talk(random.Random(2), 150, 12)
    assert found(repair.repaired(talk(spark, rows))) == repaired(rows)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_conversations_of_many_blocks(spark, block):
    rng = random.Random(block)
    rows = random_talk(rng, 6, 40) + [(77, i if i % 3 else None, rng.choice(SPEAKERS), rng.choice(SAYINGS)) for i in range(300)]
    blocks = repair.pieces(repair.damage(talk(spark, rows, 9)), block)
    assert blocks.where("conv_id = 77").count() > 20
    assert found(repair.repaired(talk(spark, rows, 9), block)) == repaired(rows)


def test_repeated_and_long_rows(spark):
    rows = [(1, None, None, None)] * 3000 + [(2, 4, "user", "x" * 300_000 + ".")] * 3 + [(3, None, "user", "Hi.")] * 500 + [(4, 1, "assistant", "y" * 600_000)]
    assert found(repair.repaired(talk(spark, rows))) == repaired(rows)


def test_given_conversations(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(repair.repaired(given)) == repaired([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


def test_no_conversations(spark):
    assert repair.repaired(talk(spark, [(1, 1, "user", "a")]).where("false")).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(repair.repaired(talk(spark, [(gone, 1, "user", "a")]))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


# ------------------------------------------------------------ 7, the pairs still apart

@pytest.mark.parametrize("tile", [8, 10_000])
def test_open_pairs_are_told_once_and_all(spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "ROWS_PER_CELL", 50)
    rng = random.Random(tile)
    words = [[rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) for _ in range(4)] for _ in range(9)]
    nodes = [(i + 1, rng.choice([40, 44, 60, 400]), rng.choice([0, 1, 3]), rng.choice([1, 2, 3, i + 1]),
              *[w ^ (1 << rng.randrange(60)) for w in rng.choice(words)]) for i in range(90)]
    rows = [(x, *node) for x in range(30) for node in rng.sample(nodes, rng.randint(2, 60))]
    df = spark.createDataFrame(rows, "x bigint, node bigint, n bigint, rares bigint, root bigint, " + ", ".join(f"{c} bigint" for c in ngram_join.FOLDED))
    sizes = df.groupBy("x").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"))
    lows = sizes.groupBy("low").agg(F.sum("size").alias("low_rows"))
    members = df.join(sizes.join(lows, "low"), "x").repartition(5)
    want = {(r.a, r.b) for r in ngram_join._alike(members, members).collect()}
    got = [(r.a, r.b) for r in ngram_join._apart(members).collect()]
    assert len(want) > 50 and set(got) == want and len(got) == len(want)
