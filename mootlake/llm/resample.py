"""Target-distribution importance resampling: documents drawn towards the word runs of a target corpus.

Features are runs of one to three consecutive words, hashed to ``BUCKETS`` buckets.  Two passes over the texts: the first
counts buckets, the second sums every document's gains.  Both work on arrays: words are numbered once a slice, and the
checksum of a run follows from the checksums of its words, because CRC-32 is linear (the checksum of ``ab`` is that of ``a``
moved on by the length of ``b``, xor that of ``b``).

The draw is the highest scores (weight plus a keyed Gumbel value), found by weighted median-of-medians selection: every task
reports the median of its remaining keys, the medians weighted by the tasks' remaining sizes give a pivot, and the side of
the pivot that cannot hold the cutoff key is discarded (a quarter of what remains at the least).  The driver sees one row per
task.  Survivors are written anew whenever they have shrunk to a sixteenth.  Only winners are sorted.

Defined results: null texts have no words, weight 0 and may not be drawn; texts of any length count whole; rows with the same
``doc_id`` take part one by one, and where equal keys meet the cutoff exactly as many are drawn as fit; null ids are hashed as
an empty text and come last among equal scores; an empty table or an empty target gives no crash (all gains then follow from
the smoothing).  ``doc_id`` must be integral.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, slices, stage_table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SLICE_BYTES = 2 << 20
RESTAGE = 16
LAST_ID = (1 << 63) - 1

# ASCII letters and digits make words, A-Z as a-z; so does every byte beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


# ---------------------------------------------------------------- checksums of word runs

def _byte_tables(basis: np.ndarray) -> np.ndarray:
    """For each of the four bytes of a checksum, the images of its 256 values under the linear map of ``basis``."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        byte, inside = divmod(bit, 8)
        out[byte, (np.arange(256) >> inside) & 1 == 1] ^= basis[bit]
    return out


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    return tables[0, values & 255] ^ tables[1, values >> 8 & 255] ^ tables[2, values >> 16 & 255] ^ tables[3, values >> 24]


class Shifts:
    """Checksums moved on by any number of bytes; tables of lengths met before are kept, up to a bound."""

    KEPT = 4096

    def __init__(self) -> None:
        ones = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        # Moving on by one zero byte, read off the library's own checksum.
        start = np.array([zlib.crc32(b"\0", int(v)) for v in ones], np.uint32) ^ np.uint32(zlib.crc32(b"\0", 0))
        self.powers = [_byte_tables(start)]
        self.known: dict[int, np.ndarray] = {}

    def table(self, length: int) -> np.ndarray:
        if length not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            basis, k = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32), 0
            while length >> k:
                if k == len(self.powers):
                    doubled = _apply(self.powers[-1], _apply(self.powers[-1], (np.uint32(1) << np.arange(32, dtype=np.uint32))))
                    self.powers.append(_byte_tables(doubled))
                if length >> k & 1:
                    basis = _apply(self.powers[k], basis)
                k += 1
            self.known[length] = _byte_tables(basis)
        return self.known[length]

    def tables(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of the distinct lengths, flat, and the place of each length's table."""
        distinct, place = np.unique(lengths, return_inverse=True)
        return np.concatenate([self.table(int(n)).ravel() for n in distinct]), place.astype(np.int64) * 1024


def _moved(flat: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.int64)
    return (flat[place + (wide & 255)] ^ flat[place + 256 + (wide >> 8 & 255)]
            ^ flat[place + 512 + (wide >> 16 & 255)] ^ flat[place + 768 + (wide >> 24)])


def word_runs(texts: list[bytes | None], shifts: Shifts) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text; for runs of one, two and three words the checksums and the text each belongs to."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = text.translate(_WORDS).split()
            sizes[i] = len(found)
            ids += [number.setdefault(w, len(number)) for w in found]
    if not ids:
        return sizes, [np.zeros(0, np.uint32)] * 3, [np.zeros(0, np.int64)] * 3
    word, owner = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), sizes)
    plain = np.fromiter((zlib.crc32(w) for w in number), np.uint32, len(number))
    spaced = np.fromiter((zlib.crc32(b" ", zlib.crc32(w)) for w in number), np.uint32, len(number))
    lengths = np.fromiter(map(len, number), np.int64, len(number))
    flat, place = shifts.tables(np.r_[lengths, lengths + 1])
    own, beyond = place[:len(lengths)], place[len(lengths):]
    runs, owners = [plain[word]], [owner]
    two, three = (np.flatnonzero(owner[n:] == owner[:-n]) if len(owner) > n else np.zeros(0, np.int64) for n in (1, 2))
    first, second = word[two], word[two + 1]
    runs.append(_moved(flat, own[second], spaced[first]) ^ plain[second])
    owners.append(owner[two])
    first, second, third = word[three], word[three + 1], word[three + 2]
    pair = _moved(flat, beyond[second], spaced[first]) ^ spaced[second]
    runs.append(_moved(flat, own[third], pair) ^ plain[third])
    owners.append(owner[three])
    return sizes, runs, owners


# ---------------------------------------------------------------- counts and gains

def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``texts`` (text); a task sends one row per bucket it met."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                _, runs, _ = word_runs(part.column("text").cast(pa.binary()).to_pylist(), shifts)
                for checksums in runs:
                    total += np.bincount(checksums % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in rows:  # one row per bucket, whatever the corpus holds
        counts[row.bucket] = row.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares), by bucket."""
    buckets, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (all_raw + buckets) / (float(s + 1) * (all_target + buckets))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    buckets = len(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shifts = Shifts()
        for whole in batches:
            for part in slices(whole, SLICE_BYTES):
                sizes, runs, owners = word_runs(part.column("text").cast(pa.binary()).to_pylist(), shifts)
                features, weight = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                for checksums, owner in zip(runs, owners, strict=True):
                    features += np.bincount(owner, minlength=len(sizes))
                    weight += np.bincount(owner, gain[checksums % np.uint32(buckets)], len(sizes)).astype(np.int64)
                luck = np.fromiter((gumbel(d, seed) for d in part.column("doc_id").to_pylist()), np.int64, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(features), pa.array(weight),
                     pa.array(weight + luck)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# ---------------------------------------------------------------- selection

_SIDES = ("below bigint, below_score bigint, below_id bigint, same bigint, "
          "above bigint, above_score bigint, above_id bigint")
Key = tuple[int, int]  # minus the score, then the id


def _middle(score: np.ndarray, ident: np.ndarray) -> tuple[int, int | None, int | None]:
    """Size and median key (the lower one of two) of some keys."""
    if not len(score):
        return 0, None, None
    order = np.lexsort((ident, -score))
    at = order[(len(order) - 1) // 2]
    return len(order), int(score[at]), int(ident[at])


def _sides(keys: DataFrame, pivot: Key | None) -> list:
    """Of every task: how many keys lie before, on and behind the pivot, and the medians of the two sides."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [(b.column("score").to_numpy(), b.column("ident").to_numpy()) for b in batches]
        score = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
        ident = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
        if pivot is None:
            before, on = np.ones(len(score), bool), np.zeros(len(score), bool)
        else:
            tied = -score == pivot[0]
            before, on = (-score < pivot[0]) | (tied & (ident < pivot[1])), tied & (ident == pivot[1])
        after = ~before & ~on
        row = [*_middle(score[before], ident[before]), int(on.sum()), *_middle(score[after], ident[after])]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=[c.split()[0] for c in _SIDES.split(", ")])

    return keys.mapInArrow(run, _SIDES).collect()


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """Keys strictly between two keys; the bounds on the score reach the scan."""
    if low is not None:
        keys = keys.where((F.col("score") <= -low[0]) & ((F.col("score") < -low[0]) | (F.col("ident") > low[1])))
    if high is not None:
        keys = keys.where((F.col("score") >= -high[0]) & ((F.col("score") > -high[0]) | (F.col("ident") < high[1])))
    return keys


def cutoff(keys: DataFrame, rank: int) -> Key:
    """The key at ``rank`` (from 1) of a written table of keys (score, ident), highest score and least id first."""
    low = high = pivot = None
    written = 0
    while True:
        rows = _sides(_between(keys, low, high), pivot)
        below, same = sum(r.below for r in rows), sum(r.same for r in rows)
        if pivot is not None:
            if below < rank <= below + same:
                return pivot
            if rank <= below:
                high = pivot
            else:
                low, rank = pivot, rank - below - same
        left = pivot is None or high == pivot
        medians = sorted((-r[f"{side}_score"], r[f"{side}_id"], r[side])
                         for side in ["below" if left else "above"] for r in rows if r[side])
        remain = sum(n for *_, n in medians)
        passed = 0
        for score, ident, n in medians:
            passed += n
            if 2 * passed >= remain:
                pivot = (score, ident)
                break
        written = written or remain
        if remain * RESTAGE <= written:
            keys, written = stage_table(_between(keys, low, high), "resample-remain"), remain


def _ranked(winners: DataFrame, most: int) -> DataFrame:
    """Rank of each row by key; rows beyond ``most``, equal to the last drawn one, get none."""
    order = [F.desc("score"), F.col("ident")]
    dealt = winners.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "resample-winners")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage_table(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "resample-offsets")
    rank = F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return attach(placed, offsets, "part", F.col("place")).withColumn("rank", F.when(rank <= most, rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) for every row of ``docs`` (doc_id, text);
    ``target`` (text) is the corpus whose distribution is wanted."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    shown = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = stage_table(scored(docs, gain, seed), "resample-scores").withColumn("ident", F.coalesce("doc_id", F.lit(LAST_ID)))
    able = rows.where(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    nobody = F.lit(None).cast("bigint").alias("rank")
    if not most:
        return rows.select(*shown, nobody)
    score, ident = cutoff(able.select("score", "ident"), most)
    won = ((F.col("n_words") >= least_words) & (F.col("score") >= -score)
           & ((F.col("score") > -score) | (F.col("ident") <= ident)))
    drawn = _ranked(rows.where(won), most)
    return rows.where(~won).select(*shown, nobody).unionByName(drawn.select(*shown, "rank"))
