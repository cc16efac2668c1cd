"""N-gram Jaccard join with PartEnum signatures: exact components of texts whose shingle sets are alike.

Sets of five-word shingles with Jaccard at least ``THRESHOLD`` differ in few features.  Sizes are covered by overlapping
bands; in a band every pair that must be found there differs in at most ``k`` features.  The feature domain is partitioned
into first-level parts of ``N2`` second-level parts each, and the subsets of ``N2 - K2`` second-level parts are enumerated
(with 2 and 1: each half of a part).  A signature is the hash of the features in its subset.  At
most ``k`` subsets of a similar pair differ, so among the first ``k + 1`` subsets that are not empty in one set, one is the
same in the other; a set emits only these.  A set with too few of them goes on:

1. rare features only: done with ``k + 1`` subsets that are not empty;
2. else each of its rare features alone: found is every pair of such sets that shares one;
3. and, if it has at most ``k`` rare features, subsets of all features, empty ones too if need be: a similar pair without a
   common rare feature differs at least in all rare ones of both, so pairs with more rare features than that are passed over.

If either set is done at the first level, it guarantees the common signature; else the other two levels do.  So no pair is
lost, whatever counts as rare.  Rare is what a fixed-size filter of frequent features does not
hold; the filter is filled from the shingle counts of one distinct text in ``SAMPLE`` and only steers the work.

Candidates are stars: in each batch, then in each bucket of signatures, every set is paired with the least set of its
signature.  Stars are verified exactly, components are merged, and at the end sets that still share a signature across
components are paired once and verified too.  Equal sets are one node from the start.

Defined results: null texts and texts without words have an empty set and are linked with nothing; equal sets are linked;
repeated rows keep their rows; null ids take part, but no component is named by one unless it has no other id; an empty
table gives an empty result.  Nodes are named by 64-bit hashes of their sets.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, attach, slices, stage_table
from .wordhash import mix

SHINGLE = 5
THRESHOLD = (3, 4)  # numerator and denominator
N2, K2 = 2, 1
BAND = 1.5
SUBSETS = 0.75  # per least size of a band
FILTER_BITS = 24
SAMPLE = 8
FREQUENT = 6  # times in the sample
ENTRIES_PER_BUCKET = 1 << 17
BATCH_BYTES = 2 << 20
PARITIES = 1024
FOLDED = ("odd0", "odd1", "odd2", "odd3")
TILE = 8192  # members of a signature that are compared in one task
COMPARED = 1024
ROWS_PER_CELL = 1 << 16
SEEN = 1 << 19
NODE_MASK = (1 << 48) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- sets

def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, end to end, and their counts.  ``bytes.lower`` changes A-Z alone and
    ``bytes.split`` splits at exactly the contract's white space."""
    import xxhash

    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = text.lower().split()
            sizes[i] = len(found)
            ids += [number.setdefault(w, len(number)) for w in found]
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    words = hashed[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        rolled = mix(rolled * _A + words[j:len(words) - SHINGLE + 1 + j] + np.uint64(1)) if len(rolled) else rolled
    ends = np.cumsum(sizes)
    sets, counts = [], np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(sizes):
        start, n = ends[i] - sizes[i], sizes[i]
        if n >= SHINGLE:
            own = np.unique(rolled[start:start + n - SHINGLE + 1])
        else:
            h = np.full(1, n, np.uint64)
            for w in words[start:start + n]:
                h = mix(h * _B + w)
            own = h
        sets.append(own)
        counts[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def node_names(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of every set, independent of order; 0 for empty sets."""
    names = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        names[full] = mix(np.add.reduceat(mix(flat ^ _B), starts) + counts[full].astype(np.uint64))
    return names


def _batches(batches: Iterator, columns: list[str]) -> Iterator:
    """Slices of about BATCH_BYTES of text: the other columns, the sets, their sizes and names."""
    import pyarrow as pa

    for whole in batches:
        for part in slices(whole, BATCH_BYTES):
            flat, counts = shingle_sets(part.column("text").cast(pa.binary()).to_pylist())
            yield [part.column(c) for c in columns], flat, counts, node_names(flat, counts)


def parities(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PARITIES bits per set: whether a bucket of the feature domain holds an odd number of its features.  Sets differ in at
    least as many features as bits."""
    place = mix(flat + _B)
    at = np.repeat(np.arange(len(counts)), counts) * PARITIES + (place % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(at, minlength=len(counts) * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(counts), -1), axis=1).view(np.int64)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, n, odd (parities) for every row."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for own, flat, counts, names in _batches(batches, ["doc_id", "text_key"]):
            odd = parities(flat, counts)
            places = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * odd.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(names.view(np.int64)), pa.array(counts), pa.ListArray.from_arrays(places, pa.array(odd.ravel()))],
                names=["doc_id", "text_key", "node", "n", "odd"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
            .mapInArrow(run, f"doc_id {key}, text_key bigint, node bigint, n bigint, odd array<bigint>"))


# ---------------------------------------------------------------- frequent features

def frequent_filter(docs: DataFrame) -> np.ndarray:
    """Bit filter of features that occur FREQUENT times or more in the sampled sets; its size is fixed."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, flat, counts, names in _batches(batches, []):
            _, first = np.unique(names, return_index=True)
            chosen = np.zeros(len(names), bool)
            chosen[first] = True
            own = flat[np.repeat(chosen, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["f"])

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    sampled = part.mapInArrow(run, "f bigint").groupBy("f").count().where(F.col("count") >= FREQUENT)
    cells = sampled.select("f").mapInArrow(_cells, "cell bigint, bit bigint")
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _place(features: np.ndarray) -> np.ndarray:
    return mix(features + _A) >> np.uint64(64 - FILTER_BITS)


def _cells(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        place = _place(batch.column("f").to_numpy().view(np.uint64))
        bit = np.uint64(1) << (place & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))],
                                         names=["cell", "bit"])


def is_frequent(features: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = _place(features)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


# ---------------------------------------------------------------- signatures

def bands(largest: int) -> np.ndarray:
    """Rows (least, greatest, k): sets of these sizes take part; pairs not left to the next band differ in k at most."""
    p, q = THRESHOLD
    out, least = [], 3
    while least <= largest:
        after = max(least + 1, int(least * BAND))
        greatest = (after - 1) * q // p
        k = (after - 1 + greatest) * (q - p) // (q + p)
        out.append((least, greatest, k))
        least = after
    return np.array(out, np.int64).reshape(-1, 3)


def _cells_of(flat: np.ndarray, doc: np.ndarray, cells: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of hashes and count of features in every cell of every set, sets end to end."""
    offset = np.cumsum(cells) - cells
    hashed = mix(flat ^ np.uint64(seed * 0x51ED270B + 1))
    at = offset[doc] + ((hashed >> np.uint64(20)) % cells[doc].astype(np.uint64)).astype(np.int64)
    count = np.bincount(at, minlength=int(cells.sum()))
    order = np.argsort(at, kind="stable")
    sums = np.zeros(int(cells.sum()), np.uint64)
    if len(at):
        ordered = at[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sums[ordered[first]] = np.add.reduceat(mix(hashed + _B)[order], first)
    return sums, count


def signatures(flat: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets laid end to end, the set of each, and for those of level 3 its rare features, else 0."""
    none = np.zeros(0, np.int64)
    if not len(counts) or not counts.max():
        return none.astype(np.uint64), none, none
    sigs, owners, limits = [], [], []
    begin = np.cumsum(counts) - counts
    owner_of = np.repeat(np.arange(len(counts)), counts)
    rares = np.bincount(owner_of[rare], minlength=len(counts))
    alone = np.zeros(len(counts), bool)

    def emit(keys: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> None:
        sigs.append(keys)
        owners.append(owner)
        limits.append(limit)

    for number, (least, greatest, k) in enumerate(bands(int(counts.max()))):
        todo = np.flatnonzero((counts >= least) & (counts <= greatest))
        # First-level parts of N2 halves; subsets of N2 - K2 = 1 half, so subsets are the halves themselves.
        subsets = -(-max(int(SUBSETS * least) + 2, k + 2) // N2) * N2
        for level in (1, 3):
            if not len(todo):
                break
            sizes = counts[todo]
            at = np.repeat(begin[todo] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            doc = np.repeat(np.arange(len(todo)), sizes)
            if level == 1:
                at, doc = at[rare[at]], doc[rare[at]]
            sums, count = _cells_of(flat[at], doc, np.full(len(todo), subsets, np.int64), number * 4 + level)
            table, full = sums.reshape(len(todo), subsets), count.reshape(len(todo), subsets) > 0
            enough = full.sum(1) > k
            emitted = full & (np.cumsum(full, axis=1) <= k + 1)
            if level == 3:
                emitted |= ~enough[:, None]
            tag = mix(np.arange(subsets, dtype=np.uint64) + np.uint64((number * 4 + level) << 32))
            who, which = np.nonzero(emitted)
            emit(mix(table[who, which] * _A + tag[which]), todo[who], rares[todo[who]] if level == 3 else np.zeros(len(who), np.int64))
            alone[todo[~enough]] |= level == 1
            todo = todo[~enough & (rares[todo] <= k)]
    single = rare & alone[owner_of]
    emit(mix(flat[single] * _A + _B), owner_of[single], np.zeros(int(single.sum()), np.int64))
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(limits)


def _runs(key: np.ndarray, node: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, node) pairs in order with their limits, and whether each stands first in its key."""
    order = np.argsort(key)
    key, node, limit = key[order], node[order], limit[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    tied = np.lexsort((node[same], key[same]))  # few: keys held by several nodes
    node[same], limit[same] = node[same][tied], limit[same][tied]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
    key, node, limit = key[new], node[new], limit[new]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return key, node, limit, first


def _stars(key: np.ndarray, node: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of stars with their multiplicity, and a mask of members of keys held by more than one node."""
    run = np.cumsum(first) - 1
    size = np.bincount(run, minlength=int(first.sum())) if len(key) else np.zeros(0, np.int64)
    pivot = node[first][run] if len(key) else node
    edge = ~first
    pairs = np.stack([pivot[edge], node[edge]], axis=1)
    if not len(pairs):
        return pairs[:, 0], pairs[:, 1], np.zeros(0, np.int64), np.zeros(len(key), bool)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
    return pairs[new, 0], pairs[new, 1], np.diff(np.r_[new, len(pairs)]), size[run] > 1


_KINDS = "kind int, bucket bigint, x bigint, y bigint, weight bigint, sigs binary, nodes binary"
_BLOCK, _EDGE, _MEMBER = 0, 1, 2


def _out(kind: int, bucket, x, y, weight, sigs, nodes):
    import pyarrow as pa

    n = len(bucket)
    blank = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(bucket, pa.int64()), *[
            blank if v is None else pa.array(v.astype(np.uint64).view(np.int64)) for v in (x, y, weight)],
         pa.nulls(n, pa.binary()) if sigs is None else pa.array(sigs, pa.binary()),
         pa.nulls(n, pa.binary()) if nodes is None else pa.array(nodes, pa.binary())],
        names=["kind", "bucket", "x", "y", "weight", "sigs", "nodes"])


def _emit_stars(key, node, limit, first, buckets: int):
    """Rows for the stars and shared keys found here; dealt at random, they need no meeting."""
    a, b, weight, shared = _stars(key, node, first)
    if len(a):
        yield _out(_EDGE, (b % np.uint64(buckets)).astype(np.int64), a, b, weight, None, None)
    if shared.any():
        yield _out(_MEMBER, (node[shared] % np.uint64(buckets)).astype(np.int64), key[shared], node[shared], limit[shared], None, None)


def _packed(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """48 bits in six bytes, with ``high`` in two more."""
    both = low if high is None else low | high.astype(np.uint64) << np.uint64(48)
    return both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6 if high is None else 8]


def _unpacked(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    both = wide.view("<u8").ravel().astype(np.uint64)
    return both & np.uint64(NODE_MASK), (both >> np.uint64(48)).astype(np.int64)


def candidates(docs: DataFrame, frequent: np.ndarray, features: int) -> DataFrame:
    """Written table of stars (kind 1: node, node, common signatures) and members of shared signatures (kind 2: signature,
    node, rare features); nodes are the low 48 bits of their names.

    Signatures travel as packed blocks, one per batch and bucket; the number of buckets grows with the data, so a block's
    bucket always holds about ENTRIES_PER_BUCKET signatures.  A signature that many sets of a batch share is sent once.
    """
    buckets = 1 << max(6, min(24, (max(features, 1) // ENTRIES_PER_BUCKET).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    low = np.uint64(NODE_MASK)

    def sign(batches: Iterator) -> Iterator:
        for _, flat, counts, names in _batches(batches, []):
            _, first = np.unique(names, return_index=True)
            distinct = np.zeros(len(names), bool)
            distinct[first] = True
            distinct &= counts >= 3
            flat, names, counts = flat[np.repeat(distinct, counts)], names[distinct], counts[distinct]
            sigs, owner, limit = signatures(flat, counts, ~is_frequent(flat, shared.value))
            if not len(sigs):
                continue
            key, node, limit, first = _runs(sigs & low, names[owner] & low, limit)
            yield from _emit_stars(key, node, limit, first, buckets)
            key, node, limit = key[first], node[first], np.minimum(limit[first], 0xFFFF)
            bucket = (key >> np.uint64(48 - 24)) * np.uint64(buckets) >> np.uint64(24)
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[heads[1:], len(key)]
            short, packed = _packed(key, None), _packed(node, limit)
            yield _out(_BLOCK, bucket[heads].astype(np.int64), None, None, None,
                       [short[i:j].tobytes() for i, j in zip(heads, ends, strict=True)],
                       [packed[i:j].tobytes() for i, j in zip(heads, ends, strict=True)])

    def meet(table):
        import pyarrow as pa

        kinds = table.column("kind").to_numpy()
        found = [table.filter(pa.array(kinds != _BLOCK))]
        blocks = table.filter(pa.array(kinds == _BLOCK))
        if blocks.num_rows:
            (key, _), (node, limit) = [_unpacked(b"".join(blocks.column(c).to_pylist()), n) for c, n in (("sigs", 6), ("nodes", 8))]
            found += [pa.Table.from_batches([x]) for x in _emit_stars(*_runs(key, node, limit), buckets)]
        return pa.concat_tables([x.select(["kind", "bucket", "x", "y", "weight", "sigs", "nodes"]) for x in found])

    rows = docs.select("text").mapInArrow(sign, _KINDS).groupBy("bucket").applyInArrow(meet, _KINDS)
    return stage_table(rows.select("kind", "x", "y", "weight"), "join-candidates")


# ---------------------------------------------------------------- exact verification

def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, features) of the wanted nodes, each at least once; ``wanted`` has one (node, doc_id, text_key) per node."""
    texts = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    keys = wanted.select("doc_id", "text_key")
    match = texts["doc_id"].eqNullSafe(keys["doc_id"]) & (texts["text_key"] == keys["text_key"])
    small = keys.count() <= SMALL_ROWS
    met = texts.join(F.broadcast(keys) if small else keys, match, "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for _, flat, counts, names in _batches(batches, []):
            new = np.zeros(len(names), bool)
            for i, name in enumerate(names.tolist()):
                new[i] = name not in seen
                seen.add(name)
            flat, counts, names = flat[np.repeat(new, counts)], counts[new], names[new]
            features = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), features], names=["node", "features"])

    return met.select("text").mapInArrow(run, "node bigint, features array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written table of the pairs (a, b) whose Jaccard is at least the threshold.

    Sizes and parities rule out most pairs, exactly, before any set is read.
    """
    p, q = THRESHOLD
    form = nodes.select("node", "n", "odd")
    differing = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    fits = (pairs.join(form.toDF("a", "na", "odd_a"), "a").join(form.toDF("b", "nb", "odd_b"), "b")
            .where((F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
                   & (differing * (q + p) <= (F.col("na") + F.col("nb")) * (q - p))).select("a", "b"))
    fits = stage_table(fits, "join-pairs")
    # after an explode the planner takes a table for smaller than it is; it must not broadcast this one
    ends = fits.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends.hint("merge"), "node", "left_semi")
    sets = stage_table(sets_of(docs, stage_table(wanted.select("node", "doc_id", "text_key"), "join-wanted")), "join-sets")
    both = (fits.join(sets.toDF("b", "fb"), "b").join(sets.toDF("a", "fa"), "a")
            .withColumn("common", F.size(F.array_intersect("fa", "fb"))))
    union = F.size("fa") + F.size("fb") - F.col("common")
    return stage_table(both.where(q * F.col("common") >= p * union).select("a", "b").distinct(), "join-links")


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """Written table (node, root) of all nodes with links, root the name of their component.

    Every round hooks each root to its least neighbour, doubles the hooks until they end at roots, and contracts the edges;
    a chain of n links takes about log n small jobs.
    """
    edges = stage_table(links.where("a <> b"), "cc-edges")
    labels = stage_table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                         .select("node", F.col("node").alias("root")), "cc-labels")
    while edges.take(1):
        ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage_table(ways.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("root"), F.least("a", "least").alias("up")), "cc-hooks")
        while True:
            above = hooks.toDF("up", "upper")
            jumped = stage_table(hooks.join(above, "up").select("root", "up", "upper"), "cc-jumps")
            hooks = jumped.select("root", F.col("upper").alias("up"))
            if not jumped.where("up <> upper").take(1):
                break
        labels = stage_table(labels.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
        edges = stage_table(edges.join(hooks.toDF("a", "ua"), "a").join(hooks.toDF("b", "ub"), "b")
                            .select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct(), "cc-edges")
    return labels


def _rooted(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    return (pairs.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb"))


def _alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of members of one signature x, in different components, whose sizes, rare features and folded
    parities allow a link."""
    p, q = THRESHOLD
    columns = ("x", "node", "n", "rares", "root", *FOLDED)
    differing = F.bit_count(F.lit(0))
    for c in FOLDED:
        differing = differing + F.bit_count(F.col(f"{c}_l").bitwiseXOR(F.col(f"{c}_r")))
    left, right = [t.select(*[F.col(c).alias(c if c == "x" else f"{c}_{side}") for c in columns]) for t, side in ((left, "l"), (right, "r"))]
    return (left.join(right, "x").where("node_l <> node_r AND root_l <> root_r")
            .where((F.least("n_l", "n_r") * q >= F.greatest("n_l", "n_r") * p)
                   & (F.greatest(F.col("rares_l") + F.col("rares_r"), differing) * (q + p) <= (F.col("n_l") + F.col("n_r")) * (q - p)))
            .select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct())


def _apart(members: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) as in ``_alike``, of members with themselves.

    Two sets that are nearly alike share most of their signatures, so a join on signatures gives every pair a hundred times.
    Here signatures with the same least root are dealt to the same task, as far as they fit, and a task tells each pair once.  A signature
    of more than ``TILE`` members is cut into tiles, pairs of blocks of its members, that go to tasks of their own.
    """
    p, q = THRESHOLD
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    rows = members.withColumn("own", F.when(F.col("size") > TILE, F.pmod(F.xxhash64("node"), blocks)).otherwise(0).cast("int"))
    other = F.explode(F.when(F.col("size") > TILE, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    cells = F.ceil(F.col("low_rows") / ROWS_PER_CELL)
    rows = rows.withColumn("cell", F.when(F.col("size") > TILE, F.xxhash64("x", "i", "j")).otherwise(F.pmod(F.xxhash64("x"), cells)))
    key, form = ["low", "cell", "x", "i", "j"], ["own", "node", "n", "rares", "root", *FOLDED]

    def compare(group: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Pairs of one signature or tile, block by block."""
        crossing = group["i"][0] != group["j"][0]
        left = np.flatnonzero(group["own"] == group["i"])
        right = np.flatnonzero(group["own"] == group["j"]) if crossing else left
        for a in range(0, len(left), COMPARED):
            one = left[a:a + COMPARED]
            for b in range(0 if crossing else a, len(right), COMPARED):
                two = right[b:b + COMPARED]
                value = lambda c: (group[c][one][:, None], group[c][two][None, :])
                sizes, apart, rares = value("n"), np.not_equal(*value("root")), np.add(*value("rares"))
                differ = np.zeros((len(one), len(two)), np.int64)
                for c in FOLDED:
                    differ += np.bitwise_count(np.bitwise_xor(*value(c)))
                fits = (apart & (np.minimum(*sizes) * q >= np.maximum(*sizes) * p)
                        & (np.maximum(rares, differ) * (q + p) <= np.add(*sizes) * (q - p)))
                x, y = np.nonzero(fits)
                yield np.stack([group["node"][one[x]], group["node"][two[y]]], axis=1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        held: list[dict[str, np.ndarray]] = []
        at = None

        def told() -> Iterator:
            group = {c: np.concatenate([h[c] for h in held]) for c in (*key, *form)}
            for pairs in compare(group):
                pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
                fresh = [t for t in map(tuple, pairs.tolist()) if t not in seen]
                seen.update(fresh)
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in fresh], pa.int64()) for k in (0, 1)], names=["a", "b"])
                if len(seen) > SEEN:
                    seen.clear()

        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, *form)}
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for c in key:
                new[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.flatnonzero(new)
            for start, stop in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
                now = tuple(columns[c][start] for c in key)
                if held and now != at:
                    yield from told()
                    held.clear()
                    if now[0] != at[0]:
                        seen.clear()
                at = now
                held.append({c: v[start:stop] for c, v in columns.items()})
        if held:
            yield from told()

    dealt = rows.select(*key, *form).repartition("low", "cell").sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = stage_table(named(docs), "join-rows")
    seen = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = rows.where("n > 0").groupBy("node").agg(seen, F.min("doc_id").alias("least"),
                                                     F.first("n").alias("n"), F.first("odd").alias("odd"))
    nodes = stage_table(nodes.select("node", "one.doc_id", "one.text_key", "least", "n", "odd"), "join-nodes")
    features = rows.agg(F.sum("n")).first()[0] or 0
    found = candidates(docs, frequent_filter(docs), features)
    short = nodes.select(F.col("node").bitwiseAND(NODE_MASK).alias("short"), "node")

    # Stars: first each node with the centre it shares most signatures with, then all that still join components.
    stars = (found.where(F.col("kind") == _EDGE).groupBy("x", "y").agg(F.sum("weight").alias("weight"))
             .join(short.toDF("x", "a"), "x").join(short.toDF("y", "b"), "y").select("a", "b", "weight").where("a <> b"))
    stars = stage_table(stars, "join-stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b")
    links = verified(best, docs, nodes)
    rest = _rooted(stars.select("a", "b"), components(links)).join(best, ["a", "b"], "left_anti")
    links = links.unionByName(verified(rest, docs, nodes))
    labels = components(links)

    # Signatures whose members are still in different components.
    # Signature rows are many and stay narrow until it is known which signatures are open; dealt once, by signature.
    rooted_short = stage_table(labels.join(short, "node").select("short", "root"), "join-roots")
    rooted_short = F.broadcast(rooted_short) if rooted_short.count() <= SMALL_ROWS else rooted_short
    lean = (found.where(F.col("kind") == _MEMBER).select("x", F.col("y").alias("short"), F.col("weight").alias("rares"))
            .repartition("x").distinct())
    # Of signatures with the same members one is enough.
    marks = [F.bit_xor(F.xxhash64("short", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    root = F.coalesce("root", "short")
    lists = lean.join(rooted_short, "short", "left").groupBy("x").agg(
        *marks, F.count(F.lit(1)).alias("size"), F.max("rares").alias("rares"), F.min(root).alias("low"), F.max(root).alias("high"))
    one = lists.where("low <> high").groupBy("mark1", "mark2", "size", "rares").agg(F.min("x").alias("x"), F.first("low").alias("low"))
    one = stage_table(one.select("x", "size", "low"), "join-lists")
    by_low = stage_table(one.groupBy("low").agg(F.sum("size").alias("low_rows")), "join-lows")
    opened = stage_table(lean.join(attach(one, by_low, "low", F.col("x")), "x"), "join-open")

    # Parities of a coarser partition, four words of bits, travel with the members.
    folded = []
    for i in range(len(FOLDED)):
        word = F.get("odd", F.lit(i))
        for j in range(i + len(FOLDED), PARITIES // 64, len(FOLDED)):
            word = word.bitwiseXOR(F.get("odd", F.lit(j)))
        folded.append(word.alias(FOLDED[i]))
    form = nodes.select(F.col("node").bitwiseAND(NODE_MASK).alias("short"), "node", "n", *folded)
    dealing = ["size", "low", "low_rows"]
    members = stage_table(opened.join(form, "short").join(labels, "node", "left").select(
        "x", "node", "n", "rares", F.coalesce("root", "node").alias("root"), *FOLDED, *dealing), "join-members")

    # Stars once more, around a centre drawn anew for each signature; then every pair that is still apart.
    form = F.struct("node", "n", "rares", "root", *FOLDED)
    centres = members.groupBy("x").agg(F.min_by(form, F.xxhash64("node", "x")).alias("c")).select("x", "c.*")
    drawn = _alike(centres, members)
    anew = verified(drawn, docs, nodes)
    links = links.unionByName(anew)
    if anew.take(1):
        labels = components(links)
        members = members.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).select(
            "x", "node", "n", "rares", "root", *FOLDED, *dealing)
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(drawn)
    across = _apart(members).join(tested, ["a", "b"], "left_anti")
    late = verified(across, docs, nodes)
    if late.take(1):
        labels = components(links.unionByName(late))

    rooted = nodes.select("node", "least").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named_nodes = stage_table(rooted.join(least, "root").select("node", "component_id"), "join-components")
    return attach(rows, named_nodes, "node", F.xxhash64("doc_id", "text_key")).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; repeated rows of one id stay once.

    Only ids that occur more than once need a second step, and only their rows move in it.  Where some group has no id at
    all, documents without id stay once per text.
    """
    groups = stage_table(joined(docs), "join-groups")
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = stage_table(groups.groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select("doc_id"), "join-gone")
    kept = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone, "doc_id", "left_anti")
    unnamed = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    twice = stage_table(groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "join-twice")
    if twice.take(1):
        kept = (kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
                .unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)))
    alone = groups.where("doc_id IS NULL AND component_id IS NULL").take(1)
    return kept.unionByName(unnamed) if alone else kept
