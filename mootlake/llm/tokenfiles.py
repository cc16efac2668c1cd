"""Token ids as Parquet list columns: files that can be read by document, by column and by page.

Texts are dealt by ranges of ``doc_id``, so file follows file and row follows row in ascending order.  A file holds, per
document, ``doc_id``, its number of tokens, the tokens before it in the file, and the list of ids.  The list is dictionary
encoded (a vocabulary is small, ids take two bytes or less), the other columns are delta encoded; row groups and pages have
set sizes, and page indexes come with every column, so a range of documents reads only the pages that hold it and a question
about lengths reads no tokens at all.  What lies before a file is known once all files are written: a narrow read of the
lengths gives one manifest row per file.

Tokens of a text are the tokens of its parts between ASCII white space, where the tokenizer drops white space and looks at
nothing across it, as this vocabulary does.  So distinct parts are encoded once a slice and lists are gathered from them;
the cache of a task is bounded and holds nothing that changes results.

Defined results: null and empty texts have the end id alone; texts of any length count whole; null ids come first; rows with
one ``doc_id`` follow each other by a hash of their texts, and repeated rows stay; an empty table gives no files' rows.
Extra columns are ignored.  Special tokens written out in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import attach, slices

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2_000
SLICE_BYTES = 4 << 20
CACHED_PARTS, CACHED_IDS = 600_000, 1 << 22
LAYOUT = "part int, doc_id {key}, n_tokens bigint, before bigint, tokens array<int>"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer lies on this machine; called inside tasks too."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Parts of these characters alone are the same under every edition of Unicode: composed, one lower case each, letters or not.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
_WORD = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"  # the letters among them


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Encoder:
    """Ids of texts, through the ids of their distinct parts.

    A plain part is cut into pieces as the vocabulary's own rule cuts it (``pieces``, the pattern of its file), and each distinct
    piece goes to the vocabulary's model.  All other parts, and parts that may hold a special token, go through the whole
    tokenizer.  What was learned stays for the next slices and tasks of a worker, up to ``CACHED_PARTS`` and ``CACHED_IDS``; then
    those met first, and so most often, stay.
    """

    def __init__(self, name: str) -> None:
        import regex
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.pattern = regex.compile(layout["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"][:2]) for t in layout["added_tokens"]) or r"(?!)")
        self.letters = _byte_letters()
        self.parts = _Known()
        self.pieces: dict[str, bytes] = {}

    def cut(self, part: str) -> list[str] | None:
        """Pieces of a plain part in lower case; None for any other."""
        if _PLAIN.fullmatch(part) and not self.special.search(part):
            return self.pattern.findall(part.lower())
        return None if part else []

    def cuts(self, parts) -> list[list[str] | None]:
        """Pieces of each part of an Arrow array; words with marks behind them, nearly all, are cut in Arrow."""
        import pyarrow.compute as pc

        core = pc.utf8_rtrim(parts, ",.!?;:")
        word = pc.match_substring_regex(core, f"^[{_WORD}]+$")
        behind = pc.subtract(pc.binary_length(parts), pc.binary_length(core))
        columns = [c.to_numpy(zero_copy_only=False).tolist() for c in (parts, pc.utf8_lower(core), word, behind)]
        return [([low, part[-n:]] if n else [low]) if plain else self.cut(part) for part, low, plain, n in zip(*columns, strict=True)]

    def learn(self, parts) -> None:
        cuts = self.cuts(parts)
        others = [i for i, c in enumerate(cuts) if c is None]
        others = iter(self.whole.encode_batch_fast([parts[i].as_py() for i in others], add_special_tokens=False))
        known, model, letters, made = self.pieces, self.model.tokenize, self.letters, []
        for c in cuts:
            if c is None:
                made.append(_packed(next(others).ids))
                continue
            found = b""
            for p in c:
                ids = known.get(p)
                if ids is None:
                    ids = known[p] = _packed([t.id for t in model(p if p.isascii() else p.encode().decode("latin-1").translate(letters))])
                found += ids
            made.append(found)
        self.parts.add(made)
        if len(known) > CACHED_PARTS:
            self.pieces = dict(islice(known.items(), CACHED_PARTS // 2))

    def encode(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array) end to end, the end id after each, and their counts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = np.diff(found.offsets.to_numpy())
        coded = found.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self.parts.number
        known = len(number)
        at = np.array([number.setdefault(w, len(number)) for w in distinct], np.int64)
        if len(number) > known:
            self.learn(coded.dictionary.filter(pa.array(at >= known)))
        part = at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        starts = self.parts.starts
        lengths = np.diff(starts)[part]
        owner = np.repeat(np.arange(len(texts)), sizes)
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64) + 1
        out = np.full(int(counts.sum()), end, np.int32)
        # The ids of a text stand behind the end ids of the texts before it.
        out[np.arange(int(lengths.sum())) + np.repeat(owner, lengths)] = self.parts.ids[_gathered(starts[part], lengths)]
        self.parts.keep_within()
        return out, counts


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Known:
    """Numbered keys, and the ids of each, end to end."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, packed: list[bytes]) -> None:
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def keep_within(self) -> None:
        if len(self.number) > CACHED_PARTS or len(self.ids) > CACHED_IDS:
            kept = min(CACHED_PARTS // 2, int(np.searchsorted(self.starts, CACHED_IDS // 2)), len(self.number))
            self.number = dict(islice(self.number.items(), kept))
            self.ids, self.starts = self.ids[:self.starts[kept]].copy(), self.starts[:kept + 1].copy()


@lru_cache(maxsize=1)
def _encoder(name: str) -> Encoder:
    return Encoder(name)


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, end to end."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _encoded(batches: Iterator, name: str, end: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    encoder, before, part = _encoder(name), 0, TaskContext.get().partitionId()
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            ids, counts = encoder.encode(batch.column("text"), end)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), batch.column("doc_id"), pa.array(counts), pa.array(before + ends - counts),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))],
                names=["part", "doc_id", "n_tokens", "before", "tokens"])
            before += int(ends[-1])


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = END_ID,
          row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Token files of ``docs`` (doc_id, text) below ``path``/tokens, and ``path``/manifest: part, tokens before the part."""
    rows = docs.select("doc_id", "text")
    key = rows.schema["doc_id"].dataType.simpleString()
    # The running number splits repeated rows of one id between files.
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    made = dealt.mapInArrow(lambda batches: _encoded(batches, tokenizer, end), LAYOUT.format(key=key))
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
               "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false",
               "parquet.enable.dictionary#tokens.list.element": "true", "compression": "zstd"}
    made.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sizes = metadata(spark, path, key).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(LAYOUT.format(key=key)).parquet(f"{path}/tokens")


def metadata(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """part, doc_id, n_tokens, before (in the file); no token is read."""
    return _files(spark, path, key).select("part", "doc_id", "n_tokens", "before")


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.schema("part int, ahead bigint").parquet(f"{path}/manifest")
    return attach(rows, manifest, "part", F.xxhash64("before")).withColumn("start", F.col("ahead") + F.col("before"))


def read(spark: SparkSession, path: str, key: str = "bigint", first=None, last=None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of all documents, or of those from ``first`` to ``last``: then only pages of that range."""
    rows = _files(spark, path, key)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "tokens")


def _checksums(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("tokens")
        raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        offsets = lists.offsets.to_numpy()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "doc_id", "n_tokens", "before")],
                                          pa.array(sums, pa.int64())], names=["part", "doc_id", "n_tokens", "before", "ids_crc32"])


def digest(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = _files(spark, path, key).mapInArrow(
        _checksums, f"part int, doc_id {key}, n_tokens bigint, before bigint, ids_crc32 bigint")
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """The digest of ``docs`` written to token files in the shared scratch folder."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path)
    return digest(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
