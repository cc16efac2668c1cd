"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Batches of turns are laid out in numpy: segment lengths, cumulative
offsets and scatter indices, then headers and contents are copied into one preallocated buffer that becomes an Arrow
column.  Inside texts ``<|`` gets a backslash before the bar, and one more where there were some already, which makes every
text readable back; in roles ``%``, ``<`` and line ends are percent-encoded.  The loss mask is a list of byte ranges: the
text of every assistant turn.

Turns are dealt by conversation and sorted by turn, then role, then text.  A conversation is written in parts, each of the
turns of one batch, so that no conversation has to fit into memory; readers see parts in order and carry only a running
digest.

Defined results: null roles and texts are empty; null turns come first; rows with a null ``conv_id`` form one conversation;
repeated rows are turns of their own; an empty table gives no conversations.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The template.
TURN, AFTER_ROLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED_ROLE = "assistant"

BATCH_BYTES = 8 << 20
PART_SHAPE = ("conv_id {key}, part bigint, n_turns bigint, formatted binary, "
              "loss_start array<bigint>, loss_end array<bigint>")
_TURN_BACK = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(column):
    """Arrow strings with every ``<|`` defused."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(column):
    import pyarrow.compute as pc

    for plain, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        column = pc.replace_substring(column, pattern=plain, replacement=coded)
    return column


def unescape_role(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3C", "<").replace("%25", "%")


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start offsets and lengths of an Arrow string array."""
    import pyarrow as pa

    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(roles, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, the start of each turn (and the end of the last), and the range of each text."""
    pieces = [_bytes_of(escape_role(roles)), _bytes_of(escape(texts))]
    n = len(roles)
    lengths = np.stack([np.full(n, len(TURN)), pieces[0][2], np.full(n, len(AFTER_ROLE)), pieces[1][2],
                        np.full(n, len(END))], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for place, constant in ((0, TURN), (2, AFTER_ROLE), (4, END)):
        buffer[starts[:, place, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for place, (data, begin, size) in ((1, pieces[0]), (3, pieces[1])):
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        buffer[np.repeat(starts[:, place], size) + inside] = data[np.repeat(begin, size) + inside]
    return buffer, np.r_[starts[:, 0], len(buffer)], starts[:, 3], ends[:, 3]


def _parts(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    last, part = object(), 0
    for whole in batches:
        for batch in slices(whole, BATCH_BYTES):
            keys = batch.column("conv_id").to_pylist()
            buffer, starts, text_start, text_end = assemble(batch.column("role"), batch.column("text"))
            learned = np.asarray(pc.equal(batch.column("role"), LEARNED_ROLE).to_numpy(zero_copy_only=False), bool)
            firsts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            bounds = np.r_[firsts, len(keys)].astype(np.int64)
            numbers = []
            for i in firsts:
                part = part + 1 if keys[i] == last else 0
                last = keys[i]
                numbers.append(part)
            group = np.repeat(np.arange(len(firsts)), np.diff(bounds))
            base = starts[bounds[:-1]][group]
            mask_offsets = np.r_[0, np.cumsum(np.bincount(group[learned], minlength=len(firsts)))].astype(np.int32)
            ranges = [pa.ListArray.from_arrays(pa.array(mask_offsets), pa.array((x - base)[learned], pa.int64()))
                      for x in (text_start, text_end)]
            formatted = pa.Array.from_buffers(pa.binary(), len(firsts), [
                None, pa.py_buffer(starts[bounds].astype(np.int32)), pa.py_buffer(buffer)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(firsts)), pa.array(numbers, pa.int64()),
                 pa.array(np.diff(bounds), pa.int64()), formatted, *ranges],
                names=["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_start, loss_end; parts of a conversation follow each other in a partition."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_parts, PART_SHAPE.format(key=turns.schema["conv_id"].dataType.simpleString()))


def turns_of(formatted: bytes) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted part."""
    return [(unescape_role(role.decode()), unescape(text.decode())) for role, text in _TURN_BACK.findall(formatted)]


def _digests(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def row(s: list) -> list:
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            key, raw = batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py()
            if state is None or batch.column("part")[i].as_py() == 0:
                if state is not None:
                    done.append(row(state))
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = turns_of(raw)
            state[1] += len(turns)
            for role, text in turns:
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(batch.column("loss_start")[i].as_py(), batch.column("loss_end")[i].as_py(), strict=True):
                text = unescape(raw[a:b].decode())
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(raw.decode())
        if done:
            yield _rows(done, names, batch.schema.field("conv_id").type)
    if state is not None:
        yield _rows([row(state)], names, batch.schema.field("conv_id").type)


def _rows(rows: list[list], names: list[str], key):
    import pyarrow as pa

    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of whole conversations, from parts in the order in which ``format_conversations`` leaves them."""
    return parts.mapInArrow(_digests, f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, n_turns bigint, "
                            "turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
