"""Conversations as one training text each, by columnar byte assembly, with a loss mask over the assistant's texts.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. Control strings inside texts and roles get a
backslash after their first character (one more if they have some already), which ``unescape`` takes away again, so
every text can be read back exactly. A batch of turns is assembled in numpy: lengths of all segments (headers,
contents, ends), their cumulative offsets, and gather indices that copy all bytes into one preallocated Arrow buffer.

Rows are dealt out by conversation and ordered by turn (ties by role and text), and a conversation is formatted
in pieces of whole turns of about ``PIECE_BYTES``, so that memory does not grow with a conversation's length; its text is
its pieces in order. The loss mask is a list of spans (start, end) in code points of the piece. A turn is never cut, so the longest
turn bounds memory from below: some ten copies of it.

Odd input: a null text or role is the empty one; a null turn comes first; rows with a null conv_id form one conversation
of their own; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; none begins with the last character of another.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ENDINGS = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE = rf"([<\[])(\\*(?:{_ENDINGS}))"
UNESCAPE = re.compile(rf"([<\[])\\(\\*(?:{_ENDINGS}))")
LOSS_ROLE = "assistant"
PIECE_BYTES = 4 << 20
#: Bytes that one gather copies at once; its indices take eight times as many.
GATHER_BYTES = 1 << 20
PIECES = "conv_id long, piece long, formatted string, loss array<struct<start:int,end:int>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\\\2")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def escape_role(roles: pa.Array) -> pa.Array:
    """A role is one line: backslashes and line ends are written as two characters, then controls are escaped."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string array, and its offsets."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    own = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), own


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; where each turn starts (and the last ends), where its text starts and ends, in bytes."""
    n = len(texts)
    sources, starts, lengths = [], [], []
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    base = 0
    for part in (fixed[0], _bytes(escape_role(roles)), fixed[1], _bytes(escape(texts)), fixed[2]):
        data, offsets = part if isinstance(part, tuple) else (part, None)
        starts.append(base + (offsets[:-1] if offsets is not None else np.zeros(n, np.int64)))
        lengths.append(np.diff(offsets) if offsets is not None else np.full(n, len(data), np.int64))
        sources.append(data)
        base += len(data)
    source = np.concatenate(sources)
    start, length = np.stack(starts, 1).ravel(), np.stack(lengths, 1).ravel()
    ends = np.cumsum(length)
    begins = ends - length
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    first = 0
    while first < len(length):  # blocks of segments; a longer segment is a block of its own
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + GATHER_BYTES, side="right")))
        a, b = int(begins[first]), int(ends[last - 1])
        if last == first + 1:
            out[a:b] = source[start[first] : start[first] + length[first]]
        else:
            shift = np.repeat(start[first:last] - begins[first:last], length[first:last])
            out[a:b] = source[np.arange(a, b) + shift]
        first = last
    return buffer, np.concatenate((begins[::5], [total])), begins[3::5], ends[3::5]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each of the ascending byte offsets ``at``, block by block."""
    found, total, done = np.empty(len(at), np.int64), 0, 0
    for first in range(0, len(data) + 1, GATHER_BYTES):
        block = (data[first : first + GATHER_BYTES] & 0xC0) != 0x80
        last = int(np.searchsorted(at, first + GATHER_BYTES, side="left"))
        if last > done:
            found[done:last] = total + np.concatenate(([0], np.cumsum(block)))[at[done:last] - first]
            done = last
        total += int(np.count_nonzero(block))
    return found


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, role, text), ordered by conversation and turn, to pieces; a conversation may run over batches."""
    previous, number = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        roles, texts = (pc.fill_null(batch.column(i), "") for i in (1, 2))
        buffer, turn_at, text_from, text_to = assemble(roles, texts)
        data = np.frombuffer(buffer, np.uint8)
        wanted = np.unique(np.concatenate((turn_at, text_from, text_to)))
        points = code_points(data, wanted)
        turn_points, from_points, to_points = (points[np.searchsorted(wanted, x)] for x in (turn_at, text_from, text_to))
        loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
        out, first = [], 0
        while first < len(ids):
            last = first + 1
            while last < len(ids) and ids[last] == ids[first] and turn_at[last + 1] - turn_at[first] <= PIECE_BYTES:
                last += 1
            number = number + 1 if ids[first] == previous else 0
            previous, zero = ids[first], turn_points[first]
            spans = [{"start": int(from_points[i] - zero), "end": int(to_points[i] - zero)} for i in range(first, last) if loss[i]]
            out.append((ids[first], number, str(memoryview(data)[turn_at[first] : turn_at[last]], "utf-8"), spans))
            first = last
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "piece", "formatted", "loss"])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text), all turns of a conversation in one partition, in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, formatted, loss): each conversation's text in one piece, or several if it is long."""
    bound_arrow_batches(conversations.sparkSession)
    return ordered(conversations).mapInArrow(_pieces, PIECES)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn. No control string is left inside a text or a role, so the next mark found ends them."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its pieces, which come in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, out, started = None, [], False
    turns, masked, counts = sha256(), sha256(), [0, 0, 0]

    def close() -> None:
        out.append((current, counts[0], turns.hexdigest(), counts[1], masked.hexdigest(), counts[2]))

    for batch in batches:
        for conv_id, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if not started or conv_id != current:
                if started:
                    close()
                current, started, turns, masked, counts = conv_id, True, sha256(), sha256(), [0, 0, 0]
            for role, text in parse(formatted):
                counts[0] += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                counts[1] += len(text)
                masked.update(text.encode())
            counts[2] += len(formatted)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    if started:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def digests(conversations: DataFrame) -> DataFrame:
    """A row per conversation, read back from what ``format_chats`` writes (no shuffle between the two)."""
    return format_chats(conversations).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
