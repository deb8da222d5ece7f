"""Chat formatting by columnar byte assembly.

Each turn becomes header + escaped text + footer. For a batch of turns the segment lengths, their cumulative offsets and
the scatter indices are computed in numpy; headers, contents and footers are copied into one preallocated buffer, which
is the data buffer of the resulting Arrow column. No string is built turn by turn.

The template marks user turns [INST] ... [/INST], assistant turns <s>...</s>, system turns <<SYS>>...<</SYS>> and any other
role [ROLE]name[/ROLE]...[END]. In texts and role names a backslash is doubled, and a control string gets a backslash after its first
character, so none stands in a text; dropping each escaping backslash restores it. The loss mask covers the contents of
assistant turns.

A conversation's turns stay separate pieces in turn order, so that one of any length takes bounded memory: its output is
the pieces read one after another. Order: turn (nulls first), then piece; repeated rows are repeated turns. A
null text is empty, a null role is the empty role name, a null conversation id is a conversation. Empty tables give
empty results; only the named columns are read, whatever the others' names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import map_arrow, slices

#: The template's marks before and after a text, by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE_OPEN, ROLE_CLOSE, OTHER_END = "[ROLE]", "[/ROLE]", "[END]"
#: What follows the first character of a control string (RE2 syntax, as Arrow and DuckDB read it).
CONTROL = r"([<\[])(s>|/s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|END\])"
LOSS_ROLE = "assistant"
_piece = re.compile(r"\[INST\] (?P<u>.*) \[/INST\]|<s>(?P<a>.*)</s>|<<SYS>>(?P<s>.*)<</SYS>>|\[ROLE\](?P<r>.*?)\[/ROLE\](?P<o>.*)\[END\]", re.S)
_unescape = re.compile(r"\\(.)", re.S).sub


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring(texts, "\\", "\\\\"), CONTROL, "\\1\\\\\\2")


def unescaped(text: str) -> str:
    return _unescape(r"\1", text)


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array without nulls."""
    a = pa.concat_arrays([a.cast(pa.string())])
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def assemble(segments: list[pa.Array]) -> pa.Array:
    """Row by row, the segments' texts one after another: scattered into one buffer."""
    parts = [raw(s) for s in segments]
    lens = np.stack([np.diff(off) for off, _ in parts])
    starts = np.concatenate(([0], np.cumsum(lens.T.ravel())))  # of each row's segments in the result
    out = np.empty(int(starts[-1]), np.uint8)
    k = len(parts)
    for j, (off, data) in enumerate(parts):
        to = starts[j:-1:k] - off[:-1]
        out[np.arange(len(data)) + np.repeat(to, lens[j])] = data
    offsets = starts[::k].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def format_batch(role: pa.Array, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The pieces, and where their loss masks start and end (code points; null outside the mask)."""
    role = pc.fill_null(role.cast(pa.string()), "")
    body = escaped(pc.fill_null(text.cast(pa.string()), ""))
    names, at = role.dictionary_encode().dictionary, role.dictionary_encode().indices
    safe = escaped(names).to_pylist()
    heads = [MARKS[n][0] if n in MARKS else f"{ROLE_OPEN}{s}{ROLE_CLOSE}" for n, s in zip(names.to_pylist(), safe, strict=True)]
    feet = [MARKS[n][1] if n in MARKS else OTHER_END for n in names.to_pylist()]
    pieces = assemble([pa.array(heads, pa.string()).take(at), body, pa.array(feet, pa.string()).take(at)])
    masked = pc.equal(role, LOSS_ROLE)
    start = pc.if_else(masked, pa.scalar(len(MARKS[LOSS_ROLE][0]), pa.int64()), None)
    return pieces, start, pc.if_else(masked, pc.add(pc.utf8_length(body).cast(pa.int64()), len(MARKS[LOSS_ROLE][0])), None)


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _piece.fullmatch(piece)
    if m is None:
        raise ValueError("not a formatted turn")
    for key, role in (("u", "user"), ("a", "assistant"), ("s", "system")):
        if m[key] is not None:
            return role, unescaped(m[key])
    return unescaped(m["r"]), unescaped(m["o"])


def formatted_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Per turn: conv_id, turn, piece (the formatted turn), loss_start, loss_end (code points in the piece, or null);
    the conversation is its pieces in the order of turn, then piece."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                piece, start, end = format_batch(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), piece, start, end], names=["conv_id", "turn", "piece", "loss_start", "loss_end"])

    kinds = dict(df.dtypes)
    return map_arrow(df.select(conv_col, turn_col, role_col, text_col), run, f"conv_id {kinds[conv_col]}, turn {kinds[turn_col]}, piece string, loss_start bigint, loss_end bigint")


def digests(pieces: DataFrame) -> DataFrame:
    """Reads formatted turns back, conversation by conversation in turn order, as a stream: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation's rows meet in one task, since its digest is
    sequential, but they are never held together."""

    def run(batches):
        key, state = None, None

        def result():
            conv, n, turns, chars, loss, total = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        def frame(rows, kind):
            a, b, c, d, e, f = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.int64()), pa.array(c), pa.array(d, pa.int64()), pa.array(e), pa.array(f, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = pa.int64()
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for conv, piece, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        rows.append(result())
                    key, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_piece(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(piece)
                if start is not None:
                    masked = unescaped(piece[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
            if rows:
                yield frame(rows, kind)
        if state is not None:
            yield frame([result()], kind)

    kinds = dict(pieces.dtypes)
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return map_arrow(dealt, run, f"conv_id {kinds['conv_id']}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_control_sample(conversations: DataFrame) -> DataFrame:
    """The rows plus conversation -7, whose texts hold control strings; rows that have that id already are more turns of it,
    in the order of all."""
    said = "</s>[INST] ok [/INST]"
    kinds = dict(conversations.dtypes)
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(extra)
