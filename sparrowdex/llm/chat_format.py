"""Chat formatting at token level.

A turn is <|turn|> role <|text|> text <|end|>.  Role and text are encoded by themselves and the three
control tokens, ids outside the vocabulary, are put between; so no content, whatever it holds, can
become a control token.  Control strings inside content (these and those of common other templates)
are escaped, reversibly, so that the formatted text is unambiguous too.  The loss mask covers the text
of assistant turns; it is the running sum of +1 at each such text's first token and -1 after its last.

Turns are dealt out by ranges of (conversation, turn, role, text), the order in which they are written, so
ties have one order and a conversation of any length is shared by several tasks.  Its tokens are written in
parts of a bounded number, numbered in order.  Reading back takes parts in any order and any splits: each is
decoded by itself, and what they hold is put in order by conversation and part for the digests.

Null roles and texts count as empty, rows with a null conversation id form one conversation, null turns come
first; repeated rows are turns of their own; a very long text is one turn, in a part of its own size; an empty
table gives an empty one.  Columns other than these four, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import coder
from .bytewords import cut
from .shared import parallel, ship

CONTROL = ("<|turn|>", "<|text|>", "<|end|>")
#: Control strings of common templates, escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
LEARNED_ROLE = "assistant"
PART_TOKENS = 1 << 18

_MARK = "␛"
_ESCAPE = re.compile("|".join(map(re.escape, (_MARK, *CONTROL, *FOREIGN))))
_UNESCAPE = re.compile(f"{_MARK}({_MARK}?)")


def escape(text: str) -> str:
    """Put a mark after the first character of each control string, and double marks that are there."""
    return _ESCAPE.sub(lambda m: _MARK * 2 if m[0] == _MARK else m[0][0] + _MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class _Ids:
    def __init__(self, path: str, pattern: str):
        self.bpe = coder(path, pattern)
        first = max(self.bpe.bytes_of) + 2  # one id is left free, as other uses of the vocabulary have a special there
        self.turn, self.text, self.end = range(first, first + len(CONTROL))

    def decode(self, ids) -> str:
        return "".join(self.bpe.decode_stream(ids))


_FORMATTED = "conv_id long, part long, input_ids array<int>, loss_mask array<boolean>"
_PARTS = 1 << 24  # parts that one task can write of a conversation


def format_conversations(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, part, input_ids, loss_mask of rows(conv_id, turn, role, text).

    Parts of a conversation follow each other by their numbers, which are not dense, and are cut between turns.
    """
    spark = rows.sparkSession
    ship(spark)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path, pattern)
        encode = ids.bpe.encode
        started, conv, part, size = False, None, 0, 0
        before = TaskContext.get().partitionId() * _PARTS
        tokens: list[int] = []
        jumps: list[tuple[int, int]] = []
        ready: list[tuple] = []

        def close() -> None:
            nonlocal size
            steps = np.zeros(len(tokens) + 1, dtype=np.int32)
            for at, by in jumps:
                steps[at] += by
            ready.append((conv, before + part, np.array(tokens, dtype=np.int32), np.cumsum(steps)[:-1].astype(bool)))
            size += len(tokens)
            tokens.clear()
            jumps.clear()

        def batch() -> pa.RecordBatch:
            nonlocal size
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in ready])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in ready]))) for k in (2, 3)]
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), *lists], names=["conv_id", "part", "input_ids", "loss_mask"])
            ready.clear()
            size = 0
            return out

        for b in batches:
            for some in cut(iter([b]), 3):
                for this, role, text in zip(*(some.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if started and this != conv:
                        close()
                        part = 0
                    elif len(tokens) >= PART_TOKENS:
                        close()
                        part += 1
                    if size > PART_TOKENS or len(ready) >= 512:
                        yield batch()
                    started, conv = True, this
                    text_ids = encode(escape(text))
                    tokens += [ids.turn, *encode(escape(role)), ids.text]
                    if role == LEARNED_ROLE:
                        jumps += [(len(tokens), 1), (len(tokens) + len(text_ids), -1)]
                    tokens += [*text_ids, ids.end]
        if started:
            close()
            yield batch()

    empty = F.lit("")
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    return source.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order).mapInArrow(assemble, _FORMATTED)


class _Read:
    """What one part holds: its turns as bytes to digest, what lies under the mask, and the characters of it all.

    A stretch of the mask that is just a turn's text is a place in the turns' bytes; any other one is added behind.
    """

    def __init__(self, ids: _Ids, tokens: np.ndarray, mask: np.ndarray):
        listed = tokens.tolist()
        turns, texts, ends = (np.flatnonzero(tokens == k).tolist() for k in (ids.turn, ids.text, ids.end))
        self.n_turns, self.chars = len(turns), len(turns) * sum(map(len, CONTROL))
        held, size, known = [], 0, {}
        for t, x, e in zip(turns, texts, ends, strict=True):
            role, text = ids.decode(listed[t + 1 : x]), ids.decode(listed[x + 1 : e])
            self.chars += len(role) + len(text)
            head, text = f"{unescape(role)}\n".encode(), unescape(text)
            body = text.encode()
            known[x + 1, e] = (size + len(head), size + len(head) + len(body), len(text))
            held += [head, body, b"\n"]
            size += len(head) + len(body) + 1
        self.turn_bytes, self.spans, self.loss_chars = size, [], 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            if (a, z) in known:
                start, stop, n = known[a, z]
            else:
                text = unescape(formatted_text(ids, listed[a:z]))
                held.append(text.encode())
                start, stop, n = size, size + len(held[-1]), len(text)
                size = stop
            self.spans += [start, stop]
            self.loss_chars += n
        self.data = b"".join(held)

    def row(self) -> tuple:
        return self.n_turns, self.data, self.turn_bytes, self.spans, self.loss_chars, self.chars


def formatted_text(ids: _Ids, tokens: list[int]) -> str:
    names = {ids.turn: CONTROL[0], ids.text: CONTROL[1], ids.end: CONTROL[2]}
    out, held = [], []
    for t in tokens:
        if t in names:
            out += [ids.decode(held), names[t]]
            held = []
        else:
            held.append(t)
    return "".join([*out, ids.decode(held)])


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the formatted conversations hold: one row a conversation, from ids and mask alone, in whatever order they come."""
    spark = formatted.sparkSession
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path, pattern)
        for b in batches:
            offs = b.column(2).offsets.to_numpy()
            tokens, mask = (np.asarray(b.column(k).values.to_numpy(zero_copy_only=False)) for k in (2, 3))
            rows, size = [], 0
            for k in range(len(b)):
                read = _Read(ids, tokens[offs[k] : offs[k + 1]], mask[offs[k] : offs[k + 1]].astype(bool))
                rows.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), *read.row()))
                size += len(read.data)
                if size > PART_TOKENS:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        names = ["conv_id", "part", "n_turns", "data", "turn_bytes", "spans", "loss_chars", "chars"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # conversation, its number of turns, loss characters and characters, and both digests

        def out(rows: list[list]) -> pa.RecordBatch:
            columns = [(r[0], r[1], r[4].hexdigest(), r[2], r[5].hexdigest(), r[3]) for r in rows]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*columns, strict=True), kinds, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for b in batches:
            done = []
            for conv, _, n, data, turn_bytes, spans, loss_chars, chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                now[1] += n
                now[2] += loss_chars
                now[3] += chars
                whole = memoryview(data)
                now[4].update(whole[:turn_bytes])
                for start, stop in zip(spans[::2], spans[1::2], strict=True):
                    now[5].update(whole[start:stop])
            if done:
                yield out(done)
        if now is not None:
            yield out([now])

    parts = formatted.select("conv_id", "part", "input_ids", "loss_mask").mapInArrow(decode, "conv_id long, part long, n_turns long, data binary, turn_bytes long, spans array<long>, loss_chars long, chars long")
    ordered = parts.repartition(parallel(spark), "conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
