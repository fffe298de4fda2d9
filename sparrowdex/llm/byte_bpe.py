"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding.  A split of a byte string into tokens is the one that BPE gives exactly if every pair of
neighbouring tokens is a pair that BPE leaves as it is.  So each prefix of a piece has one split, and
the transducer's configurations are (token before, place in the token trie), one for each place where
the token now being read may have begun.  Reading a byte moves each configuration down the trie; the
one configuration that stands on a token allowed after its predecessor gives the last token of the
prefix read so far, and begins a new configuration.  Sets of configurations become deterministic
states when they are first met; a configuration is kept only as far as it matters, as the tokens that
it can still become.  A configuration began as many bytes ago as its place in the trie is deep, so the
state tells where all live ones began; the splits of the prefixes before them have a common part, which
no later byte changes: its tokens are emitted while reading, and only what lies behind is held (STEP
bytes and the lookahead that the vocabulary needs, however long the piece is).  Merges enter in one
place: whether a pair is allowed is found by replaying the merges at the border of the two tokens.

Decoding joins the bytes of a bounded number of ids and feeds them to an incremental UTF-8 machine,
which holds an unfinished character back until its last byte has come.

Null texts count as empty.  Rows with equal text or id give equal results row by row; columns other
than id and text, whatever their names, are not read.  A long text is processed whole, piece by piece.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import cut
from .shared import give_back, ship

_MEMO_PIECES = 1 << 18
_MET = 1 << 22
_MAX_STATES = 1 << 16
_NEVER = 1 << 60
_FEW = 48  # tokens below a node that are listed
STEP = 256  # bytes read between two emissions
DECODE_IDS = 1024  # ids whose bytes are joined at once

#: On texts of these characters only, Python's own classes agree with \p{L}, \p{N} and \s.
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]*")
_KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[int]:
    """Plain BPE: join the neighbouring parts of lowest rank until none (of rank under `below`) joins.

    n log n by a heap over a linked list, as pieces can be very long.
    """
    import heapq

    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2], _NEVER)) < below]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = stop, nxt[j], False
        if nxt[j] < n:
            prv[nxt[j]] = i
            if (r := ranks.get(piece[i : end[nxt[j]]], _NEVER)) < below:
                heapq.heappush(heap, (r, i, end[nxt[j]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:stop], _NEVER)) < below:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class _NoSplitError(Exception):
    pass


class Transducer:
    """The encoder of single pieces; states and transitions come into being as inputs need them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.width = {r: len(b) for b, r in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        self.depth: list[int] = [0]
        self.longest_held = 0
        for b, r in ranks.items():
            at = 0
            for x in b:
                to = self.trie[at].get(x)
                if to is None:
                    to = len(self.trie)
                    self.trie[at][x] = to
                    self.trie.append({})
                    self.final.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.final[at] = r
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.under: dict[int, list[int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: configurations from the oldest on, last token of the prefix read (-1: none)
        self.states: list[tuple[tuple, int]] = [((), -1)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.narrow: dict[tuple[int, int], object] = {}

    def _below(self, node: int) -> list[int] | None:
        """Tokens at or below a node of the trie, None if they are many."""
        if node not in self.under:
            found: list[int] | None = []
            todo = [node]
            while todo and found is not None:
                x = todo.pop()
                if self.final[x] >= 0:
                    found.append(self.final[x])
                todo.extend(self.trie[x].values())
                if len(found) > _FEW or len(todo) > _FEW:
                    found = None
            self.under[node] = found
        return self.under[node]

    def _begin(self, prev: int, node: int):
        """What a configuration keeps: the tokens it may become, or where these are many, its predecessor."""
        key = (prev, node)
        if key not in self.narrow:
            below = self._below(node)
            self.narrow[key] = prev if below is None else tuple(t for t in below if self._allowed(prev, t))
        return self.narrow[key]

    def _continue(self, kept, node: int):
        if isinstance(kept, int):
            return self._begin(kept, node)
        below = self._below(node)
        return tuple(t for t in kept if t in below)

    def _split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte.  (-1, -1): merging never makes t."""
        if t not in self.parts:
            b = self.token[t]
            got = merge_by_rank(b, self.ranks, t) if len(b) > 1 else []
            self.parts[t] = None if len(b) == 1 else (got[0], got[1]) if len(got) == 2 else (-1, -1)
        return self.parts[t]

    def _spine(self, t: int, side: int) -> list[int]:
        """From t's outermost byte on one side (0: first, 1: last) up to t, what stands at that edge as merging goes on."""
        known = self.spines[side]
        if t not in known:
            parts = self._split(t)
            known[t] = [t] if parts is None else [] if parts[0] < 0 or not (low := self._spine(parts[side], side)) else [*low, t]
        return known[t]

    def _allowed(self, a: int, b: int) -> bool:
        """Whether BPE leaves the neighbours a, b as they are (a < 0: nothing stands before b).

        Merging is replayed at the border alone: what stands left and right of it grows in the order
        of ranks; a merge across it that comes before the next growth joins the two.
        """
        if a < 0:
            return bool(self._spine(b, 0))
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 1 << 17:
                self.pairs.clear()
            left, right = self._spine(a, 1), self._spine(b, 0)
            ok, i, j, token, ranks = bool(left and right), 0, 0, self.token, self.ranks
            while ok:
                up_left = left[i + 1] if i + 1 < len(left) else _NEVER
                up_right = right[j + 1] if j + 1 < len(right) else _NEVER
                across = ranks.get(token[left[i]] + token[right[j]], _NEVER)
                if across < up_left and across <= up_right:
                    ok = False
                elif up_left == up_right == _NEVER:
                    break
                elif up_left <= up_right:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        """Determinise one transition."""
        configs, prev = self.states[state]
        found, last = [], -1
        for node, kept in configs:
            to = self.trie[node].get(byte)
            if to is not None and (kept := self._continue(kept, to)) != ():
                found.append((to, kept))
        if prev >= 0 or state == 0:
            to = self.trie[0].get(byte)
            if to is not None and (kept := self._begin(prev, to)) != ():
                found.append((to, kept))
        for node, kept in found:
            t = self.final[node]
            if t >= 0 and (t in kept if isinstance(kept, tuple) else self._allowed(kept, t)):
                last = t
                break
        # a leaf of the trie has nothing more to become
        key = (tuple(c for c in found if self.trie[c[0]]), last)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.last.append(last)
        return self.number[key]

    def _boundary(self, state: int, ends: list[int], at: int) -> int:
        """Up to where the splits of all live configurations agree: `at` bytes are read, ends[k] is the last token of k + 1."""
        configs, last = self.states[state]
        places = {at - self.depth[node] for node, _ in configs}
        if last >= 0:
            places.add(at)
        if not places or min(places) < 0:  # nothing can go on, or the first token is still being read
            return 0
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            # a configuration only ever began where a split ended
            places.add(far - self.width[ends[far - 1]] if far else 0)
        return places.pop()

    def _settled(self, ends: list[int], stop: int) -> list[int]:
        """Tokens of the split of the first `stop` bytes held."""
        out = []
        while stop:
            t = ends[stop - 1]
            if t < 0:
                raise _NoSplitError
            out.append(t)
            stop -= self.width[t]
        out.reverse()
        return out

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Token ids of one piece in runs, as they become certain."""
        state, ends, moves, last = 0, [], self.moves, self.last
        for lo in range(0, len(piece), STEP):
            for byte in piece[lo : lo + STEP]:
                try:
                    state = moves[state][byte]
                except KeyError:
                    moves[state][byte] = state = self._move(state, byte)
                ends.append(last[state])
            if lo + STEP < len(piece):
                self.longest_held = max(self.longest_held, len(ends))
                stop = self._boundary(state, ends, len(ends))
                if stop:
                    yield self._settled(ends, stop)
                    del ends[:stop]
        yield self._settled(ends, len(ends))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece, as merging by rank gives them; a piece that is a token is itself."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > _MAX_STATES or len(self.narrow) > 3 * _MAX_STATES:
            self._clear()
        try:
            return [t for run in self.stream(piece) for t in run]
        except _NoSplitError:  # no vocabulary made by merging gets here
            return merge_by_rank(piece, self.ranks)


class ByteBPE:
    """Encoder and decoder over whole texts; pieces met before are looked up."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.transducer = Transducer(self.ranks)
        import regex

        self.split = regex.compile(pattern).findall
        self.plain = re.compile(_PLAIN_PATTERN).findall if pattern == _KNOWN_PATTERN else None
        self.memo: dict[str, list[int]] = {}
        self.met, self.news = bytearray(_MET), 0

    def pieces(self, text: str) -> list[str]:
        return self.plain(text) if self.plain and _PLAIN.fullmatch(text) else self.split(text)

    def encode(self, text: str) -> list[int]:
        memo, pieces = self.memo, self.pieces(text)
        new = set(pieces).difference(memo)
        if len(memo) + len(new) > _MEMO_PIECES:
            memo.clear()
            new = set(pieces)
        encode_piece = self.transducer.encode_piece
        for p in new:
            memo[p] = encode_piece(p.encode())
        out = list(chain.from_iterable(map(memo.__getitem__, pieces)))
        # kept from the second meeting on: most pieces of a corpus are met once
        met = self.met
        for p in new:
            at = hash(p) & (_MET - 1)
            if len(p) > 64 or not met[at]:
                del memo[p]
                met[at] = 1
        self.news += len(new)
        if self.news > _MET // 4:
            self.met, self.news = bytearray(_MET), 0
        return out

    def decode_stream(self, ids: Sequence[int], errors: str = "strict", at_once: int = DECODE_IDS) -> Iterator[str]:
        """Text as it becomes certain: a character is held back until its last byte has come."""
        machine, bytes_of = codecs.getincrementaldecoder("utf-8")(errors), self.bytes_of
        for lo in range(0, len(ids), at_once):
            text = machine.decode(b"".join([bytes_of[i] for i in ids[lo : lo + at_once]]))
            if text:
                yield text
        if text := machine.decode(b"", True):
            yield text

    def decoded_digest(self, ids: Sequence[int]) -> str:
        """Hex SHA-256 of the UTF-8 bytes of the text that the ids stand for, by the streaming decoder."""
        digest = hashlib.sha256()
        for text in self.decode_stream(ids):
            digest.update(text.encode())
        return digest.hexdigest()


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
        gc.freeze()  # tries and states live as long as the worker: no need to visit them again
        gc.set_threshold(500_000, 20, 50)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, n_tokens and decoded_sha256, what the ids give when they are decoded again, of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in cut(batches, 1):
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(map(c.decoded_digest, ids), pa.string())],
                names=["doc_id", "ids", "n_tokens", "decoded_sha256"],
            )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are no UTF-8 become U+FFFD."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            texts = ["".join(c.decode_stream(ids or [], "replace")) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, keeping digests only."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        named = [str(i) for i in range(max(c.bytes_of) + 1)]
        for b in cut(batches, 1):
            n, by_id, by_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                by_id.append(hashlib.sha256(" ".join([named[i] for i in ids]).encode()).hexdigest())
                by_text.append(c.decoded_digest(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(by_id, pa.string()), pa.array(by_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
