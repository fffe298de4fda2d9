"""Personal data: pattern spans with exact rules, and spans of a linear-chain conditional random field.

Base spans (kinds email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per
kind; matches that fail their check are dropped and not retried.  They are always kept.  A CRF over
word shapes, trained on a small labelled table (that of pii_table.py, or one that the caller gives), adds
the kinds person, local_phone, spoken_email and secret where they overlap no base span.  It reads the
UTF-8 bytes of a batch at once: tokens, shapes and cue words are found with numpy, and Viterbi runs over
all sentences of the batch together, one position a step.  A sentence is never cut: a long one is
advanced in blocks, each reduced to its matrix of best scores between the labels at both ends, so that
the best path is the same as that of one long pass.

Whole texts are read; a very long one is a batch of its own.  Null texts count as empty: no spans (and
redact() leaves them null).  Rows stand for themselves, so repeated rows give repeated results; columns
other than id and text, whatever their names, are not read.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, cut, slices, word_hashes
from .pii_table import GIVEN_NAMES, Row, labelled_table
from .shared import give_back, ship

BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("person", "local_phone", "spoken_email", "secret")
KINDS = BASE_KINDS + MODEL_KINDS
#: Tokens of a sentence that advances with the others; a longer one goes by itself, in blocks of BLOCK tokens.
LONG = 2048
BLOCK = 128
#: Rows of a labelled table that a model is fitted to, at most.
MOST_ROWS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive: where a run of digits cannot go on, no shorter run can either, so long runs cost one pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, sorted."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- tokens and features -------------------------------------------------------------------------

_KIND = np.full(256, 16, dtype=np.uint8)  # bits: 1 lower, 2 upper, 4 digit, 8 beyond ASCII, 16 mark, 0 blank
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

_MARKS = ".,-()@:+/'\"!?="
_MARK_SHAPE = np.full(256, 11, dtype=np.uint8)
for _k, _c in enumerate(_MARKS):
    _MARK_SHAPE[ord(_c)] = 12 + _k
#: Shapes: 0 lower, 1 Title, 2 UPPER, 3 mixed letters, 4-8 numbers of 1, 2, 3, 4, more digits,
#: 9 letters and digits, 10 the same and LONG_MIX bytes or more, 11 other mark, 12 on the marks above, the last one: no token.
_EDGE = 12 + len(_MARKS)
_SHAPES = _EDGE + 1
LONG_MIX = 16

#: Cue words in classes; class 0 is none of them.
CUES = (
    ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "don", "doña"),
    ("name", "names", "named", "called", "heiße", "heisse", "nom", "appelle", "nombre", "llamo"),
    ("is", "ist", "est", "es", "me", "m", "s"),
    ("my", "mein", "meine", "mon", "ma", "mi", "ich", "je", "our", "his", "her"),
    ("call", "phone", "tel", "telephone", "telefon", "téléphone", "teléfono", "mobile", "fax", "cell", "ruf", "appelez", "llame", "number"),
    ("at", "arobase", "arroba"),
    ("dot", "punkt", "point", "punto"),
    ("com", "org", "net", "de", "fr", "edu", "info"),
    ("mail", "email", "courriel", "correo", "write", "contact"),
    ("key", "api_key", "apikey", "token", "auth_token", "secret", "password", "passwort", "passwd", "passe", "contraseña"),
    ("regards", "signed", "dear", "by", "with", "from", "cordialement", "grüßen", "saludo", "von", "mit", "selon", "con"),
    tuple(sorted({n.lower() for n in GIVEN_NAMES})),
)


_AT, _DOT = (next(k + 1 for k, c in enumerate(CUES) if w in c) for w in ("at", "dot"))


def _hash_words(words: list[str]) -> np.ndarray:
    parts = [w.encode() for w in words]
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    starts = ends - np.array([len(p) for p in parts])
    return word_hashes(LOWER[np.frombuffer(b"".join(parts), dtype=np.uint8)], starts, ends)


_CUE_WORDS = [(w, k + 1) for k, c in enumerate(CUES) for w in c]
_CUE_HASH = _hash_words([w for w, _ in _CUE_WORDS])
_CUE_CLASS = np.array([k for _, k in _CUE_WORDS], dtype=np.int64)[np.argsort(_CUE_HASH, kind="stable")]
_CUE_HASH = np.sort(_CUE_HASH, kind="stable")
_CLASSES = len(CUES) + 1

_WINDOW = (-3, -2, -1, 0, 1, 2, 3)
_STEP = _SHAPES + _CLASSES
_FEATURES = len(_WINDOW) * _STEP


@dataclass
class Tokens:
    """Tokens of a slice: where they stand, their shape and cue class, and the bounds of sentences."""

    starts: np.ndarray
    ends: np.ndarray
    shape: np.ndarray
    cue: np.ndarray
    first: np.ndarray  # first token of each sentence, and the number of tokens

    def features(self) -> list[np.ndarray]:
        """For each place of the window, shape and cue of the token there, none beyond the sentence."""
        n = len(self.starts)
        sentence = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        out = []
        for k, d in enumerate(_WINDOW):
            at = np.clip(np.arange(n) + d, 0, max(n - 1, 0))
            out_of = (at != np.arange(n) + d) | (sentence[at] != sentence)
            base = k * _STEP
            out.append(base + np.where(out_of, _EDGE, self.shape[at]))
            out.append(base + _SHAPES + np.where(out_of, 0, self.cue[at]))
        return out


def tokenize(data: np.ndarray, offs: np.ndarray) -> Tokens:
    """Words (letters and digits together) and single marks, in bytes, cut at every text's bounds."""
    none = np.zeros(0, np.int64)
    kind = _KIND[data]
    word = (kind & 15) > 0
    solid = kind > 0
    if not solid.any():
        return Tokens(none, none, none, none, np.zeros(1, np.int64))
    begin = solid.copy()
    begin[1:] &= ~(word[1:] & word[:-1])
    edge = offs[(offs > 0) & (offs < len(data))]
    begin[edge] = solid[edge]
    starts = np.flatnonzero(begin)
    # a word ends before the next blank, mark or bound
    stop = np.ones(len(data) + 1, dtype=bool)
    stop[1:-1] = ~(word[1:] & word[:-1])
    stop[offs] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    bits = np.bitwise_or.reduceat(kind, starts)  # what lies between tokens is blank and adds nothing
    size = ends - starts
    head = kind[starts]
    rest_upper = np.zeros(len(starts), dtype=bool)
    ups = np.concatenate([[0], np.cumsum(kind == 2)])
    n_up = ups[ends] - ups[starts]
    rest_upper = n_up - (head == 2) > 0
    letters = bits & 11
    shape = np.where(letters == 0, np.where(bits & 4, 3 + np.clip(size, 1, 5), 0), np.where(bits & 4, 9 + (size >= LONG_MIX), 0)).astype(np.int64)
    plain = (letters > 0) & ((bits & 4) == 0)
    shape[plain & (n_up == 0)] = 0
    shape[plain & (head == 2) & ~rest_upper & (size > 1)] = 1
    shape[plain & (n_up == size)] = 2
    shape[plain & (n_up == 1) & (size == 1)] = 1
    shape[plain & (n_up > 0) & (n_up < size) & (rest_upper | (head != 2))] = 3
    mark = bits == 16
    shape[mark] = _MARK_SHAPE[data[starts[mark]]]
    hashes = word_hashes(LOWER[data], starts, ends)
    at = np.minimum(np.searchsorted(_CUE_HASH, hashes), len(_CUE_HASH) - 1)
    cue = np.where((_CUE_HASH[at] == hashes) & ~mark, _CUE_CLASS[at], 0)
    # sentences end at line breaks, at bounds of texts, and after . ! ? before a blank, but for titles and initials
    n = len(starts)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    lines = np.cumsum(data == 10)
    new[1:] = lines[starts[1:]] > lines[ends[:-1] - 1]
    closing = mark & np.isin(data[starts], list(b".!?"))
    titled = np.zeros(n, dtype=bool)
    titled[1:] = ((cue[:-1] == 1) | ((shape[:-1] == 1) & (size[:-1] == 1))) & (ends[:-1] == starts[1:])
    new[1:] |= closing[:-1] & ~titled[:-1] & (starts[1:] > ends[:-1])
    new[np.searchsorted(starts, offs[:-1][offs[:-1] <= starts[-1]])] = True
    return Tokens(starts, ends, shape, cue, np.append(np.flatnonzero(new), n))


# --- the model -----------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in MODEL_KINDS for p in "BI"))
_K = len(LABELS)
_FORBIDDEN = -1e4


def _grammar() -> np.ndarray:
    """0 where label b may follow label a, else a very low score; the last row is the begin."""
    out = np.zeros((_K + 1, _K))
    for b, name in enumerate(LABELS):
        if name[0] == "I":
            out[:, b] = _FORBIDDEN
            out[b - 1, b] = out[b, b] = 0
    return out


@dataclass
class Crf:
    emit: np.ndarray  # feature x label
    move: np.ndarray  # label x label, the last row for the begin

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.starts), _K), dtype=np.float32)
        table = self.emit.astype(np.float32)
        for f in tokens.features():
            out += table[f]
        return out

    def viterbi(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of every token; all sentences advance together, the longest first in order."""
        labels = np.zeros(len(scores), dtype=np.int8)
        size = np.diff(first)
        move = self.move.astype(np.float32)
        for k in np.flatnonzero(size > LONG):
            labels[first[k] : first[k + 1]] = _long_path(scores[first[k] : first[k + 1]], move)
        begin, size = first[:-1][size <= LONG], size[size <= LONG]
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        back, best = [], None
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")  # sentences with more than t tokens
        for t in range(steps):
            s = scores[begin[: live[t]] + t]
            if t == 0:
                best = s + move[-1]
                full = best.copy()
                continue
            via = best[: live[t], :, None] + move[None, :-1, :]
            back.append(via.argmax(axis=1).astype(np.int8))
            best = via.max(axis=1) + s
            full[: live[t]] = best
        if steps:
            now = full.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                labels[begin[: live[t]] + t] = now[: live[t]]
                if t:
                    now[: live[t]] = back[t - 1][np.arange(live[t]), now[: live[t]]]
        return labels


def _long_path(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best path of one long sentence, all its blocks advanced together.

    best[j, a, c] is the best score of block j from label a before it to label c at its end.  A pass over
    the blocks gives the labels between them, a second one, again together, those inside.
    """
    n, k = scores.shape
    step, blocks = move[:-1], -(-(n - 1) // BLOCK)
    # the last block is filled up by places that cost nothing and change no label
    filled = np.zeros((blocks * BLOCK, k), dtype=np.float32)
    filled[: n - 1] = scores[1:]
    filled = filled.reshape(blocks, BLOCK, k)
    over = blocks * BLOCK - (n - 1)
    best = step[None] + filled[:, 0, None, :]
    back = np.zeros((BLOCK, blocks, k, k), dtype=np.int8)
    stay = np.where(np.eye(k, dtype=bool), 0, 2 * _FORBIDDEN).astype(np.float32)
    for t in range(1, BLOCK):
        moves = np.broadcast_to(step, (blocks, k, k))
        if t >= BLOCK - over:
            moves = moves.copy()
            moves[-1] = stay
        via = best[:, :, :, None] + moves[:, None, :, :]
        back[t] = via.argmax(axis=2)
        best = via.max(axis=2) + filled[:, t, None, :]
    vector, into = (scores[0] + move[-1]).astype(np.float64), np.zeros((blocks, k), dtype=np.int64)
    for j in range(blocks):
        via = vector[:, None] + best[j]
        into[j] = via.argmax(axis=0)
        vector = via.max(axis=0)
    edge = np.zeros(blocks + 1, dtype=np.int64)  # the label before each block, and the last one
    edge[-1] = vector.argmax()
    for j in range(blocks - 1, -1, -1):
        edge[j] = into[j, edge[j + 1]]
    out = np.zeros((blocks, BLOCK), dtype=np.int8)
    now, every = edge[1:].copy(), np.arange(blocks)
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = now
        if t:
            now = back[t][every, edge[:-1], now]
    return np.concatenate([[edge[0]], out.reshape(-1)[: n - 1]]).astype(np.int8)


class Examples:
    """Labelled sentences as arrays: features and gold labels of all tokens, and where sentences lie."""

    def __init__(self, rows: list[Row]):
        parts = [text.encode() for text, _ in rows]
        offs = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
        data = np.frombuffer(b"".join(p + b"\n" for p in parts), dtype=np.uint8)
        tok = tokenize(data, offs)
        self.gold = np.zeros(len(tok.starts), dtype=np.int64)
        for base, (text, spans) in zip(offs, rows, strict=False):
            for a, b, kind in spans:
                if kind not in MODEL_KINDS:
                    raise ValueError(f"unknown kind {kind!r}: one of {', '.join(MODEL_KINDS)}")
                a, b = len(text[:a].encode()), len(text[:b].encode())
                inside = np.flatnonzero((tok.starts >= base + a) & (tok.ends <= base + b))
                self.gold[inside] = LABELS.index(f"I-{kind}")
                self.gold[inside[:1]] = LABELS.index(f"B-{kind}")
        self.feats = np.stack(tok.features(), axis=1) if len(tok.starts) else np.zeros((0, 2 * len(_WINDOW)), np.int64)
        # sentences from the longest on, so that those with more than t tokens come first
        size = np.diff(tok.first)
        longest_first = np.argsort(-size, kind="stable")
        self.begin, size = tok.first[:-1][longest_first], size[longest_first]
        self.last = self.begin + size - 1
        self.live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        n = len(self.gold)
        before = np.full(n, _K)
        before[1:] = self.gold[:-1]
        before[tok.first[:-1]] = _K
        self.seen_emit = self._by_feature(np.eye(_K)[self.gold])
        self.seen_move = np.bincount(before * _K + self.gold, minlength=(_K + 1) * _K).reshape(_K + 1, _K).astype(float)

    def _by_feature(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the tokens' weights (one for each label) by feature."""
        flat = self.feats.reshape(-1)
        each = np.repeat(weights, self.feats.shape[1], axis=0)
        return np.stack([np.bincount(flat, each[:, k], minlength=_FEATURES) for k in range(_K)], axis=1)

    def loss_and_slopes(self, emit: np.ndarray, move: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood with the ridge, and its derivatives by emit and move."""
        full = move + _grammar()
        s = emit[self.feats].sum(axis=1)
        alpha, beta, p = np.empty_like(s), np.zeros_like(s), np.empty_like(s)
        want_move = np.zeros_like(move)
        alpha[self.begin] = s[self.begin] + full[-1]
        for t in range(1, len(self.live)):
            at = self.begin[: self.live[t]] + t
            alpha[at] = _log_sum(alpha[at - 1][:, :, None] + full[None, :-1], 1) + s[at]
        total = _log_sum(alpha[self.last], 1)
        for t in range(len(self.live) - 1, 0, -1):
            n = self.live[t]
            at = self.begin[:n] + t
            after = full[None, :-1] + (s[at] + beta[at])[:, None, :]
            beta[at - 1] = _log_sum(after, 2)
            want_move[:-1] += np.exp(alpha[at - 1][:, :, None] + after - total[:n, None, None]).sum(axis=0)
        for t in range(len(self.live)):
            at = self.begin[: self.live[t]] + t
            p[at] = np.exp(alpha[at] + beta[at] - total[: self.live[t], None])
        want_move[-1] = p[self.begin].sum(axis=0)
        gold = s[np.arange(len(self.gold)), self.gold].sum() + (self.seen_move * full).sum()
        loss = total.sum() - gold + ridge / 2 * ((emit * emit).sum() + (move * move).sum())
        return float(loss), self._by_feature(p) - self.seen_emit + ridge * emit, want_move - self.seen_move + ridge * move


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(rows: Iterable[Row], rounds: int = 90, ridge: float = 0.05, caution: float = 0.0) -> Crf:
    """Maximum conditional likelihood with a ridge, by adaptive gradient steps from zero.

    `caution` is added to the score of "no personal data" at each token: precision before recall.

    No rows, or rows without tokens, give a model that finds nothing.
    """
    examples = Examples(list(rows)[:MOST_ROWS])
    emit, move = np.zeros((_FEATURES, _K)), np.zeros((_K + 1, _K))
    if len(examples.gold):
        squares = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
        for _ in range(rounds):
            _, *slopes = examples.loss_and_slopes(emit, move, ridge)
            for w, slope, square in zip((emit, move), slopes, squares, strict=True):
                square += slope * slope
                w -= 0.5 * slope / np.sqrt(square)
    here = _WINDOW.index(0) * _STEP
    emit[here : here + _SHAPES, 0] += caution
    return Crf(emit, np.maximum(move + _grammar(), _FORBIDDEN))


def labelled_rows(table: DataFrame, text_col: str = "text", spans_col: str = "spans") -> list[Row]:
    """Rows of a labelled table text, spans array<struct<start, end, kind>>; MOST_ROWS of them at most, by a hash of the text."""
    found = table.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(spans_col).alias("s")).orderBy(F.xxhash64("t"), "t").limit(MOST_ROWS).collect()
    return [(r["t"], [(x[0], x[1], x[2]) for x in r["s"] or []]) for r in found]


_trained: list[Crf] = []


def trained() -> Crf:
    """The model of the labelled table that comes with the package; the same on every run."""
    if not _trained:
        _trained.append(fit(labelled_table()))
    return _trained[0]


# --- documents -----------------------------------------------------------------------------------


def _formed(tok: Tokens, digits: np.ndarray, kind: str, i: int, j: int) -> tuple[int, int] | None:
    """The part of a decoded span that has the form of its kind, as tokens from i to j: what cannot be one is no span."""
    shape, cue = tok.shape[i:j], tok.cue[i:j]
    if kind == "person":  # words with one capital at the head, and initials
        fits = (shape == 1) | (shape == 12 + _MARKS.index(".")) | (shape == 12 + _MARKS.index("-")) | (shape == 12 + _MARKS.index("'"))
        n = len(fits) if fits.all() else int(fits.argmin())
        while n and shape[n - 1] != 1:
            n -= 1
        return (i, i + n) if 0 < (shape[:n] == 1).sum() <= 4 else None
    if kind == "secret":
        return (i, j) if j - i == 1 and shape[0] == 10 else None
    if kind == "local_phone":
        n = int(digits[tok.ends[j - 1]] - digits[tok.starts[i]])
        return (i, j) if 7 <= n <= 12 else None
    return (i, j) if 4 <= j - i <= 9 and (cue == _AT).sum() == 1 and (cue == _DOT).any() else None


def model_spans(model: Crf, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each text of a slice that has any: (start, kind number, end), in bytes of the text."""
    tok = tokenize(data, offs)
    if not len(tok.starts):
        return {}
    labels = model.viterbi(model.scores(tok), tok.first)
    heads = np.flatnonzero((labels > 0) & (labels % 2 == 1))
    if not len(heads):
        return {}
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i in heads:
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        kind = (int(labels[i]) - 1) // 2
        part = _formed(tok, digits, MODEL_KINDS[kind], int(i), int(j))
        if part:
            text = int(np.searchsorted(offs, tok.starts[i], side="right")) - 1
            a, b = part
            out.setdefault(text, []).append((int(tok.starts[a] - offs[text]), len(BASE_KINDS) + kind, int(tok.ends[b - 1] - offs[text])))
    return out


def find_spans(model: Crf, column: pa.Array) -> Iterator[tuple[str, list, list]]:
    """text, base spans and all spans of every row, as (start, kind number, end) in code points."""
    texts = column.to_pylist()
    for lo, hi, data, offs in slices(column, 1 << 20):
        found = model_spans(model, data, offs)
        for i in range(lo, hi):
            text = texts[i] or ""
            base = base_spans(text)
            spans = base
            if i - lo in found:
                raw = data[offs[i - lo] : offs[i - lo + 1]]
                place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                more = [(int(place[a]), k, int(place[b])) for a, k, b in found[i - lo]]
                free = [m for m in more if not any(m[0] < b and a < m[2] for a, _, b in base)]
                spans = sorted(base + free)
            yield text, base, spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Crf | None = None) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans and their number, of every row."""
    ship(docs.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            counts, digests, joined, found = [[] for _ in BASE_KINDS], [], [], []
            for _, base, spans in find_spans(model, b.column(1)):
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
                found.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(found, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or group of overlapping spans, replaced by the kind of its first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kind, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """docs with all spans of text_col masked; null texts stay null, other columns as they are."""
    ship(docs.sparkSession)
    model = model or trained()
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, at):
            column = b.column(at)
            new = [None if null else mask(t, s) for (t, _, s), null in zip(find_spans(model, column), column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
