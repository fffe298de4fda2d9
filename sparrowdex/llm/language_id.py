"""Language identification by string kernels.

A text is the set of its byte n-grams, n = 1 to 4, over lower-cased letters (presence, not counts: a
blended spectrum).  The kernel of two texts is the size of the common part over the geometric mean of
the set sizes.  Kernel ridge regression, one class against the rest, is fitted on Nystroem features
over landmark texts.  A prediction is the product of a batch's presence rows with the landmarks'
presence rows, already multiplied by their coefficients: kernel and regression in one product.

Whole texts are read, a very long one in segments.  A text that is null or has no letter is `und` with
score 0.  Learning takes at most MOST_ROWS rows, the same number of each language and PER_LANGUAGE at most:
those that come first by a hash of id and text, each id and text once, whatever their order or repeats; rows
with a null language, text or id do not teach.  Repeated rows are predicted alike.  With nothing to learn from,
everything is `und`.  Columns other than those named, whatever they are called, are kept or left as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import cut
from .shared import ship

PER_LANGUAGE = 300
LANDMARKS = 256
MOST_ROWS = 19_200
RIDGE = 1e-2
_BATCH_BYTES = 1 << 20
_SEGMENT = 1 << 22

#: Values that the draw of a row can take.
_STEPS = 1 << 40

#: Buckets of the n-grams of each length.
_WIDTHS = {1: 256, 2: 4096, 3: 8192, 4: 8192}
_SIZE = sum(_WIDTHS.values())

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram bucket x language


def presence(texts: list[str]) -> np.ndarray:
    """texts x buckets, 1 where the text has an n-gram of the bucket."""
    parts = [t.lower().encode() for t in texts]
    out = np.zeros((len(parts), _SIZE), dtype=np.uint8)
    flat = out.reshape(-1)
    whole = np.frombuffer(b"".join(parts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    longest = max(_WIDTHS)
    for lo in range(0, len(whole), _SEGMENT):
        data = _FOLD[whole[lo : lo + _SEGMENT + longest - 1]].astype(np.uint32)
        at = np.arange(lo, lo + len(data))
        sizes = np.diff(np.clip(bounds, lo, lo + len(data)))
        row, ends = np.repeat(np.arange(len(parts)) * _SIZE, sizes), np.repeat(bounds[1:], sizes)
        code, base = data, 0
        for n, width in _WIDTHS.items():
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
            k = len(code)
            bucket = code if n == 1 else ((code * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(width)
            inside = at[:k] + n <= ends[:k]
            flat[(row[:k] + base + bucket)[inside]] = 1
            base += width
    return out


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = (np.sqrt(np.maximum(a.sum(axis=1), 1)) for a in (x, y))
    return (x @ y.T) / nx[:, None] / ny[None, :]


def _unpacked(rows: list[tuple[str, bytes]]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :_SIZE].astype(np.float32)


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: language and packed presence row, in a fixed order.  They stay packed but for the landmarks and a few at a time."""
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    number = {k: i for i, k in enumerate(names)}
    label = np.array([number[r[0]] for r in rows])
    # every k-th row: all languages come in proportion, as rows come sorted by language
    chosen = _unpacked([rows[i] for i in np.unique(np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int))])
    values, vectors = np.linalg.eigh(_kernel(chosen, chosen).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    # classes weigh the same whatever their size
    size = np.bincount(label)
    weight = (1 / size)[label]
    weight = weight / weight.mean()
    gram, right = np.zeros((keep.sum() + 1,) * 2), np.zeros((keep.sum() + 1, len(names)))
    for lo in range(0, len(rows), 256):
        part = slice(lo, lo + 256)
        phi = _kernel(_unpacked(rows[part]), chosen) @ whiten
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.where(label[part, None] == np.arange(len(names))[None, :], 1.0, -1.0)
        gram += (phi * weight[part, None]).T @ phi
        right += (phi * weight[part, None]).T @ y
    coef = np.linalg.solve(gram + ridge * len(rows) * np.eye(len(gram)) / len(names), right)
    alpha = (whiten @ coef[:-1]) / np.sqrt(np.maximum(chosen.sum(axis=1), 1))[:, None]
    return Model(names, np.vstack([chosen.T @ alpha, coef[-1:]]).astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    todo = [i for i, t in enumerate(texts) if t and has_letter(t)]
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size < _BATCH_BYTES) and end - at < 256:
            size += len(texts[todo[end]])
            end += 1
        x = presence([texts[i] for i in todo[at:end]]).astype(np.float32)
        f = (x @ model.weights[:-1]) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] + model.weights[-1]
        best = f.argmax(axis=1)
        for i, b, s in zip(todo[at:end], best, np.clip((f.max(axis=1) + 1) / 2, 0, 1), strict=True):
            names[i], scores[i] = model.languages[b], float(s)
        at = end
    return names, scores


def train(docs: DataFrame, teaches: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the rows of docs for which `teaches` holds."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(teaches & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(_STEPS)).alias("draw")
    known = known.select(F.col(lang_col).cast("string").alias("lang"), draw, F.col(text_col).alias("text"))
    # rows that repeat count once here, so that they take no place of others
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_ROWS).collect()
    if not sizes:
        return None
    per_language = max(1, min(per_language, MOST_ROWS // len(sizes)))
    # a little more than wanted, by hash; what is over is left out below
    shares = [(r["lang"], min(_STEPS, int(_STEPS * 1.5 * (per_language + 20) / r["n"]))) for r in sizes]
    shares = spark.createDataFrame(shares, "lang string, share long")
    # one row for each language, MOST_ROWS at most
    sample = known.join(F.broadcast(shares), "lang").filter("draw < share").select("lang", "draw", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in cut(batches, 2):
            out = []
            for lang, drawn, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (lang, drawn) not in seen and has_letter(text):
                    seen.add((lang, drawn))
                    out.append((lang, drawn, np.packbits(presence([text])[0]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "draw", "bits"])

    got = sample.mapInArrow(features, "lang string, draw long, bits binary").distinct().collect()
    rows, taken = [], dict.fromkeys((r["lang"] for r in sizes), 0)
    for r in sorted(got, key=lambda r: (r["lang"], r["draw"], bytes(r["bits"]))):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            rows.append((r["lang"], bytes(r["bits"])))
    return fit(rows)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (all if None) of docs, with lang_pred and score."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names = [*keep, *([] if text_col in keep else [text_col])]
    at = names.index(text_col)
    source = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(names)])
    schema = ", ".join(f"_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, at):
            found, scores = predict(model, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[: len(keep)], "lang_pred", "score"]
            )

    out = source.mapInArrow(run, f"{schema}, lang_pred string, score double" if keep else "lang_pred string, score double")
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that never teaches."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
