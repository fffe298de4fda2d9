"""N-gram Jaccard join of whole texts: exact links, found through signature trees.

A document's set holds its distinct 5-word shingles (ASCII-lower-cased words; fewer words: the whole
sequence as one).  Documents link at Jaccard 0.8 or more, in integers: 100 * overlap >= 80 * union.
Shingles are known by 64-bit hashes, sets by 128 bits (96 on the way through steps 2 and 3) and, once they are
counted, by a number.

1. Sets.  Each text is reduced to a digest of its set and the set's size; documents of equal sets are
   one node from here on (a third of all rows may be copies of one text: they are one node, and what
   a task has seen it does not send again).  The same pass counts shingles window by window; one that is
   met FEW times or more in a window may be frequent, all others are so rare that no task chokes on them.
2. Frequencies.  Shingles are dealt out in packed blobs by their hash, so many to a task whatever the corpus;
   a shingle met in two nodes or more goes on, with its frequency.  Frequent ones (a bounded list) are dealt out by node instead, with
   the frequency that the first pass found: no shingle, however common, is gathered in one task.
3. Prefixes.  If sets are ordered by (frequency, hash), two linked sets of size n share a shingle among
   their first n - ceil(0.8 n) + 1.  Those met in one node only cannot be shared, so most nodes drop out.
4. Families.  Nodes sharing a prefix shingle at sizes that can be linked are put in one family: a
   superset of the links, as stars, so never all pairs of a group.
5. Trees.  Each family's sets go through a signature tree (signature_tree.py).  A large family is dealt
   out in blocks, each treated with the first one, which mostly links it all.  What is not linked then is
   compared within the (prefix shingle, size) buckets that hold sets of different components, each set of
   members once: a family that grew by chains of unrelated sets costs its buckets, not its square.
6. Components of the links found.

Any order of shingles gives the same links, so hash collisions in step 2 cost time, not results.
Null or empty texts have no shingles and link with nothing.  A very long text is one set, as large as the
text.  Rows with a null id take no part and get a null component.  Rows that repeat an id are kept each, and
belong to the components of their own texts; rows equal in id and text are compared once.  Ties do not arise:
links are exact.  Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import set_key, shingle_sets, slices
from .components import components
from .shared import discard, parallel, ship, written
from .signature_tree import SignatureTree

GROUP_SHINGLES = 2_000_000  # shingles that one task sorts at once
FLUSH_SHINGLES = 1_000_000  # shingles that a task packs at once
WINDOW_SHINGLES = 2_000_000  # shingles that the first pass counts at once
FEW = 4  # times that a shingle is met in a window before it is reported
FREQUENT = 1_000_000  # reports that make a shingle frequent, at least
MOST_FREQUENT = 1 << 20  # frequent shingles, at most: the bound grows with the corpus instead
PARTS_AT_ONCE = 4_096  # parts that blobs are dealt to in one step; more are dealt to in two
FAMILY_SHINGLES = 1_500_000  # shingles of one block of a family
FAMILY_SETS = 64
BUCKET_SETS = 256  # sets of one block of a bucket
_SEEN = 1 << 20


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), [len(values)]]) if len(values) else np.zeros(1, np.int64)


# --- packed blobs: entries (node, values) of many nodes in few rows ---------------------------------

_BLOBS = "part int, keys binary, ns binary, counts binary, hashes binary, dfs binary"
_BLOB_NAMES = ["part", "keys", "ns", "counts", "hashes", "dfs"]
_KEY = 12  # bytes of a set's digest that are dealt out
_SHORT = 5  # bytes of a shingle's hash that tell it from the others of its part
_SHORT_MASK = np.uint64((1 << 8 * _SHORT) - 1)


def _narrow(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


class Entries:
    """Shingles with the node each belongs to: keys and sizes ns by node, owner and hashes by entry, dfs by entry or None."""

    def __init__(self, keys: np.ndarray, ns: np.ndarray, owner: np.ndarray, hashes: np.ndarray, dfs: np.ndarray | None = None):
        self.keys, self.ns, self.owner, self.hashes, self.dfs = keys, ns, owner, hashes, dfs

    @classmethod
    def of_sets(cls, sets: list[tuple[bytes, int, np.ndarray]], dfs: list[np.ndarray] | None = None) -> Entries:
        """Of (key, size, hashes) of each node."""
        lens = [len(h) for _, _, h in sets]
        keys = np.frombuffer(b"".join(k[:_KEY] for k, _, _ in sets), dtype=np.uint8).reshape(-1, _KEY)
        flat = np.concatenate([h for _, _, h in sets]) if sets else np.zeros(0, np.uint64)
        return cls(keys, np.array([n for _, n, _ in sets], dtype=np.int64), np.repeat(np.arange(len(sets)), lens), flat, np.concatenate(dfs) if dfs else None)

    @classmethod
    def of_rows(cls, rows: pa.Table, width: int = 8) -> Entries:
        """Unpacked, with one number a node, whatever rows it came in; hashes were written in `width` bytes."""
        joined = lambda name: b"".join(x.as_py() for x in rows.column(name))
        column = lambda name: np.frombuffer(joined(name), dtype=np.uint32)
        keys = np.frombuffer(joined("keys"), dtype=np.uint8).reshape(-1, _KEY)
        low, high = keys[:, :8].copy().view(np.uint64).reshape(-1), keys[:, 8:].copy().view(np.uint32).reshape(-1)
        order = np.lexsort((high, low))
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        number = np.empty(len(keys), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        dfs = column("dfs")
        return cls(keys[order][fresh], column("ns")[order][fresh].astype(np.int64), np.repeat(number, column("counts")), _wide(joined("hashes"), width), dfs if len(dfs) else None)

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.keys, self.ns, self.owner[at], self.hashes[at], None if self.dfs is None else self.dfs[at])

    def low(self) -> np.ndarray:
        """64 bits of each entry's node."""
        return self.keys[:, :8].copy().view(np.uint64).reshape(-1)[self.owner]

    def packed(self, part: np.ndarray, width: int = 8) -> pa.RecordBatch:
        """One row for each part that occurs."""
        order = np.lexsort((self.owner, part))
        part, e = part[order], self.take(order)
        rows: list[list] = [[] for _ in _BLOB_NAMES]
        cut = _runs(part)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            runs = _runs(e.owner[a:b])
            nodes = e.owner[a:b][runs[:-1]]
            dfs = b"" if e.dfs is None else e.dfs[a:b].astype(np.uint32).tobytes()
            values = (int(part[a]), e.keys[nodes].tobytes(), e.ns[nodes].astype(np.uint32).tobytes(), np.diff(runs).astype(np.uint32).tobytes(), _narrow(e.hashes[a:b], width), dfs)
            for out, x in zip(rows, values, strict=True):
                out.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=_BLOB_NAMES)


def _even_labels(parts: int) -> np.ndarray:
    """A label for each part, all of which Spark's hash of an integer deals to partitions of their own.

    Were that hash another one, parts would only lie less evenly.
    """
    out = np.full(parts, -1, dtype=np.int64)
    lo, step = 0, max(1024, 4 * parts)
    rotated = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    with np.errstate(over="ignore"):
        while (out < 0).any() and lo + step < 1 << 31:
            label = np.arange(lo, lo + step, dtype=np.uint32)
            # Murmur3 of one 32-bit number with the seed 42
            h = np.uint32(42) ^ rotated(label * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = (rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            place = (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % parts
            place, first = np.unique(place, return_index=True)
            free = out[place] < 0
            out[place[free]] = label[first[free]]
            lo += step
    left = np.flatnonzero(out < 0)
    out[left] = (1 << 31) - 1 - np.arange(len(left))
    return out.astype(np.int32)


def _by_hash(e: Entries, parts: int) -> tuple[np.ndarray, Entries]:
    """Each entry's part, and the entries with what tells their shingles apart within a part."""
    part = (e.hashes % np.uint64(parts)).astype(np.int32)
    return part, Entries(e.keys, e.ns, e.owner, (e.hashes // np.uint64(parts)) & _SHORT_MASK, e.dfs)


def _tokens(part: np.ndarray, short: np.ndarray) -> np.ndarray:
    """One number for a shingle, from its part and what tells it from others there."""
    return part.astype(np.uint64) << np.uint64(8 * _SHORT) | short


def _by_node(e: Entries, parts: int) -> np.ndarray:
    return (e.low() % np.uint64(parts)).astype(np.int32)


# --- sets and frequent shingles ---------------------------------------------------------------------

_KEYED = "doc_id long, text_key long, n_shingles long, k1 long, k2 long"


def shingle_keys(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles and the two halves k1, k2 of the set digest, of docs(doc_id, text, text_key).

    Rows of n_shingles < 0 are reports: a shingle, k1, and how often it was met in a window, -n_shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def reports() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found, times = found[times >= FEW].view(np.int64), times[times >= FEW]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(-times), pa.array(found), none], names=["doc_id", "text_key", "n_shingles", "k1", "k2"])

        for b in batches:
            n, keys = [], []
            for _, _, data, offs in slices(b.column(1)):
                for s in shingle_sets(data, offs, width):
                    n.append(len(s))
                    keys.append(set_key(s))
                    if keys[-1] not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(keys[-1])
                        held.append(s)
                        size += len(s)
            halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc_id", "text_key", "n_shingles", "k1", "k2"],
            )
            if size >= WINDOW_SHINGLES:
                yield reports()
                held, size = [], 0
        if held:
            yield reports()

    return docs.mapInArrow(run, _KEYED)


def frequent_shingles(keyed: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are met very often, sorted, and how often they were reported.

    Each takes at least total / MOST_FREQUENT of the shingles, so there are at most MOST_FREQUENT.
    """
    least = max(FREQUENT, total // MOST_FREQUENT)
    times = keyed.filter("n_shingles < 0").groupBy("k1").agg((-F.sum("n_shingles")).alias("n")).filter(F.col("n") >= least)
    rows = sorted((np.uint64(r["k1"] & (1 << 64) - 1), r["n"]) for r in times.limit(MOST_FREQUENT).collect())
    return np.array([k for k, _ in rows], dtype=np.uint64), np.array([min(n, (1 << 32) - 1) for _, n in rows], dtype=np.uint32)


# --- prefixes ---------------------------------------------------------------------------------------


def _prefixes(docs: DataFrame, total: int, tasks: int, width: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, k1, high, n: the prefix shingles that at least two nodes hold (steps 2 and 3); high is the low half of k2."""
    parts = max(tasks, -(-total // GROUP_SHINGLES))
    buckets = max(tasks, parts // 4)
    each = -(-parts // PARTS_AT_ONCE)  # parts of one first part, if there are two steps
    # what rows are dealt by: a number for each part that brings it to a partition of its own
    label, bucket_label = _even_labels(parts), _even_labels(buckets)
    common, common_df = frequent

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[bytes, int, np.ndarray]] = []
        often: list[tuple[bytes, int, np.ndarray]] = []
        often_df: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            e = Entries.of_sets(held)
            part, short = _by_hash(e, parts)
            yield short.packed(label[part], _SHORT) if each == 1 else e.packed(part // each)
            if often:
                e = Entries.of_sets(often, often_df)
                part, short = _by_hash(e, parts)
                e.hashes = _tokens(part, short.hashes)
                yield e.packed(label[_by_node(e, parts)] if each == 1 else _by_node(e, parts) // each)

        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                for s in shingle_sets(data, offs, width):
                    k = set_key(s)
                    if not len(s) or k in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(k)
                    size += len(s)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        hit = common[at] == s
                        if hit.any():
                            often.append((k, len(s), s[hit]))
                            often_df.append(common_df[at[hit]])
                        held.append((k, len(s), s[~hit]))
                    else:
                        held.append((k, len(s), s))
                    if size >= FLUSH_SHINGLES:
                        yield from flush()
                        held, often, often_df, size = [], [], [], 0
        if held:
            yield from flush()

    def deal_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From first parts to parts, a bounded number of shingles at a time."""
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            alone = pa.array([len(x.as_py()) == 0 for x in rows.column("dfs")], pa.bool_())
            for mine, single in ((rows.filter(alone), True), (rows.filter(pc.invert(alone)), False)):
                if len(mine):
                    e = Entries.of_rows(mine)
                    part, short = _by_hash(e, parts)
                    yield short.packed(label[part], _SHORT) if single else e.packed(label[_by_node(e, parts)])

        for b in batches:
            for k in range(len(b)):
                held.append(b.slice(k, 1))
                size += len(b.column(4)[k].as_py()) // 8
                if size >= FLUSH_SHINGLES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def shared(t: pa.Table) -> pa.Table:
        alone = pa.array([len(x.as_py()) == 0 for x in t.column("dfs")], pa.bool_())
        out = []
        rows = t.filter(alone)
        if len(rows):
            e = Entries.of_rows(rows, _SHORT)
            part = np.flatnonzero(label == rows.column("part")[0].as_py())
            e.hashes = _tokens(np.full(len(e.hashes), part[0]), e.hashes)
            e = e.take(np.argsort(e.hashes, kind="stable"))
            times = np.diff(_runs(e.hashes))
            e = e.take(np.flatnonzero(np.repeat(times > 1, times)))
            e = e.take(np.lexsort((e.owner, e.hashes)))  # what several tasks have sent of one node counts once
            fresh = np.ones(len(e.hashes), dtype=bool)
            fresh[1:] = (e.hashes[1:] != e.hashes[:-1]) | (e.owner[1:] != e.owner[:-1])
            e = e.take(np.flatnonzero(fresh))
            times = np.diff(_runs(e.hashes))
            e.dfs = np.repeat(times, times).astype(np.uint32)
            e = e.take(np.flatnonzero(e.dfs > 1))
            if len(e.hashes):
                out.append(e.packed(bucket_label[_by_node(e, buckets)]))
        rows = t.filter(pc.invert(alone))
        if len(rows):
            e = Entries.of_rows(rows)
            out.append(e.packed(bucket_label[_by_node(e, buckets)]))
        return pa.Table.from_batches(out) if out else t.slice(0, 0).select(_BLOB_NAMES)

    def prefix(t: pa.Table) -> pa.Table:
        e = Entries.of_rows(t)
        e = e.take(np.lexsort((e.hashes, e.dfs, e.owner)))
        fresh = np.ones(len(e.hashes), dtype=bool)
        fresh[1:] = (e.hashes[1:] != e.hashes[:-1]) | (e.owner[1:] != e.owner[:-1])
        e = e.take(np.flatnonzero(fresh))
        runs = _runs(e.owner)
        held = np.diff(runs)
        rank = np.arange(len(e.owner)) - np.repeat(runs[:-1], held)
        n = e.ns[e.owner]
        length = n + (-num * n) // den + 1  # n - ceil(num * n / den) + 1
        keep = rank < length - (n - np.repeat(held, held))  # shingles of one node only come first
        keys = e.keys[e.owner[keep]]
        low, high = keys[:, :8].copy().view(np.int64).reshape(-1), keys[:, 8:].copy().view(np.uint32).reshape(-1).astype(np.int64)
        return pa.table([pa.array(e.hashes[keep].view(np.int64)), pa.array(low), pa.array(high), pa.array(n[keep])], names=["token", "k1", "high", "n"])

    dealt = docs.select("text").mapInArrow(deal, _BLOBS)
    if each > 1:
        dealt = dealt.repartition(tasks, "part").mapInArrow(deal_on, _BLOBS)
    # as many tasks as parts, however many the session asks for: a task's share does not grow with the corpus
    both = dealt.repartition(parts, "part").groupBy("part").applyInArrow(shared, _BLOBS)
    return both.repartition(buckets, "part").groupBy("part").applyInArrow(prefix, "token long, k1 long, high long, n long")


# --- families and trees -----------------------------------------------------------------------------


def _families(prefixes: DataFrame) -> DataFrame:
    """node, family: nodes that share a prefix shingle and whose sizes allow a link (step 4)."""
    heads = written(prefixes.groupBy("token", "grade").agg(F.min("node").alias("head")), "heads")
    within = prefixes.join(heads, ["token", "grade"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    after = heads.select("token", (F.col("grade") - 1).alias("grade"), F.col("head").alias("b"))
    across = heads.join(after, ["token", "grade"]).select(F.col("head").alias("a"), "b")
    found = components(within.filter("a <> b").distinct().union(across.filter("a <> b").distinct()))
    return found.select("node", F.col("component").alias("family"))


def _tree_links(num: int, den: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        nodes = group["node"].tolist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        roots = SignatureTree(sets, num, den, group["label"].tolist()).roots()
        links = [(nodes[i], nodes[r]) for i, r in enumerate(roots) if i != r]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _blocks(n_shingles, n_sets, sets: int):
    """Blocks of a group of so many shingles and sets, of at most `sets` sets each."""
    return F.ceil(F.greatest(n_shingles / FAMILY_SHINGLES, n_sets / F.lit(sets))).cast("int")


def _tree_join(docs: DataFrame, nodes: DataFrame, prefixes: DataFrame, families: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b: links that join all linked nodes of each family (step 5)."""
    members = nodes.join(families, "node")
    blocks = written(members.groupBy("family").agg(_blocks(F.sum("n_shingles"), F.count("*"), FAMILY_SETS).alias("blocks")), "blocks")
    members = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat an id lie together: a set goes on once
        for b in batches:
            wanted = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)], axis=1).astype(np.int64)
            nodes, at, found = b.column(0).to_pylist(), 0, []
            keep = np.zeros(len(b), dtype=bool)
            for _, _, data, offs in slices(b.column(6)):
                for s in shingle_sets(data, offs, width):
                    # an id that is repeated with another text brings sets of other keys
                    if nodes[at] not in done and set_key(s) == wanted[at].tobytes():
                        done.add(nodes[at])
                        keep[at] = True
                        found.append(s.tobytes())
                    at += 1
            rows = pa.RecordBatch.from_arrays(b.columns[:4], names=["node", "family", "blocks", "block"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], names=[*rows.schema.names, "shingles"])

    chosen = members.select("doc_id", "node", "family", "blocks", "block", "k1", "k2")
    texts = docs.join(chosen, "doc_id").select("node", "family", "blocks", "block", "k1", "k2", "text")
    full = written(texts.mapInArrow(sets, "node long, family long, blocks int, block int, shingles binary"), "sets")

    spread = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    run = _tree_links(num, den)
    first = written(
        full.select("family", F.explode(spread).alias("at"), "node", F.col("node").alias("label"), "shingles").groupBy("family", "at").applyInPandas(run, "a long, b long"),
        "tree-links",
    )
    large = blocks.filter("blocks > 1").select("family")
    if large.isEmpty():
        return first

    # Large families: buckets of a prefix shingle and two neighbouring grades of size hold all links that are left.
    labels = written(
        members.join(large, "family").select("node", "n_shingles").join(components(first), "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("label")), "labels"
    )
    rows = prefixes.select("token", F.explode(F.array(F.col("grade"), F.col("grade") - 1)).alias("grade"), "node").join(labels, "node")
    rows = written(rows, "bucket-rows")
    stats = rows.groupBy("token", "grade").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"), F.sum("n_shingles").alias("size"),
    )
    once = stats.filter("least <> most").groupBy("n", "x1", "x2", "size").agg(F.min(F.struct("token", "grade")).alias("b"))
    mixed = written(once.select("b.token", "b.grade", _blocks(F.col("size"), F.col("n"), BUCKET_SETS).alias("blocks")).withColumn("bucket", F.monotonically_increasing_id()), "mixed-buckets")
    if mixed.isEmpty():
        return first
    held = written(rows.join(mixed, ["token", "grade"]).select("bucket", "blocks", "node", "label", "n_shingles"), "bucket-members")
    most = held.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    rest = held.join(most, "bucket").filter("label <> most")
    heaps = written(rest.groupBy("bucket").agg(_blocks(F.sum("n_shingles"), F.count("*"), BUCKET_SETS).alias("heaps")), "heaps")
    blobs = full.select("node", "shingles")
    # whoever has another label than most of a bucket meets all of it
    rest = rest.join(heaps, "bucket").withColumn("heap", F.pmod(F.xxhash64("node", F.lit(2)), F.col("heaps")).cast("int"))
    ours = rest.select("bucket", "heap", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "node", "label")
    theirs = held.join(heaps, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("heap"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("at"), "node", "label"
    )
    second = ours.union(theirs).join(blobs, "node").groupBy("bucket", "heap", "at").applyInPandas(run, "a long, b long")
    return first.union(written(second, "tree-links"))


# --- documents --------------------------------------------------------------------------------------


def component_rows(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and component of every row.

    text_key is a hash of the text.  component is the same for all rows of a component and for no others;
    null where there are no shingles or there is no id.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    keyed = written(shingle_keys(docs, width), "keys")
    rows = keyed.filter("n_shingles >= 0")
    with_id = rows.filter("doc_id is not null and n_shingles > 0")
    docs = docs.filter("doc_id is not null and text is not null")
    nodes = with_id.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    found = _prefixes(docs, total, parallel(spark), width, num, den, frequent_shingles(keyed, total))
    # sizes of one grade, or of neighbouring ones, are those that a link allows
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num * 1.0000001))).cast("int")
    keys = nodes.select("k1", F.col("k2").bitwiseAND(F.lit(0xFFFFFFFF)).alias("high"), "node")
    prefixes = written(written(found, "prefix-keys").join(keys, ["k1", "high"]).select("token", "node", grade.alias("grade")), "prefixes")
    families = written(_families(prefixes), "families")
    links = _tree_join(docs, nodes, prefixes, families, width, num, den)
    joined = written(components(links), "components")
    least = nodes.join(joined, "node").select("node", "component", "doc_id")
    heads = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = least.join(heads, "component").select("node", "component", "component_id")
    of_key = nodes.join(linked, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    of_key = written(of_key, "of-key")
    discard(nodes, prefixes, families, joined)
    alone = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return with_id.join(of_key, ["k1", "k2"]).select("doc_id", "text_key", "n_shingles", "component_id", "component").union(alone)


def ngram_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable over links of Jaccard num/den."""
    return component_rows(docs, num, den, width, text_col, id_col).select("doc_id", "n_shingles", "component_id")


def drop_linked(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of its texts the one of the smallest hash.

    Rows that share an id but not a component are judged each by its own; rows equal in id and text are
    one, also where there are no words.  Rows without an id stay, all of them.
    """
    rows = component_rows(docs, num, den, width, text_col, id_col).filter("doc_id is not null")
    heads = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("h")).select("h.doc_id", "h.text_key")
    wordless = rows.filter("component is null").select("doc_id", "text_key").distinct()
    stay = heads.union(wordless).toDF("_id", "_key").hint("merge")
    keyed = docs.withColumns({"_own": F.col(id_col).cast("long"), "_text": F.xxhash64(text_col)})
    kept = keyed.join(stay, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = F.row_number().over(Window.partitionBy("_own", "_text").orderBy(*(others or [text_col])))
    once = kept.withColumn("_first", first).filter("_first = 1").select(*docs.columns)
    return once.union(docs.filter(F.col(id_col).isNull()))
