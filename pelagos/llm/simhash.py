"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. Of at most four errors in all, pigeonholing
leaves either one segment without error and another with one at most, or exactly one error in each. So a
fingerprint gets keys of two kinds: a segment's bits as they are with one Golay key of another segment
(every ordered pair of segments), and the Golay keys of the first three segments, where it is enough that
of two fingerprints one brings all keys of the first segment with the nearest of the other two, and
the other the reverse. Fingerprints that share a key are compared bit by bit.

Keys are sorted within hash partitions and read as a stream: runs of one key up to RUN_ROWS are
solved at once, longer ones are dealt out as pairs of blocks and solved the same way, so no task
holds more than two blocks and no pair is lost. A run yields a spanning forest of its links instead of all of
them, which is enough for components.

Defined cases: null text is empty; a text without words has fingerprint 0 and is linked like any other;
fewer words than a shingle make one shingle; repeated rows and equal texts share a fingerprint and a
component; null ids do not count for a component's smallest id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.operators.graph import connected_components

from . import golay
from .common import WORD_BYTES, materialise, sliced, table

SHINGLE, TOLERANCE, SEED = 4, 4, 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Rows of one key that a task solves at once; runs up to PAIR_ROWS are compared shift by shift.
RUN_ROWS, PAIR_ROWS = 20_000, 64


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; fewer words are one shingle, none give none."""
    words = WORD_BYTES.findall((text or "").encode("utf-8").lower())
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit is 1 where over half of the 64-bit hashes have it; as a signed number. 0 for no hashes."""
    if not hashes:
        return 0
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def text_fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    h = xxhash.xxh64_intdigest
    return fingerprint([h(s, seed) for s in shingles(text, size)])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [text_fingerprint(t, size, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def fuzzy_keys(fp: np.ndarray, spread: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of both kinds, or with ``spread=False`` those of an exact with a fuzzy segment only."""
    bits = fp.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(SEGMENT_BITS * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    table_ = golay.key_table(SEGMENT_BITS)
    near = [table_[p].astype(np.int64) for p in parts]
    rows, keys = [], []

    def add(tag: int, key: np.ndarray, *found: np.ndarray) -> None:
        good = np.ones(key.shape, bool)
        for x in found:
            good &= x != golay.NO_KEY
        at = np.nonzero(good)
        rows.append(at[0])
        keys.append((key | tag << 56)[at])

    for i in range(SEGMENTS):
        for j in range(SEGMENTS):
            if i != j:
                add(i * SEGMENTS + j, parts[i][:, None] << 12 | near[j], near[j])
    if spread:
        one, two, three = near[:3]
        add(SEGMENTS**2, one << 24 | two[:, :1] << 12 | three[:, :1], one)
        left, right = two[:, :, None], three[:, None, :]
        own = one[:, :1, None] << 24 | left << 12 | right
        twice = (left == two[:, :1, None]) & (right == three[:, :1, None])  # the row above has it already
        add(SEGMENTS**2, own, left, np.broadcast_to(right, own.shape), np.where(twice, golay.NO_KEY, 0))
    return np.concatenate(rows), np.concatenate(keys)


def key_rows(nodes: DataFrame, columns: tuple[str, ...] = ("fp",), spread: bool = True) -> DataFrame:
    """(key, fp, node): the keys of each fingerprint column of ``nodes`` (node, ...); a column's number goes into the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            node = b.column(0).to_numpy()
            for n in range(len(columns)):
                fp = b.column(1 + n).to_numpy()
                row, key = fuzzy_keys(fp, spread)
                yield pa.RecordBatch.from_arrays([pa.array(key | n << 61), pa.array(fp[row]), pa.array(node[row])], names=["key", "fp", "node"])

    return nodes.select("node", *columns).mapInArrow(run, "key long, fp long, node long")


def _near(fp: np.ndarray, one: np.int64, tolerance: int) -> np.ndarray:
    return np.bitwise_count((fp ^ one).view(np.uint64)) <= tolerance


def spanning_links(fp: np.ndarray, node: np.ndarray, label: np.ndarray, tolerance: int) -> tuple[list, list]:
    """A spanning forest of the links between all rows, by breadth-first search over those not yet reached."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _near(fp[left], fp[at], tolerance)
            found = left[hit]
            if len(found):
                a.append(np.full(len(found), node[at]))
                b.append(node[found])
                queue.extend(found.tolist())
                left = left[~hit]
    return a, b


def _pairs_in(fp: np.ndarray, tolerance: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, bits) of a long run's pairs within tolerance that are wanted, block by block."""
    for at in range(0, len(fp), 512):
        own = np.arange(at, min(at + 512, len(fp)))
        bits = np.bitwise_count((fp[own][:, None] ^ fp[None, :]).view(np.uint64))
        x, y = np.nonzero(bits <= tolerance)
        keep = (own[x] != y) & wanted(own[x], y)
        yield own[x[keep]], y[keep], bits[x[keep], y[keep]]


def _least(x: np.ndarray, y: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs are among the ``most`` nearest of their x, ties to the smaller y."""
    order = np.lexsort((y, bits, x))
    first = np.concatenate([[True], x[order][1:] != x[order][:-1]]) if len(x) else np.zeros(0, bool)
    rank = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    keep = np.zeros(len(x), bool)
    keep[order] = rank < most
    return keep


def nearest_links(fp: np.ndarray, node: np.ndarray, label: np.ndarray, tolerance: int, most: int) -> tuple[list, list]:
    """Each row's links to its ``most`` nearest rows."""
    a, b = [], []
    for x, y, bits in _pairs_in(fp, tolerance, lambda x, y: node[x] != node[y]):
        keep = _least(x, y, bits, most)
        a.append(node[x[keep]])
        b.append(node[y[keep]])
    return a, b


#: Kinds of rows that a solver yields: a link (a, b); a key (a) whose run is above the limit; a row (a = key, b = fp, c = node) of a run that holds further links.
LINK, OVER, MORE = 0, 1, 2
_SHAPE = "a long, b long, c long, kind int"


def _out(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols[0])
    full = [np.asarray(c, np.int64) for c in cols] + [np.zeros(n, np.int64)] * (3 - len(cols))
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in full), pa.array(np.full(n, kind, np.int32))], names=["a", "b", "c", "kind"])


def _solver(tolerance: int, limit: int, long_run: Callable[..., tuple[list, list]], most: int | None = None, labelled: bool = False):
    """Reads rows (key, fp, node[, label]) sorted by key; yields links between different labels (nodes, unless ``labelled``).

    Runs of more than PAIR_ROWS rows go to ``long_run``. With ``most``, only links to each node's nearest come out, and the rows that have
    others come out as they are (MORE), for a second look.
    """

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        short = np.repeat(size <= PAIR_ROWS, size)
        one, two, bits = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for k in range(1, min(PAIR_ROWS, int(size.max(initial=1)))):
            same = np.flatnonzero((key[k:] == key[:-k]) & short[k:])
            if not len(same):
                break
            far = np.bitwise_count((fp[same] ^ fp[same + k]).view(np.uint64))
            hit = (far <= tolerance) & (label[same] != label[same + k])
            one.append(same[hit])
            two.append(same[hit] + k)
            bits.append(far[hit])
        one, two, bits = np.concatenate(one), np.concatenate(two), np.concatenate(bits)
        again = np.zeros(len(key), bool)
        if most is not None:
            keep = _least(np.concatenate([node[one], node[two]]), np.concatenate([node[two], node[one]]), np.concatenate([bits, bits]), most)
            keep = keep[: len(one)] | keep[len(one) :]
            again[one[~keep]] = again[two[~keep]] = True
            one, two = one[keep], two[keep]
        a, b = [node[one]], [node[two]]
        for s, n in zip(start[size > PAIR_ROWS], size[size > PAIR_ROWS], strict=True):
            more = long_run(fp[s : s + n], node[s : s + n], label[s : s + n], tolerance)
            a += more[0]
            b += more[1]
            again[s : s + n] = most is not None
        pair = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)]), axis=0), axis=1)
        pair = pair[:, pair[0] != pair[1]]
        yield _out(LINK, pair[0], pair[1])
        if again.any():
            yield _out(MORE, key[again], fp[again], node[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 3 + labelled
        held = [np.empty(0, np.int64)] * width
        over = None  # the key whose run is above the limit; its rows are passed by
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(width)]
            if over is not None:
                keep = new[0] != over
                if not keep.any():
                    continue
                new, over = [x[keep] for x in new], None
            if not len(new[0]):
                continue
            rows = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last))
            if cut:
                yield from links(*(x[:cut] for x in rows[:3]), rows[-1][:cut])
            held = [x[cut:] for x in rows]
            if len(held[0]) > limit:
                over = last
                held = [x[:0] for x in held]
                yield _out(OVER, np.array([over]))
        if len(held[0]):
            yield from links(*held[:3], held[-1])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp")


def find_links(rows: Callable[[], DataFrame], tolerance: int, limit: int = RUN_ROWS, long_run=spanning_links, most: int | None = None, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """((a, b) links, (key, fp, node) rows for a second look) of ``rows()`` (key, fp, node[, label]) that share a key and differ in at most ``tolerance`` bits.

    Without ``most`` there is nothing to look at again; with ``spanning_links`` long runs leave out links that do not change components.
    """
    found = materialise(_sorted(rows()).mapInArrow(_solver(tolerance, limit, long_run, most, labelled), _SHAPE), "links")
    over = found.where(F.col("kind") == OVER).select(F.col("a").alias("key"))
    if not over.isEmpty():
        own = rows().join(over, "key", "left_semi")
        counts = own.groupBy("key").count().select("key", F.ceil(F.col("count") * 2 / limit).cast("int").alias("blocks"))
        dealt = own.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # Every unordered pair of different blocks; a block on its own goes with each of its pairs.
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
        key = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
        pairs = dealt.withColumn("other", other).select(key, "fp", "node", *(["label"] if labelled else []))
        found = found.unionByName(materialise(_sorted(pairs).mapInArrow(_solver(tolerance, 1 << 62, long_run, most, labelled), _SHAPE), "blocklinks"))
    again = found.where(F.col("kind") == MORE).select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("c").alias("node"))
    return found.where(F.col("kind") == LINK).select("a", "b"), again


def near_duplicates(docs: DataFrame, size: int = SHINGLE, tolerance: int = TOLERANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints at ``tolerance`` (at most four) or fewer bits are linked; a component is named by its smallest doc_id."""
    if tolerance > TOLERANCE:
        raise ValueError("the keys find fingerprints that differ in at most four bits")
    own = materialise(fingerprints(docs, size, seed), "fingerprints")
    first = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links, _ = find_links(lambda: key_rows(first.select("fp", F.col("fp").alias("node"))), tolerance)
    roots = materialise(connected_components(links), "roots")
    least = roots.join(first, roots["node"] == first["fp"]).groupBy("root").agg(F.min("first").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    # As a table of its own, so that the join below has a plain shuffle on either side and a hot fingerprint can be split.
    names = materialise(first.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "names")
    return own.join(names, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
