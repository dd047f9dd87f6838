"""Near-duplicate removal on word shingles: SimHash links, an exact way for the pairs they miss, exact similarity.

Candidates come from the SimHash operator (fingerprints of the shingles, Golay keys) and, because fingerprints
cannot find all pairs of a similarity of 0.8, from a complete prefix filter: two sets of that similarity always share one of
the first shingles in any one order, here frequent ones last. Parity bitmaps of the sets, whose differing bits never outnumber the
differing shingles, reject most candidates, and the exact Jaccard similarity of the shingle sets decides the rest.

A run of texts with one key gives its pairs one by one up to RUN texts. From a longer run, in blocks, comes the minimum spanning forest of
what the bitmaps allow, which links a dense group without its pairs; then, by the components so found, pairs across them.

Defined cases: null text is empty; texts of equal lower-cased words are copies, those without words included; of a group the row of
the smallest doc_id stays, null ids last, one row even if that row is repeated; an empty table gives an empty result; all other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.operators.graph import connected_components
from pelagos.storage import discard

from .common import WORD_BYTES, give_back, materialise, sliced
from .simhash import SEED, TOLERANCE, find_links, fingerprint, key_rows, shingles

#: For whole near-duplicate removal: five-word shingles, similarity of their sets.
DEDUP_SHINGLE, SIMILARITY = 5, 0.8
#: Texts in which frequent shingles are counted, in how many of them one must occur, and how many are taken at most. They set the order of the prefixes alone.
COUNTED, OFTEN, FREQUENT = 10_000, 8, 1 << 16
#: Nodes of a key whose pairs are candidates one by one; longer runs are compared by bitmaps, in blocks of so many.
RUN, BLOCK = 16, 4096
#: Bits of a bitmap for each shingle, and the bounds of a bitmap's size.
DENSITY, LEAST_BITS, MOST_BITS = 4, 256, 1 << 14
#: Rows that are broadcast at most; above, the same join shuffles.
BROADCAST_ROWS = 500_000


def _line(text: str | None) -> bytes:
    return b" ".join(WORD_BYTES.findall((text or "").encode("utf-8").lower()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(text: str | None) -> int:
    """A text's identity: the hash of its lower-cased words."""
    return _signed(xxhash.xxh64_intdigest(_line(text), SEED))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)], np.uint64).view(np.int64))


def _with_nodes(docs: DataFrame) -> DataFrame:
    at = docs.columns.index("text")
    shape = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _node long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(t) for t in b.column(at).to_pylist()], pa.int64())], names=[*b.schema.names, "_node"])

    return docs.mapInArrow(run, shape)


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the shingles by some of their bits; the size follows the set's."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < DENSITY * len(own):
        bits *= 2
    at = (own.view(np.uint64) >> np.uint64(20)).astype(np.int64) & bits - 1
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, length: int) -> bytes:
    """The bitmap that the same set has at a smaller size."""
    words = np.frombuffer(raw, np.uint64)
    while 8 * len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


def prefix(own: np.ndarray, frequent: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in one order of all shingles: the frequent ones last, by their counts ``often``, else by hash.

    Two sets of at least this similarity always have a common shingle in their prefixes, whatever the order.
    """
    if not len(own):
        return own
    length = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[place] == own
        last = own[late]
        own = np.concatenate([own[~late], last[np.argsort(often[place[late]], kind="stable")]])
    return own[:length]


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur in OFTEN or more of about COUNTED different texts, sorted, with their counts. They only set the order of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(t, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())], names=["key"])

    step = max(1, docs.count() // COUNTED)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct().mapInArrow(run, "key long")
    top = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow().sort_by("key")
    return top.column("key").to_numpy(), top.column("n").to_numpy()


def _nodes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, doc_id, n, fp, keys, hot, bits): each different text with its smallest id, number of shingles, fingerprint, prefix, how many of the prefix, at its end, are frequent, and bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent, often = _frequent(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in sliced(batches):
            node, n, fp, keys, hot, bits = [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                found = [xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)]
                own = np.unique(np.array(found, np.uint64).view(np.int64))
                node.append(node_of(text))
                n.append(len(own))
                fp.append(fingerprint(found))
                keys.append(first := prefix(own, frequent, often, similarity))
                hot.append(int((frequent[np.minimum(np.searchsorted(frequent, first), len(frequent) - 1)] == first).sum()) if len(frequent) else 0)
                bits.append(bitmap(own))
            cols = [b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(hot, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "n", "fp", "keys", "hot", "bits"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n int, fp long, keys array<long>, hot int, bits binary")
    return rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fp", "keys", "hot", "bits")))


#: Kinds of rows of _candidates: a pair of nodes; a node and the key whose run is too long for pairs.
PAIR, LONG = 0, 1


def _candidates(similarity: float):
    """Reads (key, node, n, place) sorted by key; yields (a, b, kind). Of a run of up to RUN nodes those pairs whose sizes and places allow the similarity."""
    share = similarity / (1 + similarity)

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, RUN):
            one = np.flatnonzero(key[k:] == key[:-k])
            if not len(one):
                break
            two = one + k
            # If this is the first common shingle, no more than the rest of either set can follow; a pair is kept by its first one.
            good = np.minimum(n[one] - place[one], n[two] - place[two]) >= share * (n[one] + n[two]) - 1e-6
            a.append(node[one[good]])
            b.append(node[two[good]])
        return np.sort(np.stack([np.concatenate(a), np.concatenate(b)]), axis=0)

    def out(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(np.full(rows.shape[1], kind, np.int32))], names=["a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        found, many = [], 0
        over = None  # a key whose run is already known as long

        def solve(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal found, many
            key = rows[0]
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            long = np.repeat((size > RUN) | (key[start] == over if over is not None else False), size)
            if long.any():
                yield out(np.stack([rows[1][long], key[long]]), LONG)
            found.append(pairs(*(x[~long] for x in rows)))
            many += found[-1].shape[1]
            if many > 1 << 19:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                if found[0].shape[1] > 1 << 18:
                    yield out(found[0], PAIR)
                    found = []
                many = sum(x.shape[1] for x in found)

        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from solve([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > RUN or held[0][0] == over:
                over = int(held[0][0])
                yield from solve(held)
                held = [x[:0] for x in held]
        yield from solve(held)
        if many:
            yield out(np.unique(np.concatenate(found, axis=1), axis=1), PAIR)

    return run


def most_bits(n, similarity: float):
    """How many shingles may differ between sets of ``n`` shingles together; so many bits of their bitmaps at most."""
    return (1 - similarity) / (1 + similarity) * n + 1e-6


def _allowed(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            keep = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-6
            limit = most_bits(na + nb, similarity)
            left, right = batch.column(4), batch.column(5)
            for i in np.flatnonzero(keep):
                x, y = left[i].as_py(), right[i].as_py()
                length = min(len(x), len(y))
                keep[i] = (int.from_bytes(fold(x, length)) ^ int.from_bytes(fold(y, length))).bit_count() <= limit[i]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    own = nodes.select("node", "n", "bits")
    both = pairs.join(own.toDF("a", "na", "ba"), "a").join(own.toDF("b", "nb", "bb"), "b")
    return both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, s): the shingle set of each of ``nodes`` (node, doc_id), from its document of that id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            mine = [i for i, (n, t) in enumerate(zip(b.column(0).to_pylist(), texts, strict=True)) if node_of(t) == n]
            sets = [shingle_set(texts[i], size) for i in mine]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    wanted = nodes.select("node", F.col("doc_id").alias("_id"))
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    # A document that is repeated, or an id that has several texts, comes several times; sets of one node are equal.
    return texts.mapInArrow(run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose shingle sets have at least this Jaccard similarity."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.join(left, "a").join(right, "b")
    least = F.least(F.size("sa"), F.size("sb")) / F.greatest(F.size("sa"), F.size("sb"))  # no more can be common
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((least >= similarity) & (common / (F.size("sa") + F.size("sb") - common) >= similarity)).select("a", "b")


class _Bits:
    """The bitmaps of a run, smaller sets first; ``distance`` from one row to some others."""

    def __init__(self, n: np.ndarray, bits: list[bytes], similarity: float):
        self.n, self.similarity = n, similarity
        length = np.array([len(x) for x in bits], np.int64)
        self.length = length
        self.by_length = {}
        for k in np.unique(length):
            # All that can be compared at this size: those of the size and, folded, those of larger sizes up to twice it.
            rows = np.flatnonzero((length >= k) & (length <= 2 * k))
            place = np.full(len(n), -1, np.int64)
            place[rows] = np.arange(len(rows))
            self.by_length[int(k)] = (place, np.stack([np.frombuffer(fold(bits[i], k), np.uint64) for i in rows]))

    def distance(self, one: int, rest: np.ndarray) -> np.ndarray:
        """Differing bits by what may differ: at most 1 where the pair is allowed, infinite where it is not."""
        n, out = self.n, np.full(len(rest), np.inf)
        fits = np.minimum(n[rest], n[one]) >= self.similarity * np.maximum(n[rest], n[one]) - 1e-6
        for k in np.unique(np.minimum(self.length[rest[fits]], self.length[one])):
            place, words = self.by_length[int(k)]
            at = np.flatnonzero(fits & (np.minimum(self.length[rest], self.length[one]) == k))
            differ = np.bitwise_count(words[place[rest[at]]] ^ words[place[one]]).sum(1, dtype=np.int64)
            ratio = differ / most_bits(n[rest[at]] + n[one], self.similarity)
            out[at] = np.where(ratio <= 1, ratio, np.inf)
        return out


def forest(bits: _Bits) -> tuple[list[int], list[int]]:
    """The minimum spanning forest of the allowed pairs: by and by the nearest row that is not yet in a tree."""
    m = len(bits.n)
    rest = np.arange(m)
    near, via = np.full(m, np.inf), np.full(m, -1, np.int64)
    a, b = [], []
    while len(rest):
        k = int(np.argmin(near))
        one = int(rest[k])
        if np.isfinite(near[k]):
            a.append(int(via[k]))
            b.append(one)
        rest, near, via = (np.delete(x, k) for x in (rest, near, via))
        if len(rest):
            far = bits.distance(one, rest)
            closer = far < near
            near, via = np.where(closer, far, near), np.where(closer, one, via)
    return a, b


def _compare(similarity: float, across: bool):
    """Of a block, or a pair of blocks, of one run: its forest, or with ``across`` the allowed pairs of different labels."""

    def run(group: pa.Table) -> pa.Table:
        node, label, n = (group.column(c).to_numpy() for c in ("node", "label", "n"))
        order = np.argsort(n, kind="stable")
        raw = group.column("bits").to_pylist()
        bits = _Bits(n[order].astype(np.int64), [raw[i] for i in order], similarity)
        node, label = node[order], label[order]
        if across:
            a, b = [], []
            for i in range(len(node) - 1 if (label != label[0]).any() else 0):
                rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                rest = rest[: np.searchsorted(bits.n[rest], bits.n[i] / similarity + 1e-6, side="right")]
                hit = rest[np.isfinite(bits.distance(i, rest))]
                a += [i] * len(hit)
                b += hit.tolist()
        else:
            a, b = forest(bits)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return run


def _in_runs(rows: DataFrame, similarity: float, across: bool) -> DataFrame:
    """Pairs (a, b) of long runs ``rows`` (key, node, label, n, bits, blocks), each run dealt out as pairs of its ``blocks``."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))))
    both = dealt.select("key", "node", "label", "n", "bits", "block", other.alias("other"))
    both = both.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return both.groupBy("key", "lo", "hi").applyInArrow(_compare(similarity, across), "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The similar ones of ``pairs`` (a, b), a table."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = materialise(nodes.select("node", "doc_id").join(ends, "node", "left_semi"), "ends")
    sets = materialise(_sets(docs, ends, size), "shingles")
    links = materialise(_similar(pairs, sets, similarity), "similar")
    discard(ends, sets)
    return links


def _links(docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links that join the same nodes as all similar pairs do."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    near, _ = find_links(lambda: key_rows(first.select("fp", F.col("fp").alias("node")), spread=False), TOLERANCE)
    by_fp = nodes.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    named = lambda c, name: first.select(F.col("fp").alias(c), F.col("first").alias(name))
    simhash = near.join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(by_fp)
    rows = nodes.select("node", "n", F.posexplode(F.expr("slice(keys, 1, size(keys) - hot)")).alias("place", "key")).select("key", "node", "n", "place")
    found = materialise(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates(similarity), "a long, b long, kind int"), "candidates")
    # Frequent shingles are known to have long runs, which are not gathered by key in the first place.
    hot = nodes.where("hot > 0").select("node", F.explode(F.expr("slice(keys, size(keys) - hot + 1, hot)")).alias("key"))
    long = found.where(F.col("kind") == LONG).select(F.col("a").alias("node"), F.col("b").alias("key")).unionByName(hot)
    counts = materialise(long.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "runs")
    own = nodes.select("node", F.col("node").alias("label"), "n", "bits")
    runs = materialise(long.join(counts, "key").join(own, "node"), "longruns")
    pairs = materialise(_allowed(_ordered(found.where(F.col("kind") == PAIR).select("a", "b").unionByName(simhash)), nodes, similarity), "pairs")
    trees = materialise(_in_runs(runs, similarity, across=False), "trees")
    discard(found)
    tried = materialise(_ordered(pairs.unionByName(trees)), "tried")
    discard(pairs, trees)
    links = _verified(docs, nodes, tried, size, similarity)
    labels = materialise(connected_components(links), "labels")
    named_runs = runs.join(labels, "node", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    rest = materialise(_ordered(_in_runs(named_runs, similarity, across=True)).join(tried, ["a", "b"], "left_anti"), "across")
    discard(runs, counts, tried, links)
    return labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(docs, nodes, rest, size, similarity))


def drop_near_duplicates(docs: DataFrame, size: int = DEDUP_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id (null ids last).

    Texts of equal words are one node; two nodes are linked if the similarity of their shingle sets is at least ``similarity``.
    """
    nodes = materialise(_nodes(docs, size, similarity), "nodes")
    links = materialise(_links(docs, nodes, size, similarity), "links")
    roots = connected_components(links).select("node", "root")
    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    keep = materialise(best.select(F.col("best.node").alias("_kept"), F.xxhash64("best.doc_id").alias("_hash")), "keepers")
    discard(nodes, links)
    # The hash of the id (one to one for numbers) is part of the key, so a text with very many copies is not gathered in one task.
    own = _with_nodes(docs).withColumn("_id_hash", F.xxhash64("doc_id"))
    own = own.join(keep, (own["_node"] == keep["_kept"]) & (own["_id_hash"] == keep["_hash"]))
    return own.dropDuplicates(["_node", "_id_hash"]).select(*(f"`{c}`" for c in docs.columns))
