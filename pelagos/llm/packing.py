"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Only the counts of the piece lengths, at most
``capacity`` numbers whatever the corpus, decide the plan: the longest length left opens sequences, and
an index of the lengths, the pair sums and, through it, the triple sums that are still available gives
combinations that fill the gap exactly; each is consumed as often as its counts allow. Where none fits,
the longest length that still fits goes in and the new gap is looked up again. The plan is a list
of runs (a pattern of lengths and how many sequences have it), so it does not grow with the corpus;
pieces find their places by their rank among pieces of equal length.

Defined cases: a null or empty text is the end id alone; a piece as long as ``capacity`` is a sequence of
its own; ties of length are ranked by a hash of id and piece, then by their order; repeated rows
are packed as often as they occur; an empty table gives an empty result; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sliced, table
from .tokens import encoder

CAPACITY, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
ROWS_A_BUCKET = 50_000


class Stock:
    """Counts by length, with the number of pairs of available lengths for every sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(capacity + 1, np.int64)
        have = self.left > 0
        for a in np.flatnonzero(have):
            low = np.flatnonzero(have[: min(a, capacity + 1 - a)])
            self.pairs[a + low] += 1
            if 2 * a <= capacity and self.left[a] > 1:
                self.pairs[2 * a] += 1

    def take(self, length: int, n: int) -> None:
        before = int(self.left[length])
        after = before - n
        self.left[length] = after
        if before > 1 >= after and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
        if before > 0 >= after:
            other = np.flatnonzero(self.left[: self.capacity + 1 - length] > 0)
            self.pairs[length + other[other != length]] -= 1

    def spare(self, length: int, used: Counter) -> int:
        return int(self.left[length]) - used[length]

    def pair(self, gap: int, used: Counter) -> tuple[int, int] | None:
        """The pair of sum ``gap`` with the most copies."""
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        low = np.arange(1, gap // 2 + 1)
        copies = np.minimum(self.left[low], self.left[gap - low])
        if gap % 2 == 0:
            copies[-1] //= 2
        for a in low[np.argsort(-copies, kind="stable")[: len(used) + 2]]:
            a, b = int(a), int(gap - a)
            if self.spare(a, used) >= 1 + (a == b) and self.spare(b, used) >= 1:
                return a, b
        return None

    def triple(self, gap: int, used: Counter) -> tuple[int, int, int] | None:
        """The first triple of sum ``gap``, the lengths with the most copies first; a length fails only where the sequence has its last copies."""
        if gap < 3:
            return None
        c = np.arange(1, gap - 1)
        c = c[(self.left[c] > 0) & (self.pairs[gap - c] > 0)]
        for x in c[np.argsort(-self.left[c], kind="stable")]:
            x = int(x)
            if self.spare(x, used) > 0 and (two := self.pair(gap - x, used + Counter([x]))):
                return (x, *two)
        return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Runs (pattern as length -> copies, sequences) that use up ``counts``."""
    stock, runs, longest = Stock(counts, capacity), [], capacity
    while True:
        while longest and stock.left[longest] <= 0:
            longest -= 1
        if not longest:
            return runs
        used, gap = Counter([longest]), capacity - longest
        while gap:
            if stock.spare(gap, used) > 0:
                fill = (gap,)
            else:
                fill = stock.pair(gap, used) or stock.triple(gap, used)
            if fill:
                used.update(fill)
                break
            fits = np.flatnonzero(stock.left[1 : gap + 1] > 0)[::-1] + 1
            best = next((int(x) for x in fits if stock.spare(int(x), used) > 0), 0)
            if not best:
                break
            used[best] += 1
            gap -= best
        n = min(int(stock.left[x]) // k for x, k in used.items())
        for x, k in used.items():
            stock.take(x, k * n)
        runs.append((dict(used), n))


def place_table(runs: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each run and length the first rank it takes; sorted by length and rank."""
    next_rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in runs:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.append((length, next_rank[length], k, sequence, offset))
            next_rank[length] += k * n
            offset += k * length
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), cols, strict=True))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]); the first piece takes what whole pieces leave."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in sliced(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                own = encode(text) + end
                n = len(own) // 4
                begin, k = 0, 0
                while begin < n:
                    size = min(n, n % capacity or capacity) if not k else capacity
                    part = own[4 * begin : 4 * (begin + size)]
                    at.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    begin, k = begin + size, k + 1
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece with its sequence and its offset there; ``with_ids`` adds the token ids as 32-bit little-endian bytes."""
    cut = materialise(pieces(docs, tokenizer or public_tokenizers.path(TOKENIZER), capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = place_table(plan_sequences(counts, capacity))
    buckets = max(16, sum(counts.values()) // ROWS_A_BUCKET)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_in", inner).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    names = [*cut.columns, "_rank"]
    ranked = ranked.select(*names)
    fields = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in cut.columns) + ", sequence_id long, offset long"
    at_length, at_rank = names.index("length"), names.index("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(places["rank"].max(initial=0)) + 1
        keys = places["length"] * width + places["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (at_length, at_rank))
            row = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            within = rank - places["rank"][row]
            k = places["copies"][row]
            sequence = places["sequence"][row] + within // k
            offset = places["offset"][row] + within % k * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
