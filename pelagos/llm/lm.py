"""A trigram language model in sharded Elias-Fano tries.

Documents are tokenised once, in batches that are written as a table. Then two exchanges between batches and
shards follow. In the first, shards of the vocabulary (ranges of word hashes) add up the batches' word counts and number the words. In the
second, every batch sends each shard its own little trie: contexts, their different successors, the successors of
these pairs, with the counts of its training documents. A shard adds these up, smooths them (interpolated absolute
discounting; the lowest order is the add-one unigram that the base score uses), writes them as a memory-mapped trie with
quantised values and looks up what each batch has asked for. The batch puts its documents' scores together.

Contexts are dealt out by a hash. A word with many tokens is split into parts by its successor, each a small
smoothed model with its own total, and the batch mixes the parts by their totals, so no shard gathers all successors of a frequent word.
Every pair of the training documents is a context, whatever the size of the corpus. Words are numbered by falling frequency, within a shard
as within a batch, so that most numbers are small and take few bytes. No task holds more than a batch or a
shard, both of bounded size; a batch sends no row where it has nothing to ask, so the rows never outnumber the contexts of the batches.
Only four numbers go to the driver: all tokens, training tokens, their different words, and the most words of a shard.

Defined cases: null text is empty; a text without words is the end token alone; documents of null id are
training documents (the remainder of no number is not 2); repeated rows count and score as often as they occur; without training
documents every word is unknown; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import array
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialise, sliced, table
from .elias_fano import Trie

FOLDS, HELD_OUT = 7, 2
#: Text of a batch, and tokens for each shard.
BATCH_BYTES, SHARD_TOKENS = 6 << 20, 800_000
SEED = 7
#: Absolute discounts of counts 1, 2 and 3 or more, for either order.
DISCOUNTS = (0.7, 1.1, 1.4)
#: Steps a decade of the quantised values, two bytes each: the error stays below 0.12 %, the range is 63 decades.
STEPS, NOTHING = 1024, 0xFFFF
END = xxhash.xxh64_intdigest(b"\0end", SEED)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def quantise(p: np.ndarray) -> np.ndarray:
    """Two-byte codes of probabilities; NOTHING for 0."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * STEPS)
    return np.where(p > 0, np.clip(code, 0, NOTHING - 1), NOTHING).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code == NOTHING, 0.0, 10.0 ** (-code.astype(float) / STEPS))


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width, byte planes apart, compressed."""
    values = np.asarray(values).astype(np.uint64)
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 3, 4, 6, 8) if top >> 8 * w == 0)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return squeeze(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def _climb(raw: bytes) -> np.ndarray:
    return np.cumsum(loosen(raw), dtype=np.uint64)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def _batches(batch_bytes: int):
    """Batches of consecutive documents (doc_id, held_out, text): tokens by the rank of their word in the batch, with each rank's place among the words, these as sorted hashes."""

    def pack(ids: list[pa.Array], held: list[np.ndarray], docs: list[array.array], known: dict[bytes, int], number: int) -> pa.RecordBatch:
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        token = np.zeros(int(sizes.sum()), np.int64)
        inside = np.ones(len(token), bool)
        inside[np.cumsum(sizes) - 1] = False
        token[inside] = np.concatenate([np.frombuffer(d, np.uint32) for d in docs])
        h = xxhash.xxh64_intdigest
        hashes = np.array([END, *(h(w, SEED) for w in known)], np.uint64)
        words, place = np.unique(hashes, return_inverse=True)
        token, out = place[token], np.concatenate(held)
        counts = np.bincount(token[np.repeat(~out, sizes)], minlength=len(words))
        ranked = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[ranked] = np.arange(len(words))
        batch = TaskContext.get().partitionId() << 32 | number
        cols = [pa.array([batch]), pa.ListArray.from_arrays([0, len(docs)], pa.concat_arrays(ids)), *(pa.array([x], pa.binary()) for x in (squeeze(out), squeeze(sizes), squeeze(rank[token]), squeeze(ranked), _steps(words), squeeze(counts))), pa.array([len(token)])]
        return pa.RecordBatch.from_arrays(cols, names=["batch", "ids", "held", "sizes", "tokens", "ranked", "words", "counts", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        ids, held, docs, known = [], [], [], {}
        for b in sliced(batches, 64):
            for text in b.column(2).to_pylist():
                raw = (text or "").encode("utf-8").lower()
                size += len(raw)
                docs.append(array.array("I", (known.setdefault(w, len(known) + 1) for w in WORD_BYTES.findall(raw))))
            ids.append(b.column(0))
            held.append(b.column(1).to_numpy(zero_copy_only=False).astype(bool))
            if size >= batch_bytes:
                yield pack(ids, held, docs, known, number)
                number, size = number + 1, 0
                ids, held, docs, known = [], [], [], {}
        if docs:
            yield pack(ids, held, docs, known, number)

    return run


def _word_rows(shards: int):
    """(shard, batch, words, counts): a batch's words by hash range."""
    bounds = np.array([s * (1 << 64) // shards for s in range(shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, words, counts in zip(*(b.column(i) for i in range(3)), strict=True):
                words, counts = _climb(words.as_py()), loosen(counts.as_py())
                cut = np.append(np.searchsorted(words, bounds), len(words))
                rows = [(s, batch.as_py(), _steps(words[a:z]), squeeze(counts[a:z])) for s, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "batch", "words", "counts"])

    return run


def _number(shards: int):
    """Numbers a hash range's words, the most frequent first, and adds up their counts; a row per batch, and one of batch -1 with the range's training tokens, words that have any, and words."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        words = [_climb(x) for x in group.column("words").to_pylist()]
        counts = np.concatenate([loosen(x) for x in group.column("counts").to_pylist()])
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(every)).astype(np.int64)
        number = np.empty(len(every), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(every)) * shards + shard
        cut = _ranges(np.array([len(w) for w in words]))
        rows = [(-1, shard, None, None, int(total.sum()), int((total > 0).sum()), len(every))]
        for batch, a, z in zip(group.column("batch").to_pylist(), cut[:-1], cut[1:], strict=True):
            rows.append((batch, shard, squeeze(number[place[a:z]]), squeeze(total[place[a:z]]), None, None, None))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 3]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["batch", "shard", "numbers", "totals", "n", "v", "words"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 64 bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Asked:
    """What a batch asks the shards: contexts, pairs and triples, each in the order of (shard, context, successor, next successor)."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, totals: np.ndarray, n: int, shards: int, min_context: int):
        end = int(tokens[int(sizes[0]) - 1])
        width = np.uint64(len(numbers))
        first = np.cumsum(sizes) - sizes
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[first] = end
        key, at = np.unique(before.astype(np.uint64) * width + tokens.astype(np.uint64), return_inverse=True)
        context, child = (key // width).astype(np.int64), (key % width).astype(np.int64)
        # A frequent word has parts, of a quarter of a shard's fair share each.
        parts = (1 + totals.astype(np.int64) * 4 * shards // max(1, n)).astype(np.uint64)
        place = lambda word, part: (_mix(numbers[word] * np.uint64(31) + _mix(part)) % np.uint64(shards)).astype(np.int64)
        shard = place(context, _mix(numbers[child]) % parts[context])
        order = np.lexsort((numbers[child], numbers[context], shard))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.pair = back[at]
        self.context, self.child, self.shard = context[order], child[order], shard[order]
        split = np.flatnonzero(parts > 1)
        split = split[np.isin(split, self.context)]
        many = parts[split].astype(np.int64)
        word = np.repeat(split, many)
        all_parts = place(word, (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64))
        owner = np.concatenate([self.context, word])
        every = np.stack([np.concatenate([self.shard, all_parts]), numbers[owner].astype(np.int64), owner])
        every = every[:, np.lexsort(every[1::-1])]
        keep = np.ones(every.shape[1], bool)
        keep[1:] = (every[:2, 1:] != every[:2, :-1]).any(0)
        self.entry_shard, self.entry_number, self.entry_word = every[:, keep]
        # Each pair's entry: both are in the order (shard, number).
        new = np.ones(len(order), bool)
        new[1:] = (self.shard[1:] != self.shard[:-1]) | (self.context[1:] != self.context[:-1])
        with_pairs = np.isin(self.entry_shard * np.int64(len(numbers)) + self.entry_word, np.unique(self.shard * np.int64(len(numbers)) + self.context))
        self.entry = np.flatnonzero(with_pairs)[np.cumsum(new) - 1]
        # Triples: a pair of frequent words and the token after it, within a document.
        often = totals >= min_context
        inner = np.ones(len(tokens), bool)
        inner[first] = False
        inner[1:] &= (often[self.context] & often[self.child])[self.pair[:-1]]
        self.third = np.flatnonzero(inner)
        keys, self.triple = np.unique(self.pair[self.third - 1].astype(np.uint64) * width + tokens[self.third].astype(np.uint64), return_inverse=True)
        self.above, self.last = (keys // width).astype(np.int64), (keys % width).astype(np.int64)

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each shard's entries, pairs and triples begin and end."""
        bounds = np.arange(shards + 1)
        pairs = np.searchsorted(self.shard, bounds)
        return np.searchsorted(self.entry_shard, bounds), pairs, np.searchsorted(self.above, pairs)


def _opened(rows: pa.Table, words: pa.Table, n: int, shards: int, min_context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Asked, np.ndarray]:
    """(tokens, sizes, held, totals, what they ask, numbers) of a batch's row and its rows of numbered words."""
    get = lambda c: loosen(rows.column(c)[0].as_py())
    tokens, sizes, held = get("ranked").astype(np.int64)[get("tokens").astype(np.int64)], get("sizes").astype(np.int64), get("held").astype(bool)
    words = words.sort_by("shard")
    numbers, totals = (np.concatenate([loosen(x) for x in words.column(c).to_pylist()]) for c in ("numbers", "totals"))
    return tokens, sizes, held, totals, Asked(tokens, sizes, numbers, totals, n, shards, min_context), numbers


_ASK = ("contexts", "width", "words", "counts", "more", "thirds", "third_counts")


def _ask(n: int, shards: int, min_context: int):
    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        tokens, sizes, held, _, own, numbers = _opened(rows, words, n, shards, min_context)
        train = np.repeat(~held, sizes)
        counts = np.bincount(own.pair[train], minlength=len(own.child))
        thirds = np.bincount(own.triple[train[own.third]], minlength=len(own.last))
        width = np.bincount(own.entry, minlength=len(own.entry_word))
        more = np.bincount(own.above, minlength=len(own.child))
        out, batch = [], rows.column("batch")[0].as_py()
        e, p, t = own.cuts(shards)
        for s in range(shards):
            if e[s] < e[s + 1]:
                x, y, z = slice(e[s], e[s + 1]), slice(p[s], p[s + 1]), slice(t[s], t[s + 1])
                out.append((s, batch, _steps(own.entry_number[x]), *(squeeze(v) for v in (width[x], numbers[own.child[y]], counts[y], more[y], numbers[own.last[z]], thirds[z]))))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * len(_ASK)]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["shard", "batch", *_ASK])

    return run


def smoothed(counts: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(discounted probability of each count, total of each owner, share that its discounts free)."""
    less = np.where(counts > 0, np.array((0.0, *DISCOUNTS))[np.minimum(counts, 3)], 0.0)
    total = np.bincount(owner, weights=counts, minlength=owners)
    freed = np.bincount(owner, weights=less, minlength=owners) / np.maximum(total, 1)
    return (counts - less) / np.maximum(total, 1)[owner], total, freed


def _answer(words: int):
    """Adds up a shard's tries, smooths them into one and answers every batch."""

    def run(group: pa.Table) -> pa.Table:
        get = {c: [loosen(x) for x in group.column(c).to_pylist()] for c in _ASK[1:]}
        get["contexts"] = [_climb(x) for x in group.column("contexts").to_pylist()]
        flat = {c: np.concatenate(x) for c, x in get.items()}
        roots, entry = np.unique(flat["contexts"], return_inverse=True)
        width = np.uint64(max(1, words))
        key, pair = np.unique(np.repeat(entry, flat["width"].astype(np.int64)).astype(np.uint64) * width + flat["words"], return_inverse=True)
        parent, child = (key // width).astype(np.int64), key % width
        count = np.bincount(pair, weights=flat["counts"], minlength=len(key)).astype(np.int64)
        key, triple = np.unique(np.repeat(pair, flat["more"].astype(np.int64)).astype(np.uint64) * width + flat["thirds"], return_inverse=True)
        above, last = (key // width).astype(np.int64), key % width
        thirds = np.bincount(triple, weights=flat["third_counts"], minlength=len(key)).astype(np.int64)
        p2, total, freed = smoothed(count, parent, len(roots))
        p3, totals, rest = smoothed(thirds, above, len(child))
        # Only what the training documents have goes into the trie.
        seen, held = count > 0, thirds > 0
        place = np.cumsum(seen) - 1
        codes = {"back1": quantise(freed), "value2": quantise(p2[seen]), "back2": quantise(np.where(totals > 0, rest, 0.0)[seen]), "value3": quantise(p3[held])}
        trie = Trie(roots, [(parent[seen], child[seen]), (place[above[held]], last[held])], codes, words)
        try:
            at, hit = trie.root(roots)
            back1 = np.where(hit & (total > 0), trie.codes["back1"][np.minimum(at, len(roots) - 1)], NOTHING)
            at, hit = trie.find(0, parent, np.ones(len(parent), bool), child)
            code = lambda name, at, hit: _picked(trie.codes[name], at, hit)
            value2, back2 = code("value2", at, hit), code("back2", at, hit)
            at, hit = trie.find(1, at[above], hit[above], last)
            value3 = code("value3", at, hit)
        finally:
            trie.close()
        e, p, t = (_ranges(np.array([len(x) for x in get[c]])) for c in ("contexts", "words", "thirds"))
        rows, shard = [], group.column("shard")[0].as_py()
        for i, batch in enumerate(group.column("batch").to_pylist()):
            x, y, z = entry[e[i] : e[i + 1]], pair[p[i] : p[i + 1]], triple[t[i] : t[i + 1]]
            rows.append((batch, shard, *(squeeze(v) for v in (total[x], back1[x], value2[y], back2[y], value3[z]))))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * len(_ANSWER)]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["batch", "shard", *_ANSWER])

    return run


_ANSWER = ("total", "back1", "value2", "back2", "value3")


def _picked(codes: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
    out = np.full(len(at), NOTHING, np.uint16)
    out[hit] = codes[at[hit]]
    return out


def _score(n: int, v: int, shards: int, min_context: int):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        is_answer = found.column("asked")
        words = found.filter(pc.invert(is_answer)).select(["shard", "one", "two"]).rename_columns(["shard", "numbers", "totals"])
        tokens, sizes, held, totals, own, _ = _opened(rows, words, n, shards, min_context)
        answers = found.filter(is_answer).sort_by("shard")
        join = lambda c: np.concatenate([loosen(x) for x in answers.column(c).to_pylist()] or [np.zeros(0, np.uint64)])
        total, back1 = join("one").astype(float), restore(join("two"))
        value2, back2, value3 = (join(c) for c in ("three", "four", "five"))
        heard = np.bincount(own.entry_word, weights=total, minlength=len(totals))
        freed = np.bincount(own.entry_word, weights=total * back1, minlength=len(totals))
        freed = np.where(heard > 0, freed / np.maximum(heard, 1), 1.0)
        unigram = (totals.astype(float) + 1) / (n + v + 1)
        part = total[own.entry] / np.maximum(heard[own.context], 1)
        p = (restore(value2) * part + freed[own.context] * unigram[own.child])[own.pair]
        third, above = own.third, own.pair[own.third - 1]
        free = np.where(back2[above] == NOTHING, 1.0, restore(back2[above]))
        p[third] = restore(value3)[own.triple] + free * p[third]
        starts = np.cumsum(sizes) - sizes
        each = lambda x: np.add.reduceat(x, starts)
        cols = {"held_out": held, "n_tokens": sizes, "n_known": each((totals[tokens] > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), n, np.int64), "base_score": each(np.log10(unigram)[tokens]), "score": each(np.log10(p))}
        return pa.table({"doc_id": rows.column("ids").combine_chunks().flatten()} | {k: pa.array(x) for k, x in cols.items()})

    return run


def score_documents(docs: DataFrame, batch_bytes: int = BATCH_BYTES, held: Column | None = None, shard_tokens: int = SHARD_TOKENS, min_share: float = 0.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ``held`` tells which are not learned from.

    All pairs are contexts; a ``min_share`` above 0 makes a smaller model, of pairs whose words both have that share of the training tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", (held if held is not None else held_out(F.col("doc_id"))).alias("held_out"), "text")
    rows = materialise(own.mapInArrow(_batches(batch_bytes), f"batch long, ids array<{kind}>, held binary, sizes binary, tokens binary, ranked binary, words binary, counts binary, n long"), "batches")
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // shard_tokens))
    asked = rows.select("batch", "words", "counts").mapInArrow(_word_rows(shards), "shard long, batch long, words binary, counts binary")
    words = materialise(asked.groupBy("shard").applyInArrow(_number(shards), "batch long, shard long, numbers binary, totals binary, n long, v long, words long"), "words")
    sums = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("words").alias("words")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    min_context = max(1, math.ceil(n * min_share))
    most = shards * (sums["words"] or 0)
    words = words.where("batch >= 0").select("batch", "shard", "numbers", "totals")
    per_batch = rows.select("batch", "ids", "held", "sizes", "tokens", "ranked").groupBy("batch")
    blobs = ", ".join(f"{c} binary" for c in _ASK)
    asks = per_batch.cogroup(words.groupBy("batch")).applyInArrow(_ask(n, shards, min_context), f"shard long, batch long, {blobs}")
    answers = asks.groupBy("shard").applyInArrow(_answer(most), "batch long, shard long, " + ", ".join(f"{c} binary" for c in _ANSWER))
    none = [F.lit(None).cast("binary").alias(c) for c in ("three", "four", "five")]
    found = words.select("batch", "shard", F.lit(False).alias("asked"), F.col("numbers").alias("one"), F.col("totals").alias("two"), *none)
    found = found.unionByName(answers.select("batch", "shard", F.lit(True).alias("asked"), *(F.col(c).alias(x) for c, x in zip(_ANSWER, ("one", "two", "three", "four", "five"), strict=True))))
    return per_batch.cogroup(found.groupBy("batch")).applyInArrow(_score(n, v, shards, min_context), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's score under the model of the training documents."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
