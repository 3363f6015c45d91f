"""Ranked lexical search over a clustered index with exact stopping.

*Order.* Recursive graph bisection splits a bounded sample of documents (``SAMPLE`` of the least id
hashes, ``SAMPLE_TERMS`` terms each) again and again into halves, swapping pairs between them while
that shortens the gaps in the lists of terms. What a split has learnt is a weight for each term: the
difference of what the term would cost on either side. Every document, in the sample or not, walks
down this tree by the sums of its terms' weights and so finds its cluster; the documents of a cluster lie
next to each other in the index.

*Index.* A row is a shard: documents of one cluster, at most ``SHARD_DOCS``, with the inverted lists
of all their terms, packed, and in its head for each list the largest count and the least ratio of
length to count. These bound what a term can add in the shard whatever the corpus's statistics are.
A cluster of any share of all documents is many shards: its pieces are dealt out by map task as well.

*Search.* Items come in blocks of ``ITEMS``, whose terms travel to the tasks. One pass over the heads
of the lists counts documents by term; one bounds each shard for each item. The ``FIRST`` best
bounded shards of each item are scored first, which gives a score that the k best surely reach; then every
other shard whose bound is not below it is scored, and the rest is skipped. A shard that is equal to
that score is visited, as its documents may win by their ids. So the result is exact.

Terms are compared by 64-bit hashes: a corpus of n distinct terms confuses one of q terms of items
with probability n q / 2**64.

Defined cases: null and empty texts have no terms and are neither counted nor found; an item without
terms gives no rows; rows of equal item_id are one item with the terms of all of them, and a null item_id
is one like any other; repeated documents rank each by itself; a null doc_id goes last among equal
scores; an empty table on either side gives no rows. Texts of any length are read whole. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import partitions, stage, whole_number_ids
from lodestone.llm.wordhash import mix, slices, words_of

BEST = 50
SAMPLE, SAMPLE_TERMS, VOCABULARY, LEVELS, SWAPS = 4096, 256, 32768, 5, 10
SLICE_BYTES = 6 << 20
SHARD_DOCS = 1024
GROUP = 8
ITEMS = 1024
FIRST = 2
TERMS_A_FILE = 1 << 20
_APART = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _APART[_low : _high + 1] = True
PIECE = "cluster int, part int, n_docs long, n_terms long, n_postings long, body binary"
SHARD = "shard long, cluster int, n_docs long, n_words long, n_terms long, n_postings long, head binary, body binary"
HEAD = ["shard", "n_terms", "head"]
NO_ID = np.iinfo(np.int64).max


def _lists(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Inverted lists of a text column: (term, row, tf) by term and row, and the rows' numbers of terms."""
    words = words_of(texts, lower=True, apart=_APART)
    lengths, term = np.diff(words.row), words.hash
    del words
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    order = np.argsort(term, kind="stable")
    term, row = term[order], row[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(term) else np.empty(0, np.int64)
    return term[at], row[at], np.diff(np.append(at, len(term))), lengths


@dataclass
class Tree:
    """Splits in breadth-first order: for each the weights of the sorted ``terms``; the sum above 0 goes right."""

    terms: np.ndarray
    weights: np.ndarray

    def clusters(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        node = np.zeros(n, np.int64)
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        own = term[begins]
        at = np.minimum(np.searchsorted(self.terms, own), max(0, len(self.terms) - 1))
        known = self.terms[at] == own if len(self.terms) else np.zeros(len(own), bool)
        size = np.diff(np.append(begins, len(term)))
        here = np.repeat(known, size)
        index, row = np.repeat(at, size)[here], row[here]
        for _ in range(int(math.log2(len(self.weights) + 1))):
            pull = np.bincount(row, weights=self.weights[node[row], index], minlength=n)
            node = 2 * node + 1 + (pull > 0)
        return node - len(self.weights)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits that the gaps of lists of some lengths take among n documents."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int = LEVELS) -> np.ndarray:
    """Weights of the splits of a graph of documents and terms, edge by edge in the order of documents."""
    weights = np.zeros((2**levels - 1, n_terms), np.float32)
    members = {0: np.arange(n_docs)}
    for split in range(len(weights)):
        docs = members.pop(split)
        name = np.full(n_docs, -1)
        name[docs] = np.arange(len(docs))
        inside = name[doc] >= 0
        d, t = name[doc[inside]], term[inside]
        right = np.arange(len(docs)) >= (len(docs) + 1) // 2
        sizes = (int((~right).sum()), int(right.sum()))
        for _ in range(SWAPS):
            at = right[d]
            degree = [np.bincount(t[~at], minlength=n_terms), np.bincount(t[at], minlength=n_terms)]
            now = _cost(degree[0], sizes[0]) + _cost(degree[1], sizes[1])
            to_right = now - _cost(np.maximum(degree[0] - 1, 0), sizes[0]) - _cost(degree[1] + 1, sizes[1])
            to_left = now - _cost(degree[0] + 1, sizes[0]) - _cost(np.maximum(degree[1] - 1, 0), sizes[1])
            gain = np.bincount(d, weights=np.where(at, to_left[t], to_right[t]), minlength=len(docs))
            left_best, right_best = (x[np.argsort(-gain[x], kind="stable")] for x in (np.flatnonzero(~right), np.flatnonzero(right)))
            pairs = min(len(left_best), len(right_best))
            swaps = int((gain[left_best[:pairs]] + gain[right_best[:pairs]] > 1e-9).sum())
            if not swaps:
                break
            right[left_best[:swaps]], right[right_best[:swaps]] = True, False
        degree = [np.bincount(t[right[d] == side], minlength=n_terms) for side in (False, True)]
        if len(docs) > 1:
            side_cost = [_cost(x + 1, n) - _cost(x, n) for x, n in zip(degree, sizes, strict=True)]
            weights[split] = side_cost[0] - side_cost[1]
        members[2 * split + 1], members[2 * split + 2] = docs[~right], docs[right]
    return weights


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its terms of the least mixed hashes, packed."""
    for whole in batches:
        for b in slices(whole, SLICE_BYTES):
            term, row, _, lengths = _lists(b.column(0))
            order = np.lexsort((mix(term, 1), row))
            term, row = term[order], row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            term, row = term[place < SAMPLE_TERMS], row[place < SAMPLE_TERMS]
            ends = np.searchsorted(row, np.arange(len(lengths) + 1))
            yield pa.record_batch([pa.array([term[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["terms"])


def fitted(docs: DataFrame) -> Tree:
    """The tree of a sample of ``docs(doc_id, text)``."""
    least = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if least is None:
        return Tree(np.empty(0, np.uint64), np.zeros((2**LEVELS - 1, 0), np.float32))
    some = docs.where(F.xxhash64("doc_id") <= least).select(F.coalesce("text", F.lit("")).alias("text"))
    rows = [np.frombuffer(r.terms, np.uint64) for r in some.mapInArrow(_sampled, "terms binary").limit(SAMPLE).collect()]  # SAMPLE rows of SAMPLE_TERMS terms at most
    every = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms, at, degree = np.unique(every, return_inverse=True, return_counts=True)
    chosen = np.sort(np.argsort(-degree, kind="stable")[:VOCABULARY])
    chosen = chosen[degree[chosen] > 1]
    new = np.full(len(terms), -1)
    new[chosen] = np.arange(len(chosen))
    kept = new[at] >= 0
    return Tree(terms[chosen], bisected(doc[kept], new[at][kept], len(rows), len(chosen)))


def _packed(*arrays: tuple[np.ndarray, type]) -> bytes:
    """Arrays one after the other in some types, compressed."""
    return pa.compress(b"".join(a.astype(kind).tobytes() for a, kind in arrays), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *sizes: tuple[int, type]) -> list[np.ndarray]:
    whole = pa.decompress(blob, sum(n * np.dtype(kind).itemsize for n, kind in sizes), codec="zstd")
    out, at = [], 0
    for n, kind in sizes:
        out.append(np.frombuffer(whole, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _piece(n_docs: int, n_terms: int, n_postings: int, body: bytes) -> list[np.ndarray]:
    """Docs, lengths, terms, counts, places and tfs of a piece."""
    return _unpacked(body, (n_docs, np.int64), (n_docs, np.int64), (n_terms, np.uint64), (n_terms, np.uint32), (n_postings, np.uint16), (n_postings, np.uint32))


def _cut(tree: Tree):
    """Texts to pieces: the inverted lists of the documents of one cluster in one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() // GROUP
        for whole in batches:
            for b in slices(whole, SLICE_BYTES):
                ids = b.column(0).fill_null(NO_ID).to_numpy()
                term, row, tf, lengths = _lists(b.column(1))
                cluster = np.where(lengths > 0, tree.clusters(term, row, len(ids)), -1)
                order = np.argsort(cluster[row].astype(np.int16), kind="stable")
                term, row, tf = term[order], row[order], tf[order]
                bounds = np.searchsorted(cluster[row], np.arange(2**LEVELS + 1)) if len(row) else np.zeros(2**LEVELS + 1, np.int64)
                rows = []
                for c in np.flatnonzero(np.diff(bounds)):
                    mine = slice(bounds[c], bounds[c + 1])
                    own = np.flatnonzero(cluster == c)
                    place = np.searchsorted(own, row[mine])
                    for k in range(0, len(own), SHARD_DOCS):
                        inside = (place >= k) & (place < k + SHARD_DOCS)
                        terms, counts = np.unique(term[mine][inside], return_counts=True)
                        few = own[k : k + SHARD_DOCS]
                        body = _packed((ids[few], np.int64), (lengths[few], np.int64), (terms, np.uint64), (counts, np.uint32), (place[inside] - k, np.uint16), (tf[mine][inside], np.uint32))
                        rows.append((int(c), part, len(few), len(terms), int(counts.sum()), body))
                if rows:
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, those of a cluster and part next to each other, to shards."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held, key, size = [], None, 0

    def shard() -> pa.RecordBatch:
        nonlocal made
        docs, lengths = (np.concatenate([p[k] for p in held]) for k in (0, 1))
        term = np.concatenate([np.repeat(p[2], p[3]) for p in held])
        begins = np.cumsum([0] + [len(p[0]) for p in held])
        place = np.concatenate([p[4].astype(np.int64) + begin for p, begin in zip(held, begins, strict=False)])
        tf = np.concatenate([p[5] for p in held])
        order = np.argsort(term, kind="stable")
        term, place, tf = term[order], place[order], tf[order]
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        ratio = np.nextafter(np.minimum.reduceat(lengths[place] / tf, at).astype(np.float32), np.float32(0))
        head = _packed((term[at], np.uint64), (np.diff(np.append(at, len(term))), np.uint32), (np.maximum.reduceat(tf, at), np.uint32), (ratio, np.float32))
        body = _packed((docs, np.int64), (lengths, np.int64), (place, np.uint16), (tf, np.uint32))
        columns = [base + made, key[0], len(docs), int(lengths.sum()), len(at), len(term), head, body]
        made += 1
        held.clear()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

    for b in batches:
        for i in range(b.num_rows):
            cluster, part, n, n_terms, n_postings, body = (b.column(k)[i].as_py() for k in range(6))
            if held and ((cluster, part) != key or size + n > SHARD_DOCS):
                yield shard()
            if not held:
                key, size = (cluster, part), 0
            held.append(_piece(n, n_terms, n_postings, body))
            size += n
    if held:
        yield shard()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of ``docs``, staged: a row for each shard (``SHARD``)."""
    given = docs.select(whole_number_ids(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = given.mapInArrow(_cut(fitted(given)), PIECE)
    dealt = pieces.repartition(partitions(docs.sparkSession), "cluster", "part").sortWithinPartitions("cluster", "part")
    files = 1 + given.rdd.getNumPartitions() // 4
    return stage(dealt.coalesce(files).mapInArrow(_merged, SHARD), "lexical-index", "none")  # its columns are compressed already


@dataclass
class Asked:
    """A block of items: sorted terms, and each item's places among them."""

    items: list
    terms: np.ndarray
    of: np.ndarray  # places of all items' terms, item by item
    begin: np.ndarray
    weight: np.ndarray | None = None
    n: int = 0
    total: int = 0

    def present(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those terms that a shard has, among the asked and in the shard."""
        at = np.searchsorted(terms, self.terms)
        at = np.minimum(at, max(0, len(terms) - 1))
        here = np.flatnonzero(terms[at] == self.terms) if len(terms) else np.empty(0, np.int64)
        return here, at[here]

    def bounds(self, terms: np.ndarray, most: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """For each item no less than the score of any document of a shard."""
        here, at = self.present(terms)
        per = np.zeros(len(self.terms), np.int64)
        middle = 49.0 / most[at] + 50.0 * self.n / self.total * ratio[at]  # no more than m / tf
        per[here] = self.weight[here] * (np.floor(1e9 / (1000.0 + 20.0 * middle)).astype(np.int64) + 1)
        return np.add.reduceat(per[self.of], self.begin)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, SLICE_BYTES):
            term, row, _, _ = _lists(b.column(1))
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(term.view(np.int64))], names=["item", "term"])


def _heads(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each shard its row and its terms, list lengths, largest counts and least ratios."""
    for i in range(b.num_rows):
        n = b.column("n_terms")[i].as_py()
        yield i, _unpacked(b.column("head")[i].as_py(), (n, np.uint64), (n, np.uint32), (n, np.uint32), (n, np.float32))


def _counted(asked: Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for b in batches:
            for _, (terms, counts, _, _) in _heads(b):
                here, at = asked.present(terms)
                df[here] += counts[at]
        found = np.flatnonzero(df)
        yield pa.record_batch([pa.array(found), pa.array(df[found])], names=["at", "df"])

    return run


def _bounded(asked: Asked, first: int | None):
    """Rows (item, shard, bound) of the shards with a bound above 0; the ``first`` best of each item in a task, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, bounds = [], []
        for b in batches:
            for i, (terms, _, most, ratio) in _heads(b):
                bounds.append(asked.bounds(terms, most, ratio))
                shards.append(b.column("shard")[i].as_py())
                if first and len(shards) >= 8 * first + 64:  # keep those that are among the best of some item
                    kept = np.unique(np.argpartition(-np.stack(bounds), first - 1, axis=0)[:first])
                    shards, bounds = [shards[k] for k in kept], [bounds[k] for k in kept]
        if not shards:
            return
        table = np.stack(bounds)
        at = np.argsort(-table, axis=0, kind="stable")[:first] if first else np.argsort(-table, axis=0, kind="stable")
        item = np.broadcast_to(np.arange(table.shape[1]), at.shape)
        value = np.take_along_axis(table, at, 0)
        good = value > 0
        yield pa.record_batch([pa.array(item[good]), pa.array(np.array(shards)[at[good]]), pa.array(value[good])], names=["item", "shard", "bound"])

    return run


def _best_of(score: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, by falling score and rising id."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((docs[at], -score[at]))[:k]]


def _scored(asked: Asked, k: int, chosen: dict[int, list[int]], least: np.ndarray | None):
    """Scores of the ``chosen`` items of each shard; or, with ``least`` scores, of all items whose bound
    reaches theirs, the chosen left out. A task keeps the k best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor = np.ones(len(asked.items), np.int64) if least is None else least.copy()
        ends = np.append(asked.begin, len(asked.of))
        for b in batches:
            for i, (terms, counts, most, ratio) in _heads(b):
                mine = chosen.get(b.column("shard")[i].as_py(), [])
                if least is not None:
                    bound = asked.bounds(terms, most, ratio)
                    mine = np.setdiff1d(np.flatnonzero((bound >= floor) & (bound > 0)), np.array(mine, np.int64))
                if not len(mine):
                    continue
                n, size = b.column("n_docs")[i].as_py(), b.column("n_postings")[i].as_py()
                docs, lengths, place, tfs = _unpacked(b.column("body")[i].as_py(), (n, np.int64), (n, np.int64), (size, np.uint16), (size, np.uint32))
                middle = 50 + (50 * lengths * asked.n) // asked.total
                here, at = asked.present(terms)
                edge = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                lists: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(asked.terms)
                wanted = np.zeros(len(asked.terms), bool)
                for q in mine:
                    wanted[asked.of[ends[q] : ends[q + 1]]] = True
                for t, x in zip(here, at, strict=True):
                    if wanted[t]:
                        d, tf = place[edge[x] : edge[x + 1]], tfs[edge[x] : edge[x + 1]].astype(np.int64)
                        lists[t] = (d, asked.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * middle[d])))
                for q in mine:
                    score = np.zeros(len(docs), np.int64)
                    for t in asked.of[ends[q] : ends[q + 1]]:
                        if lists[t] is not None:
                            score[lists[t][0]] += lists[t][1]
                    best = _best_of(score, docs, k)
                    s, d = score[best], docs[best]
                    if q in kept:
                        s, d = np.concatenate([kept[q][0], s]), np.concatenate([kept[q][1], d])
                        best = _best_of(s, d, k)
                        s, d = s[best], d[best]
                    kept[q] = (s, d)
                    if len(s) == k:
                        floor[q] = max(floor[q], s[-1])
        for q, (s, d) in kept.items():
            s, d = (s, d) if least is None else (s[s >= least[q]], d[s >= least[q]])
            yield pa.record_batch([pa.array(np.full(len(s), q)), pa.array(d), pa.array(s)], names=["item", "doc", "score"])

    return run


def asked_blocks(index: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> Iterator[Asked]:
    """The items in blocks of about ``ITEMS``, with the weights of their terms."""
    spark = index.sparkSession
    given = queries.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = given.schema["item"].dataType.simpleString()
    words = given.mapInArrow(_terms_of, f"item {kind}, term long").distinct()
    words = stage(words.coalesce(1 + words.count() // TERMS_A_FILE), "asked-terms")
    blocks = 1 + words.select("item").distinct().count() // ITEMS
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    for k in range(blocks if n else 0):
        few = words.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "term").toArrow()  # a block of items
        if not few.num_rows:
            continue
        names = few.column("item").to_pylist()
        begin = np.array([i for i, x in enumerate(names) if not i or x != names[i - 1]], np.int64)
        terms, of = np.unique(few.column("term").to_numpy().view(np.uint64), return_inverse=True)
        asked = Asked([names[i] for i in begin], terms, of, begin, None, n, total)
        df = np.zeros(len(terms), np.int64)
        for r in index.select(*HEAD).mapInArrow(_counted(asked), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():  # a row for each term asked
            df[r["at"]] = r["df"]
        asked.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        yield asked


def _ranked(rows: DataFrame, by: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def _found(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    """Rows (item, doc, score, rank) of the k best of each item of a block, by its number there."""
    rows = "item long, doc long, score long"
    some = index.select(*HEAD).mapInArrow(_bounded(asked, FIRST), "item long, shard long, bound long")
    chosen: dict[int, list[int]] = {}
    for r in _ranked(some, [F.desc("bound"), "shard"], FIRST).collect():  # FIRST rows for each item of the block
        chosen.setdefault(r["shard"], []).append(r["item"])
    order = [F.desc("score"), "doc"]
    begun = _ranked(index.where(F.col("shard").isin(list(chosen))).mapInArrow(_scored(asked, k, chosen, None), rows), order, k)
    begun = stage(begun.coalesce(8), "lexical-first")  # k rows for each item of the block
    least = np.ones(len(asked.items), np.int64)
    for r in begun.where(F.col("rank") == k).collect():  # a row for each item of the block
        least[r["item"]] = r["score"]
    rest = index.mapInArrow(_scored(asked, k, chosen, least), rows)
    return _ranked(begun.drop("rank").unionByName(rest), order, k)


def search(index: DataFrame, queries: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = index.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for asked in asked_blocks(index, queries, id_col, text_col):
        names = spark.createDataFrame(list(enumerate(asked.items)), f"item long, item_id {kind}")
        found = _found(index, asked, k).join(F.broadcast(names), "item")  # a block of items
        out = out.unionByName(found.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score"))
    return out
