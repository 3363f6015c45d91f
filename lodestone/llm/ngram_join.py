"""N-gram Jaccard join by signature trees, and the groups that its links form.

Two documents link when their sets of word n-grams have a Jaccard similarity of at least
``percent`` hundredths. No link is lost: every step below keeps each pair that can link, and each
link is verified on the whole sets of 64-bit n-gram hashes.

1. Classes. Documents with equal sets are one class, named by a hash of the set.
2. Routing. Linked sets share one of their first ``n - ceil(0.75 n) + 1`` n-grams in any fixed
   order. The order puts rare ones first, by a sketch of 2**20 counters over all documents (one
   megabyte, the only broadcast; any sketch gives right results, a good one small buckets). An
   n-gram that several classes hold among their first ones makes a bucket; buckets break where
   neighbouring sizes lie too far apart. All buckets with the same smallest class form a
   neighbourhood, so each pair that shares a bucket meets in one. N-grams of hot cells of the
   sketch (over 1/65,536 of all n-grams) are not gathered: their smallest class is reduced in map
   tasks, so an n-gram that a third of all documents share lies in no single task.
3. Signature trees. A neighbourhood first gets only summaries of its sets: size and bitmap (some
   two bits for each n-gram). The summaries, ordered by size, are leaves of a tree whose nodes hold
   the OR of their bitmaps, the range of their sizes, and the most n-grams that share bits in one
   of them. Traversing the tree against itself, a pair of nodes is dropped if its sizes are too far
   apart, if the bits in common bound the overlap below what a link needs, or if all its leaves
   are in one group already. Leaf pairs that remain join into groups of sets that may link, and
   sets without any such partner go no further.
4. Verification. The whole sets of each group meet, in a tree again, and the leaf pairs that remain
   are counted exactly, many at once. So copies cost one comparison each and are not expanded into
   pairs.
5. A neighbourhood of too many members is dealt out in blocks that each hold its smallest class;
   only if its members are not one component after that, the summaries of pairs of blocks meet too.
6. Connected components of the links, by alternating stars, with checkpoints. Each class takes the
   smallest id of its component; classes and components of very many members join by a broadcast of
   bounded size.

Defined cases: null and empty texts have an empty set and link with nothing; a text of fewer
than n words has its whole sequence as the one member of its set; repeated rows are in one
class; a null id never names a component unless all ids of the component are null; texts may be of
any length; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.exact_dedup import joined_groups
from lodestone.llm.packed import FINE, by_part, parted
from lodestone.llm.storage import partitions, row_key, stage
from lodestone.llm.wordhash import Ranges, mix, slices, words_of

WORDS = 5
PERCENT = 75
CELLS = 1 << 20
SEGMENT = 1 << 16
HOT_CELLS, LEAST_HOT = 1 << 16, 32
BITMAP = 2048
FAN = 16
MOST_MEMBERS = 256
MOST_NGRAMS = 4 << 20
DENSE = 64 << 20
SLICE = 2 << 20
HELD = 1 << 21

HEAD = np.dtype([("tok", "<u8"), ("n", "<u4"), ("cls", "<i8")])


def ngram_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; letters A-Z count as a-z."""
    w = words_of(column, lower=True)
    ranges = Ranges(w.hash)
    for a, z in zip(w.row[:-1], w.row[1:], strict=True):
        if z - a >= words:
            at = np.arange(a, z - words + 1)
            yield np.unique(ranges.of(at, at + words))
        elif z > a:
            yield ranges.of(np.array([a]), np.array([z]))
        else:
            yield np.empty(0, np.uint64)


def class_name(grams: np.ndarray) -> int:
    """A hash of the set, as a signed long; 0 for the empty set."""
    if not len(grams):
        return 0
    at = np.arange(len(grams), dtype=np.uint64)
    return int((mix(mix(grams) + mix(at, 3)).sum(dtype=np.uint64) | np.uint64(1)).astype(np.int64))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def frequency_levels(docs: DataFrame, words: int = WORDS, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Quantised counts of n-grams in a sketch of ``CELLS`` cells, one byte each, and the level from which
    a cell holds more than a ``1 / HOT_CELLS`` part of all n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for b in slices(batch, SLICE):
                w = words_of(b.column(0), lower=True)
                at = np.arange(max(0, len(w.hash) - words + 1))
                end = np.repeat(w.row[1:], np.diff(w.row))[: len(at)]
                at = at[at + words <= end]
                cells += np.bincount((Ranges(w.hash).of(at, at + words) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        cells = np.minimum(cells, 65535).astype("<u2")
        parts = np.arange(0, CELLS, SEGMENT)
        yield pa.record_batch([pa.array(parts // SEGMENT, pa.int32()), pa.array([cells[a : a + SEGMENT].tobytes() for a in parts], pa.binary())], names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                totals.setdefault(part, np.zeros(SEGMENT, np.int64))
                totals[part] += np.frombuffer(data.as_buffer(), "<u2")
        for part, total in totals.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([_level(total).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["part", "data", "n"])

    sums = by_part(_texts(docs, text_col).mapInArrow(count, "part int, data binary"), CELLS // SEGMENT).mapInArrow(add, "part int, data binary, n long")
    levels, every = np.zeros(CELLS, np.uint8), 0
    for part, data, n in sums.collect():  # one megabyte, whatever the input
        levels[part * SEGMENT : (part + 1) * SEGMENT] = np.frombuffer(data, np.uint8)
        every += n
    return levels, max(int(_level(np.array([every / HOT_CELLS]))[0]), LEAST_HOT)


def _level(count: np.ndarray) -> np.ndarray:
    return (4 * np.log2(count + 1)).astype(np.uint8)


def first_grams(grams: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams by which a set is routed: the first ones in the order of the sketch."""
    n = len(grams)
    p = n - (-(-percent * n // 100)) + 1
    spread = mix(grams, 1)
    key = (levels[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (spread >> np.uint64(8))
    return grams[np.argpartition(key, p - 1)[:p]] if p < n else grams


def neighbourhoods(heads: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pivot, member, size) of the buckets of some routed n-grams."""
    none = np.empty(0, np.int64)
    if not len(heads):
        return none, none, none
    h = heads[np.lexsort((heads["cls"], heads["n"], heads["tok"]))]
    same = np.zeros(len(h), bool)
    same[1:] = (h["tok"][1:] == h["tok"][:-1]) & (h["cls"][1:] == h["cls"][:-1])
    h = h[~same]
    new = np.ones(len(h), bool)
    n = h["n"].astype(np.int64)
    new[1:] = (h["tok"][1:] != h["tok"][:-1]) | (percent * n[1:] > 100 * n[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    pivot = np.repeat(np.minimum.reduceat(h["cls"], at), count)
    keep = (np.repeat(count, count) > 1) & (pivot != h["cls"])
    found = np.stack([pivot[keep], h["cls"][keep], n[keep]])
    found = np.unique(found, axis=1) if found.size else found
    return found[0], found[1], found[2]


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of a set: a power of 8 times ``BITMAP``, so that at most half of them are used."""
    bits = BITMAP
    while 4 * n > 3 * bits:
        bits *= 8
    return bits


def bitmap(grams: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as the words of a smaller one of ``size`` bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, size // 8), axis=0).view(np.uint64)


class SignatureTree:
    """Sets in the order of size under nodes of OR-ed bitmaps and ranges of sizes.

    ``group``: what is joined already; pairs of one group are not looked at. ``apart``: sets of which
    no two are to be paired here.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, percent: int, group: np.ndarray, apart: np.ndarray | None = None):
        self.order = np.argsort(size, kind="stable")
        self.percent = percent
        self.size = size[self.order].astype(np.int64)
        self.group = group[self.order].copy()
        self.apart = None if apart is None else apart[self.order]
        bits = bits[self.order]
        # levels of (bitmaps, smallest and largest size, most n-grams beyond one a bit)
        self.levels = [(bits, self.size, self.size, self.size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, over = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(over, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below nodes a and nodes b (all combinations) can link."""
        bits, lo, hi, over = self.levels[level]
        p = self.percent
        near = (100 * hi[a][:, None] >= p * lo[b][None]) & (100 * hi[b][None] >= p * lo[a][:, None])
        shared = np.bitwise_count(bits[a][:, None] & bits[b][None]).sum(axis=2, dtype=np.int64)
        most = np.minimum(shared + np.minimum(over[a][:, None], over[b][None]), np.minimum(hi[a][:, None], hi[b][None]))
        return near & (most * (100 + p) >= p * (lo[a][:, None] + lo[b][None]))

    def _one(self, level: int, a: int, b: int) -> bool:
        """Whether all leaves below two nodes are in one group."""
        width = FAN**level
        x, y = self.group[a * width : (a + 1) * width], self.group[b * width : (b + 1) * width]
        return bool((x == x[0]).all() and (y == x[0]).all())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs that can link and are in different groups, some at a time; the caller joins groups meanwhile."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level == 0 or self._one(level, a, b):
                continue
            width = len(self.levels[level - 1][0])
            below_a, below_b = (np.arange(FAN * x, min(FAN * x + FAN, width)) for x in (a, b))
            i, j = np.nonzero(self._possible(level - 1, below_a, below_b))
            x, y = below_a[i], below_b[j]
            if level > 1:
                stack += [(level - 1, int(u), int(v)) for u, v in zip(x, y, strict=True) if u <= v]
                continue
            wanted = (x < y) & (self.group[x] != self.group[y])
            if self.apart is not None:
                wanted &= ~(self.apart[x] & self.apart[y])
            if wanted.any():
                yield x[wanted], y[wanted]

    def join(self, a: int, b: int) -> bool:
        """Put two leaves in one group; whether that was new."""
        x, y = self.group[a], self.group[b]
        if x != y:
            self.group[self.group == y] = x
        return bool(x != y)


def possible_groups(size: np.ndarray, bits: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """For each set the group of sets that it may link to, by summaries alone; -1 without any.

    Sets of one label are linked already and need no partner among each other. Bitmaps of
    different sizes meet in the smaller size.
    """
    up = np.arange(len(size))
    met = np.zeros(len(size), bool)
    width = np.array([8 * len(b) for b in bits])
    for w in np.unique(width):
        own = width == w
        at = np.flatnonzero(own | ((width == 8 * w) & (percent * size <= 100 * size[own].max())))
        tree = SignatureTree(np.stack([folded(bits[i], int(w)) for i in at]), size[at], percent, up[at], ~own[at])
        names = label[at][tree.order]
        for x, y in tree.pairs():
            differ = names[x] != names[y]
            for a, b in zip(x[differ].tolist(), y[differ].tolist(), strict=True):
                tree.join(a, b)
                met[at[tree.order[[a, b]]]] = True
        if not met[at].any():
            continue
        # what one tree joined holds for the next
        found = np.empty(len(at), np.int64)
        found[tree.order] = tree.group
        for g in np.unique(found):
            names_of = np.unique(up[at[found == g]])
            up[np.isin(up, names_of)] = names_of[0]
    return np.where(met, up, -1)


def _dense(sets: list[np.ndarray]) -> np.ndarray | None:
    """Bitmaps over the n-grams that several sets hold, exact; None where they would take too much memory."""
    every = np.concatenate(sets)
    grams, at, count = np.unique(every, return_inverse=True, return_counts=True)
    often = count > 1
    width = -(-int(often.sum()) // 64) * 64
    if not width or len(sets) * width // 8 > DENSE:
        return np.zeros((len(sets), 1), np.uint64) if not width else None
    place = np.where(often, np.cumsum(often) - 1, -1)[at]
    out = np.empty((len(sets), width // 64), np.uint64)
    ends = np.cumsum([len(x) for x in sets])
    for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        row = np.zeros(width, bool)
        mine = place[a:z]
        row[mine[mine >= 0]] = True
        out[i] = np.packbits(row).view(np.uint64)
    return out


def links(sets: list[np.ndarray], percent: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is connected, verified on the whole sets: positions in the given sets."""
    size = np.array([len(x) for x in sets])
    tree = SignatureTree(np.stack([bitmap(x, BITMAP).view(np.uint64) for x in sets]), size, percent, label)
    sets = [sets[i] for i in tree.order]
    dense = _dense(sets)
    found = []
    for x, y in tree.pairs():
        if dense is not None:
            both = np.bitwise_count(dense[x] & dense[y]).sum(axis=1, dtype=np.int64)
            good = 100 * both >= percent * (tree.size[x] + tree.size[y] - both)
            x, y = x[good], y[good]
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if tree.group[a] == tree.group[b]:
                continue
            if dense is None:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both < percent * int(tree.size[a] + tree.size[b] - both):
                    continue
            tree.join(a, b)
            found.append((int(tree.order[a]), int(tree.order[b])))
    return found


def _by_group(keys: int, settle: Callable[[list[list]], Iterator[pa.RecordBatch]]):
    """Runs of rows with equal first ``keys`` columns, each given to ``settle`` as one list for each other column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
            for i, name in enumerate(names):
                if name != group:
                    if len(held) > 1:
                        yield from settle(group, held)
                    group, held = name, []
                held.append([b.column(k)[i].as_py() for k in range(keys, b.num_columns)])
        if len(held) > 1:
            yield from settle(group, held)

    return run


def _summarised(members: DataFrame, percent: int) -> DataFrame:
    """Of ``members(pivot, block, cls, key, n, bits, label)`` those that may link, staged: (pivot, block, part, cls, key, label)."""

    def settle(group: tuple, rows: list[list]) -> Iterator[pa.RecordBatch]:
        once = list({r[0]: r for r in rows}.values())
        names = {x: i for i, x in enumerate(sorted({r[4] for r in once}))}
        part = possible_groups(np.array([r[2] for r in once]), [np.frombuffer(r[3], np.uint8) for r in once], np.array([names[r[4]] for r in once]), percent)
        kept = [(*group, int(p), r[0], r[1], r[4]) for p, r in zip(part, once, strict=True) if p >= 0]
        if kept:
            cols = zip(*kept, strict=True)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["pivot", "block", "part", "cls", "key", "label"])

    dealt = members.select("pivot", "block", "cls", "key", "n", "bits", "label").repartition("pivot", "block").sortWithinPartitions("pivot", "block")
    return stage(dealt.mapInArrow(_by_group(2, settle), "pivot long, block long, part long, cls long, key long, label long"), "ngram-possible")


def _verified(docs: DataFrame, possible: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links of the groups that ``_summarised`` gives, staged."""
    targets = possible.groupBy("key").agg(F.collect_list(F.struct("pivot", "block", "part", "cls", "label")).alias("groups"))
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    where = ("pivot", "block", "part", "cls", "label")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, SLICE):
                for groups, grams in zip(b.column(0).to_pylist(), ngram_sets(b.column(1), words), strict=True):
                    cols = [pa.array([g[k] for g in groups], pa.int64()) for k in where]
                    yield pa.record_batch([*cols, pa.array([grams.tobytes()] * len(groups), pa.binary())], names=[*where, "data"])

    def settle(group: tuple, rows: list[list]) -> Iterator[pa.RecordBatch]:
        once = list({r[0]: r for r in rows}.values())
        names = {x: i for i, x in enumerate(sorted({r[1] for r in once}))}
        found = links([np.frombuffer(r[2], np.uint64) for r in once], percent, np.array([names[r[1]] for r in once]))
        if found:
            yield pa.record_batch([pa.array([once[i][0] for i, _ in found], pa.int64()), pa.array([once[j][0] for _, j in found], pa.int64())], names=["a", "b"])

    wanted = parted(keyed, possible.select("key"))[0]
    sent = wanted.join(targets.hint("merge"), "key").select("groups", "text").mapInArrow(sets, ", ".join(f"{k} long" for k in where) + ", data binary")
    dealt = sent.repartition("pivot", "block", "part").sortWithinPartitions("pivot", "block", "part")
    return stage(dealt.mapInArrow(_by_group(3, settle), "a long, b long"), "ngram-links")


_HOME, _HOT, _NEAR = 0, 1, 2


def _route(docs: DataFrame, levels, words: int, percent: int, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Staged rows (what, doc_id, key, tok, cls, n, bits): documents with their class, classes of hot n-grams,
    and members of neighbourhoods (``tok`` is the neighbourhood's smallest class)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fine = parts * FINE
    names = ["part", "data", "what", "doc_id", "key", "tok", "cls", "n", "bits"]
    schema = f"part int, data binary, what int, doc_id {kind}, key long, tok long, cls long, n long, bits binary"

    def rows(id_type, part, data=None, what=_NEAR, doc_id=None, key=None, tok=None, cls=None, n=None, bits=None) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        size = len(part)
        given = [part, data, [what] * size, doc_id, key, tok, cls, n, bits]
        return pa.record_batch([pa.nulls(size, t) if c is None else c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(given, kinds, strict=True)], names=names)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hot_from = levels.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush(id_type) -> Iterator[pa.RecordBatch]:
            r = np.concatenate(held)
            part = (mix(r["tok"]) % np.uint64(fine)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            r, part = r[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            yield rows(id_type, part[cuts], [r[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(r)], strict=True)])

        id_type = pa.int64()
        for batch in batches:
            for b in slices(batch, SLICE):
                own, sizes, maps = [], [], []
                id_type = b.column(0).type
                often: list[np.ndarray] = []
                for grams in ngram_sets(b.column(2), words):
                    cls = class_name(grams)
                    own.append(cls)
                    sizes.append(len(grams))
                    maps.append(None)
                    if cls in seen or not len(grams):
                        continue
                    seen.add(cls)
                    maps[-1] = bitmap(grams, bitmap_bits(len(grams))).tobytes()
                    first = first_grams(grams, level, percent)
                    r = np.empty(len(first), HEAD)
                    r["tok"], r["n"], r["cls"] = mix(first, 2), len(grams), cls
                    hot = level[(first & np.uint64(CELLS - 1)).astype(np.int64)] >= hot_from
                    often.append(r[hot])
                    held.append(r[~hot])
                    size += len(held[-1])
                home = b.column(1).to_numpy().view(np.uint64) % np.uint64(fine)  # rows of one class need not meet
                yield rows(id_type, home.astype(np.int64), None, _HOME, b.column(0), b.column(1), None, own, sizes, maps)
                if sum(map(len, often)):
                    r = np.concatenate(often)
                    spread = (mix(r["tok"] + r["cls"].view(np.uint64)) % np.uint64(fine)).astype(np.int64)
                    yield rows(id_type, spread, None, _HOT, None, None, r["tok"].view(np.int64), r["cls"], r["n"].astype(np.int64))
                if size > HELD:
                    yield from flush(id_type)
                    held, size = [], 0
                    seen = set()
        if size:
            yield from flush(id_type)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = id_type = None

        def close() -> Iterator[pa.RecordBatch]:
            pivot, member, n = neighbourhoods(np.concatenate(held), percent)
            held.clear()
            if len(pivot):
                yield rows(id_type, np.zeros(len(pivot), np.int64), tok=pivot, cls=member, n=n)

        for b in batches:
            id_type = b.column(3).type
            packed = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            parts_of = b.column(0).to_numpy()
            for i in np.flatnonzero(packed):
                if parts_of[i] != at and held:
                    yield from close()
                at = parts_of[i]
                held.append(np.frombuffer(b.column(1)[i].as_buffer(), HEAD))
            if not packed.all():
                yield b.filter(pa.array(~packed))
        if held:
            yield from close()

    texts = docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    routed = by_part(texts.mapInArrow(heads, schema), parts).mapInArrow(meet, schema)
    return stage(routed.drop("part", "data"), "ngram-routed")


def _neighbourhood_pairs(routed: DataFrame) -> DataFrame:
    """Distinct (pivot, cls, n) of all neighbourhoods; a pivot is no member of its own."""
    near = routed.where(F.col("what") == _NEAR).select(F.col("tok").alias("pivot"), "cls", "n")
    hot = routed.where(F.col("what") == _HOT).select("tok", "cls", "n")
    least = hot.groupBy("tok").agg(F.min("cls").alias("pivot"))
    return near.unionByName(hot.join(least, "tok").where("cls <> pivot").select("pivot", "cls", "n")).distinct()


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", most_members: int = MOST_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(documents with class: doc_id, cls, n; classes with their component: node, component)."""
    spark: SparkSession = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequency_levels(docs, words, text_col))
    routed = _route(docs, levels, words, percent, partitions(spark), id_col, text_col)
    classed = routed.where(F.col("what") == _HOME).select("doc_id", "key", "cls", "n", "bits")
    pairs = _neighbourhood_pairs(routed)
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / most_members), F.ceil(F.col("total") / MOST_NGRAMS)).cast("long")
    sizes = sizes.select("pivot", blocks.alias("blocks"))
    own = pairs.join(sizes, "pivot").select("pivot", "blocks", F.expr("pmod(xxhash64(cls), blocks)").alias("block"), "cls")
    lead = sizes.select("pivot", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("cls"))
    homes = classed.where("bits IS NOT NULL").groupBy("cls").agg(F.min(F.struct("key", "n", "bits")).alias("home"))
    members = stage(own.unionByName(lead).join(homes, "cls").select("pivot", "blocks", "block", "cls", "home.key", "home.n", "home.bits"), "ngram-members")
    links = _verified(docs, _summarised(members.withColumn("label", F.col("cls")), percent), words, percent, id_col, text_col)
    found = components(links)
    wide = members.where("blocks > 1")
    if not wide.isEmpty():
        named = wide.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
        split = named.groupBy("pivot").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("pivot")
        # each member's summary to the pairs of its block with every other block of the neighbourhood
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        paired = named.join(split, "pivot").where("cls <> pivot").select("*", other).where("other <> block")
        paired = paired.withColumn("block", F.expr("least(block, other) * blocks + greatest(block, other)"))
        more = _verified(docs, _summarised(paired, percent), words, percent, id_col, text_col)
        found = components(links.unionByName(more))
    return classed.select("doc_id", "cls", "n"), found


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", most_members: int = MOST_MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    classed, found = similar_classes(docs, words, percent, id_col, text_col, most_members)
    alone = classed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    every = classed.count()
    classes = classed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    joined = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    named = stage(joined.select("cls", "low", "rows", F.coalesce("component", "cls").alias("component")), "ngram-classes")
    parts = stage(named.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("classes")), "ngram-components")
    table = stage(joined_groups(named, parts, "classes", every, "component").select("cls", "component_id", "rows"), "ngram-named")
    linked = joined_groups(classed.where("n > 0"), table, "rows", every, "cls")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group the document with the smallest id.

    Rows are dropped by id, so rows that repeat an id stay or go together; rows with a null id stay.
    """
    groups = similar_groups(docs, words, percent, id_col, text_col)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(stage(gone, "ngram-dropped"), id_col, "left_anti")
