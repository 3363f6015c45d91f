"""Substring dedup by recompression: words that a repeated passage covers are removed.

A passage is a window of ``window`` consecutive words of one document; it is repeated if its
word sequence also starts anywhere else, in the same document or another.

Naming. A text is parsed in rounds, as in recompression: each round joins runs of equal symbols
and pairs whose left symbol falls in one half of the alphabet and whose right symbol falls in
the other (a coin from the symbol's name and the round), and names what it has joined. A name
is a hash of the words below the symbol, so all tasks give equal runs and pairs the same global
name without a shuffle for each round. Whether two neighbours join depends on those two names
only, so each symbol carries the stretch of words that its bounds depend on, its hull. Equal
windows hold the same symbols wherever their hulls lie inside.

Finding. Each window takes as anchor the symbol of the smallest name among those whose hull it
holds (a window that holds none, inside a long run or near no stable symbol, is its own
anchor). Neighbouring windows with one anchor form a group of some 47 words. A group has two
names: that of its anchor's hull and that of all its words. Only if the first occurs again can
a window of the group repeat; if the second occurs again, all its windows do and are verified
at once. What is left (an anchor that repeats among differing surroundings) is verified window
by window with 128-bit names, one copy standing for all groups of equal words.

How it runs: three passes over the text. (1) Groups, first settled inside each map task; one
record for each distinct name goes to the shuffle, packed. (2) Names of the windows that need
verification, settled in the same way. (3) The removal. The marks of each document travel by a
hash of its id and text; in passes 2 and 3 only texts that may have marks shuffle to them (a
Bloom filter of fixed size tells), all others stay where they are read. A passage that a third of all documents share leaves each task once,
and a frequent anchor with ever new surroundings is dealt by the surroundings, so no key
gathers in one task. Names are 64 bits for anchors and 128 bits for what is removed.

Defined cases: null and empty texts have no words and stay as they are; a text shorter than
the window loses nothing; of a repeated row both copies lose their windows; a null id stays
null; other columns are not touched; an empty table gives no rows. Texts of any length are
parsed in chunks that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packed import FINE, SCHEMA, by_part, deal, parted, split, stretches
from lodestone.llm.storage import partitions, row_key, stage
from lodestone.llm.wordhash import Ranges, Words, mix, slices, words_of

WINDOW = 35
ROUNDS = 4
SLICE = 2 << 20
HELD = 1 << 20
_CHUNK = 1 << 19
_FAR = np.int64(1) << 60

GROUP = np.dtype([("sym", "<u8"), ("all", "<u8"), ("key", "<i8"), ("at", "<u4"), ("n", "<u2"), ("flag", "u1")])
NAMED = np.dtype([("one", "<u8"), ("two", "<u8"), ("key", "<i8"), ("at", "<u4"), ("flag", "u1")])
MARK = np.dtype([("key", "<i8"), ("at", "<u4"), ("n", "<u4"), ("kind", "u1")])
#: Flags of a group: it occurs more than once in its task; its anchor has other groups in its task; a notice of such an anchor.
_MANY, _MIXED, _NOTICE = 1, 2, 4
#: Kinds of a mark: its windows repeat; verify its windows; verify, and they are known to repeat.
REPEATED, VERIFY, VERIFY_KNOWN = 0, 1, 2
_RECORDS, _MARKS = 0, 1


def parse(names: Ranges, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hulls (begin, end) of the symbols after all rounds, of those with a bounded hull, in order.

    ``first``: positions where documents begin.
    """
    begin = np.arange(n)
    end = begin + 1
    low, high = begin, end
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    for level in range(ROUNDS):
        name = names.of(begin, end)
        coin = (mix(name, level + 1) & np.uint64(1)).astype(bool)
        joined = ((name[:-1] == name[1:]) | (~coin[:-1] & coin[1:])) & ~opens[begin[1:]]
        head = np.flatnonzero(np.concatenate([[True], ~joined]))
        tail = np.concatenate([head[1:], [len(begin)]]) - 1
        before = low[np.maximum(head - 1, 0)]
        after = high[np.minimum(tail + 1, len(high) - 1)]
        low = np.where(opens[begin[head]], -1, before)
        high = np.where(opens[end[tail]], _FAR, after)
        begin, end = begin[head], end[tail]
    good = (low >= 0) & (high < _FAR)
    return low[good], high[good]


def smallest(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of the leftmost smallest value in each non-empty range [a, b)."""
    level = np.arange(len(value))
    levels = [level]
    most = int((b - a).max(initial=1))
    step = 1
    while 2 * step <= most:
        left, right = level[:-step], level[step:]
        level = np.concatenate([np.where(value[right] < value[left], right, left), level[-step:]])
        levels.append(level)
        step *= 2
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k, table in enumerate(levels):
        at = np.flatnonzero(power == k)
        if len(at):
            left, right = table[a[at]], table[b[at] - (1 << k)]
            out[at] = np.where(value[right] < value[left], right, left)
    return out


def groups(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Groups of windows with one anchor: anchor name, name of all words, first window, number of windows.

    ``row``: first word of each document, and the end of the last.
    """
    n = len(h)
    ends = np.repeat(row[1:], np.diff(row))
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    one, two = Ranges(h), Ranges(h, second=True)
    low, high = parse(one, row[:-1][np.diff(row) > 0], n)
    short = high - low <= window
    low, high = low[short], high[short]
    name = one.of(low, high)
    below = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=n))])
    upto = np.cumsum(np.bincount(high, minlength=n + 1))
    a, b = below[starts], upto[starts + window]
    anchor = np.full(len(starts), -1, np.int64)
    some = np.flatnonzero(a < b)
    if len(some):
        anchor[some] = smallest(name, a[some], b[some])
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    at, lead = starts[head], anchor[head]
    held = lead >= 0
    whole = two.of(at, at + count + window - 1)
    sym = one.of(at, at + window)
    sym[held] = name[lead[held]]
    whole[held] = mix(whole[held] + (low[lead[held]] - at[held]).astype(np.uint64))
    return sym, whole, at, count


def chunks(row: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Word stretches to parse at once: whole documents, or pieces of one that overlap by a window."""
    n = int(row[-1])
    if n <= _CHUNK + window:
        yield 0, n, row
        return
    for d in range(len(row) - 1):
        for a in range(int(row[d]), int(row[d + 1]), _CHUNK):
            b = min(a + _CHUNK + window - 1, int(row[d + 1]))
            yield a, b, np.array([0, b - a])


def _same(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of each record of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def merged(marks: np.ndarray) -> np.ndarray:
    """Marks with neighbours of one document and kind joined."""
    if len(marks) < 2:
        return marks
    m = marks[np.lexsort((marks["at"], marks["key"], marks["kind"]))]
    new = np.ones(len(m), bool)
    new[1:] = (m["key"][1:] != m["key"][:-1]) | (m["kind"][1:] != m["kind"][:-1]) | (m["at"][1:] != m["at"][:-1] + m["n"][:-1])
    head = np.flatnonzero(new)
    out = m[head]
    out["n"] = np.add.reduceat(m["n"], head)
    return out


def _marks(records: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    out = np.empty(len(records), MARK)
    out["key"], out["at"], out["kind"] = records["key"], records["at"], kind
    out["n"] = records["n"] if "n" in records.dtype.names else 1
    return out


def deal_marks(marks: np.ndarray, parts: int) -> pa.RecordBatch:
    marks = merged(marks)
    return deal(_MARKS, marks, marks["key"].view(np.uint64) % np.uint64(parts))


def _local_groups(g: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Settle the groups of a task: marks for what repeats in it, one record for each distinct group."""
    g = g[np.lexsort((g["all"], g["sym"]))]
    same = _same(g["sym"], g["all"])
    head = np.flatnonzero(np.diff(same, prepend=-1))
    many = np.bincount(same) > 1
    yield deal_marks(_marks(g[many[same]], REPEATED), parts)
    one = g[head]
    one["flag"] = many * np.uint8(_MANY)
    sym = _same(one["sym"])
    mixed = (np.bincount(sym) > 1)[sym]
    one["flag"] |= mixed * np.uint8(_MIXED)
    notices = one[np.flatnonzero((np.diff(sym, prepend=-1) > 0) & mixed)].copy()
    notices["flag"] = _NOTICE
    out = np.concatenate([one, notices])
    by = np.where(out["flag"] & _MIXED, out["all"], out["sym"])
    yield deal(_RECORDS, out, mix(by) % np.uint64(parts))


def _settle_groups(g: np.ndarray) -> np.ndarray:
    """Marks from the records of all tasks that share their dealing name."""
    found = []
    mixed = (g["flag"] & _MIXED) > 0
    for part, free in ((g[~mixed], True), (g[mixed], False)):
        if not len(part):
            continue
        part = part[np.lexsort((part["all"], part["sym"]))]
        notice = (part["flag"] & _NOTICE) > 0
        sym = _same(part["sym"])
        told = np.bincount(sym, weights=notice) > 0
        part, sym = part[~notice], sym[~notice]
        if not len(part):
            continue
        same = _same(part["sym"], part["all"])
        head = np.flatnonzero(np.diff(same, prepend=-1))
        again = (np.bincount(same) > 1) | (np.bincount(same, weights=part["flag"] & _MANY) > 0)
        kinds = np.bincount(sym[head], minlength=len(told))
        ask = (told | (kinds > 1))[sym] if free else np.ones(len(part), bool)
        fresh = again[same] & ((part["flag"] & _MANY) == 0)
        found.append(_marks(part[fresh], REPEATED))
        lead = np.zeros(len(part), bool)
        lead[head] = True
        lead &= ask
        found.append(_marks(part[lead], np.where(again[same[lead]], VERIFY_KNOWN, VERIFY)))
    return np.concatenate(found) if found else np.empty(0, MARK)


def _local_names(w: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    w = w[np.lexsort((w["two"], w["one"]))]
    same = _same(w["one"], w["two"])
    head = np.flatnonzero(np.diff(same, prepend=-1))
    again = (np.bincount(same) > 1) | (np.bincount(same, weights=w["flag"]) > 0)
    yield deal_marks(_marks(w[again[same] & (w["flag"] == 0)], REPEATED), parts)
    one = w[head]
    one["flag"] = again
    yield deal(_RECORDS, one, mix(one["two"]) % np.uint64(parts))


def _settle_names(w: np.ndarray) -> np.ndarray:
    if not len(w):
        return np.empty(0, MARK)
    w = w[np.lexsort((w["two"], w["one"]))]
    same = _same(w["one"], w["two"])
    again = (np.bincount(same) > 1) | (np.bincount(same, weights=w["flag"]) > 0)
    return _marks(w[again[same] & (w["flag"] == 0)], REPEATED)


def _settling(kind: np.dtype, settle, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in split(batches, {_RECORDS: kind}, (_MARKS,)):
            if isinstance(got, dict):
                yield deal_marks(settle(got[_RECORDS]), parts)
            else:
                yield got

    return run


def with_marks(batches: Iterator[pa.RecordBatch], wanted: tuple[int, ...]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(marks of a part sorted by key, batch of its documents), from rows in which each part's marks come first."""
    at, held, marks = None, [], None
    for b in batches:
        is_doc = b.column("doc").to_numpy() == 1
        for part, a, z in stretches(b.column("part").to_numpy()):
            if part != at:
                at, held, marks = part, [], None
            piece, docs = b.slice(a, z - a), is_doc[a:z]
            for i in np.flatnonzero(~docs):
                m = np.frombuffer(piece.column("data")[i].as_buffer(), MARK)
                held.append(m[np.isin(m["kind"], wanted)])
            if docs.any():
                if marks is None:
                    marks = np.concatenate(held) if held else np.empty(0, MARK)
                    marks = marks[np.argsort(marks["key"], kind="stable")]
                yield marks, piece.filter(pa.array(docs)) if not docs.all() else piece


def marks_of_rows(marks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``marks`` of the marks of each row, one after the other, and the row of each."""
    a, b = np.searchsorted(marks["key"], keys, "left"), np.searchsorted(marks["key"], keys, "right")
    rows = np.repeat(np.arange(len(keys)), b - a)
    return np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(rows)), rows


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def beside_marks(keyed: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """Documents and the marks of their keys in one partition, part by part, marks first."""
    fine = parts * FINE
    part = F.expr(f"cast(pmod(pmod(key, {fine}L) + if(key < 0, {2**64 % fine}L, 0L), {fine}L) as int)")
    docs = keyed.select(F.lit(1).alias("doc"), part.alias("part"), F.lit(None).cast("binary").alias("data"), "doc_id", "key", "text")
    kind = keyed.schema["doc_id"].dataType
    other = marks.select(F.lit(0).alias("doc"), "part", "data", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("text"))
    return by_part(docs.unionByName(other), parts, "doc").select("part", "doc", "data", "doc_id", "key", "text")


def marked_keys(marks: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """Keys of the documents that have marks of some kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                m = np.frombuffer(data.as_buffer(), MARK)
                yield pa.record_batch([pa.array(np.unique(m["key"][np.isin(m["kind"], wanted)]))], names=["key"])

    return marks.select("data").mapInArrow(run, "key long")


def over_marks(keyed: DataFrame, marks: DataFrame, change, schema: str, wanted: tuple[int, ...] = (REPEATED,)) -> DataFrame:
    """``change(marks, batch of doc_id, key, text)`` over all documents, those without marks in place."""
    hit, rest = parted(keyed, marked_keys(marks, wanted))
    none = np.empty(0, MARK)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, b in with_marks((b for b in batches if b.num_rows), wanted):
            yield from change(found, b.select(["doc_id", "key", "text"]))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from change(none, b)

    beside = beside_marks(hit, marks, partitions(keyed.sparkSession)).mapInArrow(marked, schema)
    return rest.select("doc_id", "key", "text").mapInArrow(plain, schema).unionByName(beside)


def repeated_marks(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged marks (part, data) of all windows that repeat, by the key of their document."""
    parts = partitions(keyed.sparkSession)
    fine = parts * FINE

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for b in slices(batch, SLICE):
                w, keys = words_of(b.column(1)), b.column(0).to_numpy()
                for a, z, row in chunks(w.row, window):
                    sym, whole, at, n = groups(w.hash[a:z], row, window)
                    doc = np.searchsorted(w.row, at + a, "right") - 1
                    g = np.empty(len(at), GROUP)
                    g["sym"], g["all"], g["key"], g["at"], g["n"], g["flag"] = sym, whole, keys[doc], at + a - w.row[doc], n, 0
                    held.append(g)
                if sum(map(len, held)) >= HELD:
                    yield from _local_groups(np.concatenate(held), fine)
                    held = []
        if held and sum(map(len, held)):
            yield from _local_groups(np.concatenate(held), fine)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for marks, batch in with_marks((b for b in batches if b.num_rows), (VERIFY, VERIFY_KNOWN)):
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            asked = pa.record_batch([pa.array(keys), batch.column("text")], names=["key", "text"]).filter(pa.array(np.isin(keys, marks["key"])))
            for b in slices(asked, SLICE):
                w, keys = words_of(b.column(1)), b.column(0).to_numpy()
                at, rows = marks_of_rows(marks, keys)
                m = marks[at]
                n = m["n"].astype(np.int64)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(m["at"].astype(np.int64), n) + within
                begin = start + w.row[np.repeat(rows, n)]
                one, two = Ranges(w.hash), Ranges(w.hash, second=True)
                x = np.empty(len(start), NAMED)
                x["one"], x["two"] = one.of(begin, begin + window), two.of(begin, begin + window)
                x["key"], x["at"], x["flag"] = np.repeat(keys[rows], n), start, np.repeat(m["kind"] == VERIFY_KNOWN, n)
                held.append(x)
                if sum(map(len, held)) >= HELD:
                    yield from _local_names(np.concatenate(held), fine)
                    held = []
        if held and sum(map(len, held)):
            yield from _local_names(np.concatenate(held), fine)

    found = keyed.select("key", "text").mapInArrow(first_pass, SCHEMA)
    marks = stage(by_part(found, parts).mapInArrow(_settling(GROUP, _settle_groups, fine), SCHEMA).select("part", "data"), "substring-groups", "lz4")
    asked = parted(keyed, marked_keys(marks, (VERIFY, VERIFY_KNOWN)))[0]
    named = beside_marks(asked, marks, parts).mapInArrow(second_pass, SCHEMA)
    more = stage(by_part(named, parts).mapInArrow(_settling(NAMED, _settle_names, fine), SCHEMA).select("part", "data"), "substring-windows", "lz4")
    return marks.unionByName(more)


def kept_bytes(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each row, each word followed by one space, and the offsets of the rows."""
    start, size = w.start[keep], (w.end - w.start)[keep] + 1
    stop = np.cumsum(size)
    take = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)
    out = np.append(w.data, np.uint8(32))[take]
    out[stop - 1] = 32
    before = np.concatenate([[0], np.cumsum(keep)])
    return out, np.concatenate([[0], stop])[before[w.row]]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    keyed = keyed_documents(docs, id_col, text_col)
    marks = repeated_marks(keyed, window)

    def change(marks: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in slices(batch, SLICE):
            w, keys = words_of(b.column(2)), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at, rows = marks_of_rows(marks, keys)
            begin = w.row[rows] + marks["at"][at]
            edge = np.bincount(begin, minlength=len(w.hash) + 1) - np.bincount(begin + marks["n"][at] + window - 1, minlength=len(w.hash) + 1)
            gone = np.cumsum(edge)[: len(w.hash)] > 0
            data, off = kept_bytes(w, ~gone)
            texts = [data[a : max(a, z - 1)].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
            lost = np.concatenate([[0], np.cumsum(gone)])
            cols = [b.column(0), pa.array(np.diff(w.row)), pa.array(np.diff(lost[w.row])), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.record_batch(cols, names=names)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return over_marks(keyed, marks, change, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
