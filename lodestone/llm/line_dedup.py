"""Line dedup by winnowing: later copies of repeated runs of lines are deleted.

A run is ``run`` consecutive lines of one document. A line is deleted if it lies in a run whose
lines also start at an earlier place: a smaller id, or earlier in the same document. Lines that
hold only white space are neither counted nor deleted.

Each window of ``run`` line hashes selects its smallest hash as fingerprint (the last of equal
ones), so two places that share a run are sure to share a fingerprint at the same place in it.
Fingerprints meet by hash with the ``run - 1`` lines before and after them; matches extend both
ways over these lines, as far as a run reaches, and of equal runs all but the earliest place is
marked. Neighbouring marks join to longer runs.

How it runs: pass 1 counts fingerprints, reduced in map tasks. Those that hold more than a
``1 / HOT`` part of all places, at most ``HOT`` of them, are the hot ones; they are broadcast.
Pass 2 deals the places by fingerprint, but places of hot ones by the hash of each run, so a
very common line among ever new neighbours spreads over all tasks. Copies inside a map task are
settled there. Pass 3 deletes; only texts that may have marks shuffle to them.

Defined cases: null and empty texts have no lines and stay; a null id counts as later than all
others; rows with equal id and text count as one place, so both keep or lose the same lines; ids order
the copies and must be whole numbers, others are refused; texts may be of any length; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packed import FINE, SCHEMA, by_part, deal, split
from lodestone.llm.storage import partitions, stage, whole_number_ids
from lodestone.llm.substring_dedup import MARK, REPEATED, deal_marks, keyed_documents, marks_of_rows, over_marks
from lodestone.llm.wordhash import mix

RUN = 3
HOT = 4096
HELD = 1 << 19
_LAST = np.iinfo(np.int64).max
_PLACES, _RUNS = 0, 2
_BLANK = " \t\n\v\f\r"

RUNS = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4")])


def place_type(run: int) -> np.dtype:
    return np.dtype([("print", "<u8"), ("lines", "<u8", (2 * run - 1,)), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])


def line_hashes(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines of a text, the positions of those that count, and their hashes (never 0)."""
    lines = (text or "").split("\n") if text else []
    counted = [i for i, x in enumerate(lines) if x.strip(_BLANK)]
    return lines, np.array(counted, np.int64), np.array([xxhash.xxh3_64_intdigest(lines[i]) | 1 for i in counted], np.uint64)


def fingerprints(h: np.ndarray, run: int) -> np.ndarray:
    """Positions that some window of ``run`` hashes selects."""
    if len(h) < run:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, run)
    at = run - 1 - np.argmin(windows[:, ::-1], axis=1)
    return np.unique(np.arange(len(windows)) + at)


def _places(h: np.ndarray, at: np.ndarray, run: int, doc: int, key: int) -> np.ndarray:
    padded = np.concatenate([np.zeros(run - 1, np.uint64), h, np.zeros(run - 1, np.uint64)])
    p = np.empty(len(at), place_type(run))
    p["print"], p["doc"], p["key"], p["at"] = h[at], doc, key, at
    p["lines"] = np.lib.stride_tricks.sliding_window_view(padded, 2 * run - 1)[at]
    p["before"], p["after"] = np.minimum(at, run - 1), np.minimum(len(h) - 1 - at, run - 1)
    return p


def _runs(p: np.ndarray, run: int) -> np.ndarray:
    """All runs that contain the fingerprint of a place."""
    found = []
    for back in range(run):
        q = p[(p["before"] >= back) & (p["after"] >= run - 1 - back)]
        r = np.empty(len(q), RUNS)
        r["doc"], r["key"], r["at"] = q["doc"], q["key"], q["at"] - back
        lines = q["lines"][:, run - 1 - back : 2 * run - 1 - back]
        one, two = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for i in range(run):
            one, two = mix(one + lines[:, i], 1), mix(two + lines[:, i], 2)
        r["one"], r["two"] = one, two
        found.append(r)
    return np.concatenate(found)


def _earliest(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest place of each run, the later ones)."""
    r = r[np.lexsort((r["at"], r["key"], r["doc"], r["two"], r["one"]))]
    new = np.ones(len(r), bool)
    new[1:] = (r["one"][1:] != r["one"][:-1]) | (r["two"][1:] != r["two"][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same_place = (r["doc"] == r["doc"][lead]) & (r["key"] == r["key"][lead]) & (r["at"] == r["at"][lead])
    return r[new], r[~same_place]


def _marks(r: np.ndarray) -> np.ndarray:
    m = np.empty(len(r), MARK)
    m["key"], m["at"], m["n"], m["kind"] = r["key"], r["at"], 1, REPEATED
    return np.unique(m)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None]]:
    for b in batches:
        for i in range(b.num_rows):
            doc = b.column(0)[i].as_py()
            yield _LAST if doc is None else doc, b.column(1)[i].as_py(), b.column(2)[i].as_py()


def common_prints(keyed: DataFrame, run: int) -> np.ndarray:
    """Fingerprints of more than a 1/HOT part of all places, sorted; at most HOT of them."""
    parts = partitions(keyed.sparkSession)
    fine = parts * FINE
    kind = np.dtype([("print", "<u8"), ("n", "<i8")])

    def summed(r: np.ndarray) -> np.ndarray:
        prints, at = np.unique(r["print"], return_inverse=True)
        out = np.empty(len(prints), kind)
        out["print"], out["n"] = prints, np.bincount(at, weights=r["n"], minlength=len(prints))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, text in _documents(batches):
            h = line_hashes(text)[2]
            held.append(h[fingerprints(h, run)])
            size += len(held[-1])
            if size > HELD:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.concatenate(held)
        r = np.empty(len(prints), kind)
        r["print"], r["n"] = prints, 1
        r = summed(r)
        return deal(_PLACES, r, mix(r["print"]) % np.uint64(fine))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in split(batches, {_PLACES: kind}):
            r = summed(got[_PLACES])
            often = r[np.argsort(-r["n"])][:HOT]  # no print outside the first HOT can hold a 1/HOT part
            yield pa.record_batch([pa.array([int(r["n"].sum())], pa.int64()), pa.array([often.tobytes()], pa.binary())], names=["total", "often"])

    counted = stage(by_part(keyed.mapInArrow(count, SCHEMA), parts).mapInArrow(top, "total long, often binary"), "line-prints")
    total = counted.agg(F.sum("total")).first()[0] or 0

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                r = np.frombuffer(data.as_buffer(), kind)
                yield pa.record_batch([pa.array(r["print"][r["n"] * HOT > total].astype(np.int64))], names=["print"])

    hot = counted.select("often").mapInArrow(over, "print long").collect()  # at most HOT rows
    return np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def later_runs(keyed: DataFrame, run: int = RUN) -> DataFrame:
    """Staged marks (part, data) of runs that also start earlier, by the key of their document."""
    parts = partitions(keyed.sparkSession)
    fine = parts * FINE
    kind = place_type(run)
    hot = keyed.sparkSession.sparkContext.broadcast(common_prints(keyed, run))

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(held)
        often = np.isin(p["print"], hot.value)
        runs, later = _earliest(_runs(p[often], run))
        yield deal(_RUNS, runs, mix(runs["one"]) % np.uint64(fine))
        rest = p[~often]
        # places with the same lines around them: the earliest goes on, the others are later
        name = np.zeros(len(rest), np.uint64)
        for i in range(2 * run - 1):
            name = mix(name + rest["lines"][:, i], 3)
        order = np.lexsort((rest["at"], rest["key"], rest["doc"], name))
        rest, name = rest[order], name[order]
        new = np.ones(len(rest), bool)
        new[1:] = name[1:] != name[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rest) else np.empty(0, np.int64)
        equal = (rest["doc"] == rest["doc"][lead]) & (rest["key"] == rest["key"][lead]) & (rest["at"] == rest["at"][lead])
        yield deal_marks(np.concatenate([_marks(later), _marks(_runs(rest[~equal], run))]), fine)
        sent = rest[new]
        yield deal(_PLACES, sent, mix(sent["print"]) % np.uint64(fine))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for doc, key, text in _documents(batches):
            h = line_hashes(text)[2]
            at = fingerprints(h, run)
            if len(at):
                held.append(_places(h, at, run, doc, key))
                size += len(at)
            if size > HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in split(batches, {_PLACES: kind, _RUNS: RUNS}, (1,)):
            if isinstance(got, dict):
                runs = np.concatenate([_runs(got[_PLACES], run), got[_RUNS]])
                yield deal_marks(_marks(_earliest(runs)[1]), fine)
            else:
                yield got

    return stage(by_part(keyed.mapInArrow(select, SCHEMA), parts).mapInArrow(meet, SCHEMA).select("part", "data"), "line-marks", "lz4")


def remove_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (that count), n_removed, kept_sha256, kept_text."""
    keyed = keyed_documents(docs, id_col, text_col)
    marks = later_runs(keyed.withColumn("doc_id", whole_number_ids(keyed, "doc_id")), run)

    def change(marks: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, rows = marks_of_rows(marks, b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        bounds = np.searchsorted(rows, np.arange(b.num_rows + 1))
        counts, removed, texts = [], [], []
        for i in range(b.num_rows):
            own = marks[at[bounds[i] : bounds[i + 1]]]
            text = b.column(2)[i].as_py() or ""
            lines = text.split("\n")
            counted = [j for j, x in enumerate(lines) if x.strip(_BLANK)]
            counts.append(len(counted))
            if not len(own):
                removed.append(0)
                texts.append(text)
                continue
            gone = np.zeros(len(counted) + 1, np.int64)
            np.add.at(gone, own["at"], 1)
            np.add.at(gone, own["at"] + own["n"] + run - 1, -1)
            drop = set(np.array(counted)[np.cumsum(gone)[:-1] > 0].tolist())
            removed.append(len(drop))
            texts.append("\n".join(x for j, x in enumerate(lines) if j not in drop))
        cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.string())]
        yield pa.record_batch(cols, names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return over_marks(keyed, marks, change, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string, kept_text string")
