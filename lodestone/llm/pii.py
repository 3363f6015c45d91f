"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The fixed patterns (e-mail, IP address, payment card, telephone number) give the base spans and
are the seeds. Words are what stands between white space, quotes, brackets, commas, semicolons,
bars and equals signs, without points and such at its ends; they may have any length
and any characters. Around each seed two lexical patterns are read off: the two words before it,
and the word before with the word after; A-Z in lower case, digits as 0, other seeds as one mark. Where the text starts or
ends instead, a mark stands for each missing word.

Bootstrapping. Patterns that ``LEAST_SEEDS`` different seeds have become seeded ones if seeds fill
at least ``LEAST_SHARE`` of all places in the corpus where they stand, so words that are common
everywhere make none. A further pass takes as candidate every word that stands in the slot of a
seeded pattern, whatever it looks like. Patterns and instances (the seeds' and the candidates' own texts) form a graph whose
distinct edges Spark scores in rounds: a pattern scores the mean of its instances' scores, shrunk
by ``SHRINK`` unknown ones; an instance that is no seed scores ``TRUST`` times the chance that at
least one of its patterns is right, so patterns can't lift each other without seeds. Seeds stay at 1. After ``ROUNDS`` rounds a pattern of at least ``LEAST_SCORE`` is
trusted, and every word that stands in its slot is found, under the kind of seed that the pattern
has most, as ``context_<kind>``. A slot that ordinary words fill as well scores low, so the score
alone decides. Base spans always stay. An identifier of several words is found word by word, in
slots of its own.

How it runs: three passes over the text. The first stages base spans and the seeds' patterns, narrow
rows. The second counts, summed up in the tasks, where the patterns of many seeds stand; the third
stages the words in slots of seeded patterns. Both test the patterns of all words, as arrays,
against a Bloom filter (``FILTER_BITS`` bits; a false hit is dropped by an exact join) and look for
base spans only in rows that may have any, by another filter of fixed size. The scoring reads only
the staged hits. Distinct edges are reduced in map tasks, so a
context that a third of all documents share is one edge for each instance; scores meet edges in
joins that adaptive execution splits where hot. Each round is staged in the shared folder.

Defined cases: null and empty texts have no spans; rows may repeat and give equal results; a
null id stays null; other columns are left alone; an empty table gives no rows. All scans are
linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packed import flagged
from lodestone.llm.storage import discard, row_key, stage
from lodestone.llm.wordhash import mix, slices, text_bytes, words_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SHRINK, TRUST, LEAST_SCORE, LEAST_SEEDS, LEAST_SHARE = 3, 1.0, 0.5, 0.7, 4, 0.3
#: What the base kinds look like. Possessive, as giving back can't help here.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
FILTER_BITS = 1 << 22
SLICE = 1 << 20
HELD = 1 << 21
_APART = np.zeros(256, bool)
_APART[[0x20, *range(0x09, 0x0E), *b",;=|()[]{}<>\"'"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[*b".:!?"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[49:58] = 48
_NONE = np.uint64(0x5BD1E995A0F3C27B)  # in patterns, for each word that the text's start or end leaves out
_SEED = np.uint64(0x2545F4914F6CDD1D)  # in patterns, for each base span

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """E-mail addresses, searched outwards from each @: its local part can't hold another."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at) if begin < at else None
        if domain:
            done = domain.end()
            yield "email", begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then by kind as listed."""
    found = list(emails(text))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Contexts:
    """Words and base spans of some texts, with the patterns around each. ``base``: the spans, where they are known."""

    def __init__(self, column: pa.Array, base: list[list[Span]] | None = None):
        self.base = [base_spans(t or "") for t in column.to_pylist()] if base is None else base
        data, self.off = text_bytes(column)
        self.raw = data
        cut = _FOLD[data]
        spans: list[tuple[int, int, int, str]] = []  # row, first byte, end, kind
        for row, found in enumerate(self.base):
            if found:
                at = self._bytes_of(row)
                spans += [(row, int(at[a]), int(at[b]), kind) for kind, a, b in found]
        for _, a, b, _ in spans:
            cut[a:b] = 0x20
            cut[a + 1 : b - 1] = 0x01  # a word of its own, apart from what it is glued to
        self._strip(cut)
        self.words = words_of(pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(self.off.astype(np.int64)), pa.py_buffer(cut)]), apart=_APART)
        self.spans = spans
        inside = np.zeros(len(self.words.start) + 1, np.int64)
        np.add.at(inside, np.searchsorted(self.words.start, [s[1] for s in spans]), 1)
        np.add.at(inside, np.searchsorted(self.words.start, [s[2] for s in spans]), -1)
        self.seed = np.cumsum(inside)[:-1] > 0
        self.words.hash[self.seed] = _SEED

    def _bytes_of(self, row: int) -> np.ndarray:
        """The byte at which each code point of a row begins, and the row's end."""
        a, z = self.off[row], self.off[row + 1]
        return a + np.append(np.flatnonzero(self.raw[a:z] & 0xC0 != 0x80), z - a)

    def _strip(self, cut: np.ndarray) -> None:
        """Blank points and such at the ends of words."""
        apart = _APART[cut]
        edge = _EDGE[cut]
        if not edge.any():
            return
        n = len(cut)
        solid = np.concatenate([[0], np.cumsum(~apart & ~edge)])
        stops = np.unique(np.concatenate([np.flatnonzero(apart), self.off]))  # a word lies between two stops
        at = np.flatnonzero(edge)
        after = np.searchsorted(stops, at, side="right")
        begin = np.where(after > 0, stops[np.maximum(after - 1, 0)], 0)
        end = np.append(stops, n)[after]
        cut[at[(solid[at] == solid[begin]) | (solid[at] == solid[end])]] = 0x20

    def _patterns(self, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of both patterns of a slot: ``before`` is the last word before it and ``after`` the first behind it,
        in a text whose words are low to high. 0 where no word is about."""
        h = np.append(self.words.hash, _NONE)
        pick = lambda i, good: h[np.where(good, i, len(h) - 1)]
        one, two = pick(before, before >= low), pick(before - 1, before - 1 >= low)
        three = pick(after, after < high)
        word = lambda x: (x != _NONE) & (x != _SEED)
        left, around = mix(mix(one, 1) + two, 2), mix(mix(one, 3) + three, 4)
        return np.where(word(one) | word(two), left, 0).astype(np.uint64), np.where(word(one) | word(three), around, 0).astype(np.uint64)

    def seeds(self) -> list[tuple[int, str, int, int, int]]:
        """(row, kind, instance, pattern before, pattern around) of each base span."""
        if not self.spans:
            return []
        row = np.array([s[0] for s in self.spans])
        w = self.words
        before = np.searchsorted(w.end, [s[1] for s in self.spans], side="right") - 1
        after = np.searchsorted(w.start, [s[2] for s in self.spans])
        left, around = self._patterns(before, after, w.row[row], w.row[row + 1])
        names = [_name(self.raw[a:b].tobytes()) for _, a, b, _ in self.spans]
        return [(s[0], s[3], n, x, y) for s, n, x, y in zip(self.spans, names, left.view(np.int64).tolist(), around.view(np.int64).tolist(), strict=True)]

    def hits(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, their rows, their patterns) of the words, but base spans, in slots that the filter knows."""
        w = self.words
        at = np.arange(len(w.hash))
        row = np.repeat(np.arange(len(w.row) - 1), np.diff(w.row))
        for pattern in self._patterns(at - 1, at + 1, w.row[row], w.row[row + 1]):
            one, two = _spots(pattern)
            found = np.flatnonzero(bits[one] & bits[two] & ~self.seed & (pattern != 0))
            yield found, row[found], pattern[found].view(np.int64)

    def candidates(self, bits: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, start, stop, instance, pattern) of the words in slots that the filter knows, in code points."""
        w = self.words
        out = []
        starts: dict[int, np.ndarray] = {}
        for found, rows, patterns in self.hits(bits):
            for i, r, p in zip(found.tolist(), rows.tolist(), patterns.tolist(), strict=True):
                a, b = int(w.start[i]), int(w.end[i])
                if r not in starts:
                    starts[r] = self._bytes_of(r)
                start, stop = np.searchsorted(starts[r], [a, b])
                out.append((r, int(start), int(stop), _name(self.raw[a:b].tobytes()), p))
        return out


def _name(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - 2**63


def _spots(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64(FILTER_BITS - 1)
    return (pattern & most).astype(np.int64), ((pattern >> np.uint64(32)) & most).astype(np.int64)


_MENTION = "struct<kind:string,instance:long,before:long,around:long>"
_SCANNED = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<{_MENTION}>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged: base spans of each row, the patterns of its seeds, and a key of the row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = pa.struct([("kind", pa.string()), ("instance", pa.int64()), ("before", pa.int64()), ("around", pa.int64())])
        names = ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(mention)]
        for batch in batches:
            for b in slices(batch, SLICE):
                base = [base_spans(t or "") for t in b.column(2).to_pylist()]
                some = [i for i, x in enumerate(base) if x]
                seeds: list[list[dict]] = [[] for _ in base]
                for at, *m in Contexts(b.column(2).take(pa.array(some, pa.int64())), [base[i] for i in some]).seeds():
                    seeds[some[at]].append(dict(zip(("kind", "instance", "before", "around"), m, strict=True)))
                lines = [listed(x) for x in base]
                counts = [[sum(s[0] == k for s in x) for x in base] for k in KINDS]
                cols = [*counts, [hashlib.sha256(x.encode()).hexdigest() for x in lines], lines, seeds]
                yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=names)

    return stage(_keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, key long, {_SCANNED}"), "pii-scanned")


def seed_edges(scanned: DataFrame) -> DataFrame:
    """Staged distinct edges (pattern, instance, kind, places) of the seeds in patterns that enough different seeds have."""
    each = scanned.select(F.explode("mentions").alias("m"))
    sides = each.select("m.instance", "m.kind", F.explode(F.array("m.before", "m.around")).alias("pattern")).where("pattern <> 0")
    edges = sides.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("places"))
    often = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern")
    return stage(edges.join(often, "pattern"), "pii-seeds")


def _texts(docs: DataFrame, scanned: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (key, text, spans): ``spans`` is false for texts without base spans."""
    keyed = _keyed(docs, id_col, text_col).select("key", "text")
    return flagged(keyed, scanned.where("base <> ''").select("key"), "spans").select("key", "spans", "text")


def _contexts(b: pa.RecordBatch) -> Contexts:
    return Contexts(b.column(2), [base_spans(t) if maybe and t else [] for maybe, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])


def seeded_edges(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edges of ``seed_edges`` whose pattern is filled by seeds in enough of the places where it stands, staged."""
    edges = seed_edges(scanned)
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(filter_of(edges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).astype(bool)
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            pattern, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

        for batch in batches:
            for b in slices(batch, SLICE):
                for _, _, patterns in _contexts(b).hits(known):
                    held.append(patterns)
                    size += len(patterns)
                if size > HELD:
                    yield close()
                    held, size = [], 0
        if size:
            yield close()

    others = _texts(docs, scanned, id_col, text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("others"))
    own = edges.groupBy("pattern").agg(F.sum("places").alias("own"))
    good = own.join(others, "pattern", "left").where(F.col("own") >= LEAST_SHARE * (F.col("own") + F.coalesce("others", F.lit(0))))
    return stage(edges.drop("places").join(good.select("pattern"), "pattern"), "pii-seeded")


def filter_of(patterns: DataFrame) -> np.ndarray:
    """A Bloom filter of patterns, ``FILTER_BITS`` bits whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for spots in _spots(b.column(0).to_numpy().view(np.uint64)):
                bits[spots] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(words[at])], names=["at", "word"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    for at, word in patterns.select("pattern").mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word")).collect():
        words[at] = word  # 64 thousand rows at most
    return np.unpackbits(words.view(np.uint8)).astype(bool)


def slots(docs: DataFrame, scanned: DataFrame, seeded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged candidates (key, start, stop, instance, pattern): words in slots of seeded patterns."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(filter_of(seeded)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).astype(bool)
        names = ["key", "start", "stop", "instance", "pattern"]
        for batch in batches:
            for b in slices(batch, SLICE):
                if found := _contexts(b).candidates(known):
                    row, *cols = zip(*found, strict=True)
                    yield pa.record_batch([b.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    hits = _texts(docs, scanned, id_col, text_col).mapInArrow(run, "key long, start long, stop long, instance long, pattern long")
    return stage(hits.join(seeded.select("pattern").distinct(), "pattern", "left_semi"), "pii-slots")


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """Rows (pattern, kind) of the patterns that the scored graph of distinct edges (pattern, instance, kind) makes trustworthy."""
    seeds = edges.groupBy("instance").agg(F.max("kind").alias("kind")).select("instance", F.when(F.col("kind") != "", 1.0).otherwise(0.0).alias("score"))
    scores = stage(seeds, "pii-scores")
    for _ in range(ROUNDS):
        met = edges.join(scores, "instance")
        patterns = met.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SHRINK)).alias("p"))
        judged = edges.join(patterns, "pattern").groupBy("instance").agg(
            F.max("kind").alias("kind"), (TRUST * (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))))))).alias("score")
        )
        after = stage(judged.select("instance", F.when(F.col("kind") != "", 1.0).otherwise(F.col("score")).alias("score")), "pii-scores")
        discard(scores)
        scores = after
    met = edges.join(scores, "instance")
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    rated = met.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SHRINK)).alias("p"), *[count(k) for k in KINDS])
    most = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
    return rated.where(F.col("p") >= LEAST_SCORE).select("pattern", F.concat(F.lit("context_"), most["kind"]).alias("kind"))


def found_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, found) with the sorted spans (start, stop, kind) that trusted patterns add to the rows of a key."""
    seeds = seeded_edges(docs, scanned, id_col, text_col)
    candidates = slots(docs, scanned, seeds, id_col, text_col)
    every = seeds.unionByName(candidates.select("pattern", "instance", F.lit("").alias("kind")))
    edges = stage(every.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    hit = candidates.join(stage(trusted_patterns(edges), "pii-patterns"), "pattern")
    spans = hit.groupBy("key", "start", "stop").agg(F.min("kind").alias("kind"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("found"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans (base and found), n_found."""
    scanned = scan(docs, id_col, text_col)
    joined = scanned.drop("mentions").join(found_spans(docs, scanned, id_col, text_col), "key", "left")
    ranks = F.expr(
        """transform(array_sort(concat(
             transform(filter(split(base, ','), x -> x <> ''), x -> named_struct('start', cast(split(x, ':')[1] as long),
                 'rank', array_position(array('email', 'ip', 'card', 'phone'), split(x, ':')[0]), 'span', x)),
             transform(coalesce(found, array()), x -> named_struct('start', x.start, 'rank', 9L, 'span', concat_ws(':', x.kind, x.start, x.stop)))
           )), x -> x.span)"""
    )
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(",", ranks).alias("spans"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"))


def masked(text: str | None, extra: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted([*base_spans(text), *extra], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.removeprefix('context_').upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text."""
    scanned = scan(docs, id_col, text_col)
    extra = stage(found_spans(docs, scanned, id_col, text_col), "pii-found")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    packed = docs.select(row.alias("r"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    joined = packed.join(extra, "key", "left").select("r", "found")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(0).field(i) for i in range(len(names))]
            extras = b.column(1).to_pylist()
            texts = [masked(t.as_py(), [(x["kind"], x["start"], x["stop"]) for x in e or ()]) for t, e in zip(cols[at], extras, strict=True)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, names=[f"c{i}" for i in range(len(names))])

    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    return joined.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
