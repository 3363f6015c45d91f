"""Personal data, toxicity, SentencePiece and packing."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import packing, pii, toxicity, wordhash
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.sentencepiece_codec import CharacterMap, Codec, digest_column, encode_column

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            bad = {"ip": any(int(x) > 255 for x in m.group().split(".")) if kind == "ip" else False, "card": not (14 <= len(digits) <= 19 and pii.luhn(digits)), "phone": not 10 <= len(digits) <= 15}
            if not bad.get(kind, False):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    g = random.Random(1)
    parts = ["1", "2", "0", "9", ".", "@", "a", "-", "+", " ", "(", ")", "é", "255", "4111111111111111", "b.c", "x@y.z"]
    for _ in range(5000):
        text = "".join(g.choice(parts) for _ in range(g.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 50_000, "+1" + "(" * 200_000, "a@b." * 20_000):
        assert pii.Contexts(pa.array([text])).base == [pii.base_spans(text)]


def test_contexts_find_identifiers_and_leave_others(spark):
    g = random.Random(2)
    phone = lambda: f"+1 ({g.randrange(200, 999)}) 555-{g.randrange(10**4):04d}"
    rows = [(i, f"please call {phone() if i % 3 else f'tel{g.randrange(10**7):07d}'} thanks w{i}") for i in range(60)]
    rows += [(100 + i, f"version number v{i}.0.{i}x of it") for i in range(20)] + [(200, None), (201, ""), (None, "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_found == (i % 3 == 0) for i in range(60)) and got[0].spans.startswith("context_phone:12:22")
    assert all(got[100 + i].n_found == 0 for i in range(20))
    for d, text in rows:
        base = pii.listed(plain_spans(text or ""))
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[0] == masked[1].replace("w1", "w0") == "please call <PHONE> thanks w0" and masked[200] is None and masked[201] == ""
    assert pii.mask(docs.where("false")).count() == 0 and pii.extract(docs.where("false")).count() == 0


def test_contexts_reach_the_start_of_a_text(spark):
    rows = [(i, f"Call {f'+44 20 7946 {1000 + i}' if i % 3 else f'ext-{7000 + i}'} now or never") for i in range(30)]
    rows += [(100 + i, f"{f'+44 20 7946 {2000 + i}' if i % 3 else f'ext-{8000 + i}'} rings") for i in range(30)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_found == (i % 3 == 0) and got[100 + i].n_found == (i % 3 == 0) for i in range(30))
    assert got[0].spans == "context_phone:5:13" and got[100].spans == "context_phone:0:8"


def test_candidates_may_be_of_any_kind(spark):
    """Words without digits, with inner signs, in quotes, and of any length are found in trusted slots; ordinary slots stay."""
    mail = lambda i: f"user{i}@mail{i}.example"
    odd = ["@handle", "john(at)doe", "k" * 5000, "日本語-id", "a"]
    rows = [(i, f"write to {mail(i)} today, w{i} fine") for i in range(40)] + [(100 + i, f'write to "{x}" today, all fine') for i, x in enumerate(odd)]
    rows += [(200 + i, f"it is {mail(i)} or not") for i in range(5)] + [(300 + i, f"it is word{i} or not") for i in range(40)]
    rows += [(400, None), (401, ""), (None, "write to me today"), (402, "write to me today"), (402, "write to me today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    docs = docs.withColumns({c: F.lit("x") for c in ("key", "found", "base", "mentions", "pattern", "n_email")})
    got = pii.extract(docs).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: r.spans for r in got}
    for i, x in enumerate(odd):
        a, words = 10, [x] if "(" not in x else ["john", "doe"]
        assert spans[100 + i].startswith(f"context_email:{a}:{a + len(words[0])}"), x
    assert all(r.n_found == 0 for r in got if r.doc_id is not None and (r.doc_id < 100 or 200 <= r.doc_id < 402))
    assert [r.n_found for r in got if r.doc_id == 402] == [1, 1] and [r.n_found for r in got if r.doc_id is None] == [1]
    assert pii.mask(docs).columns == docs.columns


def test_words_lose_points_at_their_ends():
    c = pii.Contexts(pa.array(["...a.b!? (c) ::", None, ".", "d. e@f.gh, i"]))
    w = c.words
    assert [bytes(c.raw[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [b"a.b", b"c", b"d", b"@f.g", b"i"] and w.row.tolist() == [0, 2, 2, 2, 5]


def test_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Tokens(pa.array(["hello abc de idiot", "you are zzzz"]))
    _, first, length = t.windows()
    at = np.minimum(first[:, None] + np.arange(length.max())[None], len(t.index) - 1)
    order = np.argsort(-t.size, kind="stable")
    args = (t.chars[order], t.size[order], t.bucket[order], np.argsort(order)[t.index[at]], length, np.array([1.0, 0.0]), np.ones(len(order)))
    _, grads = net.loss(*args)
    g = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(3):
            i = tuple(int(g.integers(0, n)) for n in value.shape)
            if name == "word":
                i = (int(t.bucket[0]), i[1])
            old, step = value[i], 1e-3
            value[i] = old + step
            up = net.loss(*args)[0]
            value[i] = old - step
            down = net.loss(*args)[0]
            value[i] = old
            assert abs((up - down) / (2 * step) - grads[name][i]) < 1e-5


def test_windows_cover_every_token():
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        t = toxicity.Tokens(pa.array([" ".join(f"t{i}" for i in range(n)), "x"]))
        row, first, length = t.windows()
        assert {i for r, a, m in zip(row, first, length, strict=True) if r == 0 for i in range(a, a + m)} == set(range(n))


def test_held_out_accuracy(spark):
    g = random.Random(5)
    clean = [f"c{g.randrange(40)}x" for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [g.choice(clean) for _ in range(g.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[g.randrange(len(words))] = "zork" + g.choice(["", "ing", "ed", "s"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "zorking")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.judge(docs, spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _ in labels) and got[1000].score == 0 == got[1001].predicted
    assert sum(got[i].predicted == dict(labels)[i] for i in held) >= 0.95 * len(held)
    none = toxicity.judge(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(got) and all(r.score == 0 for r in none)


def test_toxicity_of_awkward_rows(spark):
    """Empty tables, repeated rows, clashing columns and very long texts; scores don't depend on what stands beside a row."""
    from pyspark.sql import functions as F

    g = random.Random(8)
    words = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(g.choice(words) for _ in range(30)) + (" zorkish zork" if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rows += [rows[0], rows[1], (900, "quiet " * 60_000), (901, "quiet " * 60_000 + "zorkish zork")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in toxicity.judge(docs, labels).collect())
    clash = docs.withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "toxic", "n")})
    assert sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in toxicity.judge(clash, labels).collect()) == plain
    assert len(plain) == len(rows) and len({p for p in plain if p[0] == "0"}) == 1
    by_id = {p[0]: p[1] for p in plain}
    assert by_id["901"] > by_id["900"]
    kept = toxicity.keep_clean(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() < len(rows)
    assert toxicity.judge(docs.where("false"), labels).count() == 0 and toxicity.keep_clean(docs.where("false"), labels).count() == 0


@pytest.fixture(scope="module")
def sentencepiece_pair():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    return Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_equals_the_library(sentencepiece_pair):
    codec, library = sentencepiece_pair
    g = random.Random(1)
    parts = [*"ab cde  \n\té😀▁\0", "token", "  ", "the ", "日本", "�", "́", "<s>", "<0x41>", "</s>"]
    for _ in range(1500):
        text = "".join(g.choice(parts) for _ in range(g.randint(0, 30)))
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
        assert codec.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        spans = codec.encode_spans(text)
        assert [s[0] for s in spans] == ids and all(a[1] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
        any_ids = [g.randrange(32000) for _ in range(8)]
        assert codec.decode(any_ids) == library.decode(any_ids)


def test_spans_point_at_the_text(sentencepiece_pair):
    codec, _ = sentencepiece_pair
    text = "héllo 日 wörld"
    raw = text.encode()
    for i, a, b in codec.encode_spans(text):
        piece = codec.pieces[i]
        if not piece.startswith("<0x"):
            assert raw[a:b].decode() == piece.replace("▁", " ").removeprefix(" " if a == 0 else "")


def test_character_map_takes_the_longest_prefix():
    """A double array for a->X and ab->YZ, laid out by hand."""
    leaf, units = 1 << 31, [0] * 512
    units[0] = 1 << 10  # children of the root at 1 ^ byte
    a = 1 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 256) << 10  # has a value; its children at 256 ^ byte
    units[256] = leaf | 0
    b = 256 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 300) << 10
    units[300] = leaf | 2
    blob = struct.pack("<I512I", 2048, *units) + b"X\0YZ\0"
    m = CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"c", 0) is None


def test_codec_of_long_texts_and_clashing_columns(spark, sentencepiece_pair):
    """Texts of megabytes, repeated rows and columns with names used inside, against the library."""
    from pyspark.sql import functions as F

    _, library = sentencepiece_pair
    g = random.Random(4)
    long = " ".join(g.choice(["alpha", "běta", "日本", "x1", "\n", "  "]) for _ in range(250_000))
    rows = [(1, long), (2, "a  b"), (2, "a  b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_tokens", "ids", "starts", "spans_sha256")})
    got = digest_column(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == 4
    for d, text in rows:
        ids = library.encode(text or "")
        r = next(x for x in got if x.doc_id == d)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_codec_columns(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "héllo"), (3, "héllo"), (None, "x " * 5000)], "doc_id long, text string")
    got = digest_column(docs, path).collect()
    assert len(got) == 5 and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    wide = encode_column(docs, path).collect()
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in wide)
    assert digest_column(docs.where("false"), path).count() == 0


def test_query_digests_spans(spark, tmp_path):
    from lodestone.llm.queries import QUERIES, tokenizer_file

    texts = ["two  words", " edge ", "z\u00fcrich \u65e5\u672c \u2581 \U0001f9ea\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_sentencepiece"](spark, str(tmp_path)).collect()}
    codec = Codec(tokenizer_file("piece_bpe_32k.model"))
    for d, text in enumerate(texts):
        aligned = codec.normaliser.aligned(text or "")
        assert [x.tolist() for x in codec.normaliser.bounds(text or "")] == [aligned[1], aligned[2]]
        spans = codec.encode_spans(text)
        numbers = [s for _, s, _ in spans] + [e for _, _, e in spans]
        assert got[d].spans_sha256 == hashlib.sha256(np.array(numbers, "<i8").tobytes()).hexdigest()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.encoder(path)
    g = random.Random(3)
    parts = [*"ab cde  \n\té😀'", "'s", "the ", "123", "日本", "<|endoftext|>", "\r\n", "\xa0"]
    for _ in range(1500):
        text = "".join(g.choice(parts) for _ in range(g.randint(0, 30)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_places_every_id_once(spark, length):
    path = tokenizer_file("byte_bpe_50k.json")
    g = random.Random(6)
    rows = [(i, " ".join(g.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(g.randint(0, 300)))) for i in range(60)]
    rows += [(100 + i, "the same text") for i in range(40)] + [(900, None), (901, ""), (902, "<|endoftext|> x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, path, length).collect()
    texts, by_doc, by_sequence = dict(rows), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids, at = [*packing.encoder(path).encode(texts[d] or ""), 0], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    short = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        short += at < length
    assert short <= 1
    assert packing.pack(docs.where("false"), path, length).count() == 0


def packed_ids(got, length):
    """Checks that pieces fill sequences without gaps but for the last one; the lengths of documents by id, as a list of rows."""
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    ends = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        ends.append(at)
    assert sum(e < length for e in ends) <= 1 and set(by_sequence) == set(range(len(by_sequence)))


def test_packing_of_awkward_rows(spark):
    """Null ids, repeated rows (ties of the curve), clashing columns and a very long text."""
    from pyspark.sql import functions as F

    path = tokenizer_file("byte_bpe_50k.json")
    rows = [(1, "same text here")] * 50 + [(None, "no id")] * 3 + [(2, "word " * 60_000), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "n": F.lit(1), "row": F.lit(2), "range": F.lit(3), "before": F.lit(4), "ids": F.lit("x")})
    got = packing.pack(docs, path).collect()
    packed_ids(got, 1024)
    e = packing.encoder(path)
    wanted = {i: len(e.encode(t or "")) + 1 for i, t in rows}
    assert {r.doc_id: r.doc_tokens for r in got} == wanted
    assert sum(r.length for r in got) == sum(wanted[i] for i, _ in rows)
    assert sum(r.start == 0 for r in got) == len(rows)


def test_word_blocks_do_not_change_words(monkeypatch):
    text = pa.array([" ".join(f"w{i}" for i in range(3000)), None, "a" * 9000, "x"])
    whole = wordhash.words_of(text)
    monkeypatch.setattr(wordhash, "BLOCK", 1000)
    cut = wordhash.words_of(text)
    assert (whole.hash == cut.hash).all() and (whole.row == cut.row).all() and (whole.start == cut.start).all()
