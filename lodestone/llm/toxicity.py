"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

Input. A text's tokens are the runs of letters, digits and non-ASCII bytes, A-Z as a-z; a token
of more than ``PIECE`` bytes counts as several. A token's vector joins an embedding of the word
(by hash bucket) with the last states of two character networks that read its bytes forwards
and backwards. Windows of ``WINDOW`` tokens start every ``STEP`` tokens, so they overlap and
cover the whole text. In each window two gated recurrent networks read the token vectors in
both directions, attention pools their states and a linear layer gives the window's logit. A
text's score is that of its highest window; an empty text scores 0.

Training. At most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` other labelled rows, those of the
smallest hashes of their ids, train on the driver; rows whose crc32(id) is a multiple of 5 are
held out, and rows of over ``MOST_BYTES`` bytes are not taken for training. Only texts and
toxic labels enter. A label belongs to a text and not to a window, so training begins with the
windows that hold the tokens most typical of toxic texts (by words and word beginnings) and
goes on with the windows that the network itself scores highest. Last, the bias is set midway
between the scores of toxic and clean training texts.

Scoring is one narrow pass: each distinct token of a slice of text goes through the character
networks once, then all windows advance together. Nothing shuffles; the model (under 1 MB, its
size doesn't depend on the data) is the only broadcast.

Defined cases: a null text is empty; a null label is not used; with no labelled row of one of
the classes every score is 0; rows may repeat, and are scored alike; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.wordhash import mix, slices, words_of

WINDOW, STEP, PIECE = 32, 16, 24
BUCKETS, WORD_DIM, CHAR_DIM, CHAR_STATE, STATE, ATTEND = 4096, 8, 8, 10, 12, 12
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1000, 3000, 1 << 15
FOLDS = 5
ROUNDS, EPOCHS, BATCH, RATE = 3, 2, 128, 6e-3
SLICE = 1 << 20
_AT_ONCE = 4096
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Tokens:
    """Tokens of a batch of texts: bytes, distinct ones, and where each row's lie."""

    def __init__(self, column: pa.Array):
        w = words_of(column, lower=True, apart=_APART)
        size = w.end - w.start
        pieces = -(-size // PIECE)
        self.row = np.concatenate([[0], np.cumsum(pieces)])[w.row]
        start, h = w.start, w.hash
        if (pieces > 1).any():
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(w.start, pieces) + PIECE * within
            size = np.minimum(np.repeat(w.end, pieces) - start, PIECE)
            h = mix(np.repeat(w.hash, pieces) + within.astype(np.uint64))
        _, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (h[first] % np.uint64(BUCKETS)).astype(np.int64)
        self.size = size[first]
        at = start[first][:, None] + np.arange(PIECE)[None]
        inside = np.arange(PIECE)[None] < self.size[:, None]
        self.chars = np.where(inside, w.data[np.minimum(at, max(len(w.data) - 1, 0))], 0) if len(first) else np.empty((0, PIECE), np.uint8)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first token, length) of every window."""
        n = np.diff(self.row)
        count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STEP), 0) + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = self.row[row] + STEP * within
        return row, first, np.minimum(self.row[row + 1] - first, WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def gru(gates: np.ndarray, active: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of a gated recurrent layer over input gates (T, B, 3H).

    Rows are in the order of falling length: step t moves the first ``active[t]`` of them.
    """
    steps, batch, wide = gates.shape
    hidden = wide // 3
    h = np.zeros((batch, hidden), gates.dtype)
    out, kept = np.empty((steps, batch, hidden), gates.dtype), []
    for t in range(steps):
        m = active[t]
        old = h[:m]
        inner = old @ u
        zr = sigmoid(gates[t, :m, : 2 * hidden] + inner[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(gates[t, :m, 2 * hidden :] + r * inner[:, 2 * hidden :])
        kept.append((old, z, r, n, inner[:, 2 * hidden :]))
        h = np.concatenate([n + z * (old - n), h[m:]])
        out[t] = h
    return out, kept


def gru_back(d_out: np.ndarray, active: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of ``u``; ``d_out`` is zero where a row is over."""
    steps, batch, hidden = d_out.shape
    d_gates, d_u, d_h = np.zeros((steps, batch, 3 * hidden), d_out.dtype), np.zeros_like(u), np.zeros((batch, hidden), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        h, z, r, n, inner = kept[t]
        d = d_out[t, :m] + d_h[:m]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        d_gates[t, :m] = np.concatenate([d_z, d_r, d_n], axis=1)
        through = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ through
        d_h[:m] = d * z + through @ u.T
    return d_gates, d_u


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows that fall on each of ``size`` places."""
    order = np.argsort(at.ravel(), kind="stable")
    flat, where = rows.reshape(-1, rows.shape[-1])[order], at.ravel()[order]
    out = np.zeros((size, rows.shape[-1]), rows.dtype)
    head = np.flatnonzero(np.diff(where, prepend=-1))
    if len(head):
        out[where[head]] = np.add.reduceat(flat, head, axis=0)
    return out


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1]).T @ y.reshape(-1, y.shape[-1])


class Network:
    """Parameters, forward pass, gradients, and scoring."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        new = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        wide = WORD_DIM + 2 * CHAR_STATE
        self.p = {"word": (0.1 * g.standard_normal((BUCKETS, WORD_DIM))).astype(np.float32), "char": (0.5 * g.standard_normal((256, CHAR_DIM))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"cw{d}": new(CHAR_DIM, 3 * CHAR_STATE), f"cu{d}": new(CHAR_STATE, 3 * CHAR_STATE), f"cb{d}": zero(3 * CHAR_STATE)}
            self.p |= {f"ww{d}": new(wide, 3 * STATE), f"wu{d}": new(STATE, 3 * STATE), f"wb{d}": zero(3 * STATE)}
        self.p |= {"att": new(2 * STATE, ATTEND), "pick": new(ATTEND, 1), "out": new(2 * STATE, 1), "bias": np.array([-2.0], np.float32)}
        self.shift = 0.0

    @staticmethod
    def _turned(size: np.ndarray, steps: int) -> np.ndarray:
        """For each step and row, the place read when the sequence is read from its end."""
        return np.maximum(size[None] - 1 - np.arange(steps)[:, None], 0)

    def loss(self, chars, size, bucket, tokens, length, label, dropped) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows of tokens (B, T), indices into some tokens.

        Tokens and windows are in the order of falling length. ``dropped`` scales the word
        embedding of each token, so that characters are learnt as well.
        """
        p, batch, steps = self.p, len(tokens), tokens.shape[1]
        reach = int(size[0])
        char_active = np.searchsorted(-size, -np.arange(reach), "left")
        char_read, char_kept, last = {}, {}, []
        for d in "fb":
            at = np.repeat(np.arange(reach)[:, None], len(size), 1) if d == "f" else self._turned(size, reach)
            char_read[d] = chars[np.arange(len(size))[None], at]
            states, char_kept[d] = gru((p["char"] @ p[f"cw{d}"] + p[f"cb{d}"])[char_read[d]], char_active, p[f"cu{d}"])
            last.append(states[-1])
        vec = np.concatenate([p["word"][bucket] * dropped[:, None], *last], axis=1)
        active = np.searchsorted(-length, -np.arange(steps), "left")
        real = np.arange(steps)[:, None] < length[None]
        sides, kept, read, back = [], {}, {}, self._turned(length, steps)
        for d in "fb":
            at = np.repeat(np.arange(steps)[:, None], batch, 1) if d == "f" else back
            read[d] = tokens[np.arange(batch)[None], at]
            states, kept[d] = gru((vec @ p[f"ww{d}"] + p[f"wb{d}"])[read[d]], active, p[f"wu{d}"])
            sides.append(states if d == "f" else np.take_along_axis(states, at[..., None], 0))
        h = np.concatenate(sides, axis=2)
        a = np.tanh(h @ p["att"])
        weight = np.where(real, (a @ p["pick"])[..., 0], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * h).sum(0)
        logit = (pooled @ p["out"])[:, 0] + p["bias"][0]
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        g: dict[str, np.ndarray] = {}
        d_logit = ((sigmoid(logit) - label) / batch).astype(h.dtype)
        g["bias"], g["out"] = np.array([d_logit.sum()], h.dtype), pooled.T @ d_logit[:, None]
        d_pooled = d_logit[:, None] * p["out"][:, 0][None]
        d_weight = (d_pooled[None] * h).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["pick"] = _product(a, d_score[..., None])
        d_a = d_score[..., None] * p["pick"][:, 0] * (1 - a * a)
        g["att"] = _product(h, d_a)
        d_h = weight[..., None] * d_pooled[None] + d_a @ p["att"].T
        d_vec = np.zeros_like(vec)
        for k, d in enumerate("fb"):
            part = np.where(real[..., None], d_h[..., k * STATE : (k + 1) * STATE], 0)
            if d == "b":  # the place that was read at a step is the step that reads the place
                part = np.where(real[..., None], np.take_along_axis(part, back[..., None], 0), 0)
            d_gates, g[f"wu{d}"] = gru_back(part, active, p[f"wu{d}"], kept[d])
            each = _summed(read[d], d_gates, len(vec))
            g[f"ww{d}"], g[f"wb{d}"] = vec.T @ each, each.sum(0)
            d_vec += each @ p[f"ww{d}"].T
        g["word"] = _summed(bucket, d_vec[:, :WORD_DIM] * dropped[:, None], BUCKETS)
        g["char"] = np.zeros_like(p["char"])
        for k, d in enumerate("fb"):
            d_out = np.zeros((*char_read[d].shape, CHAR_STATE), h.dtype)
            ends = d_vec[:, WORD_DIM + k * CHAR_STATE : WORD_DIM + (k + 1) * CHAR_STATE]
            d_out[size - 1, np.arange(len(size))] = ends
            d_gates, g[f"cu{d}"] = gru_back(d_out, char_active, p[f"cu{d}"], char_kept[d])
            each = _summed(char_read[d], d_gates, 256)
            g[f"cw{d}"], g[f"cb{d}"] = p["char"].T @ each, each.sum(0)
            g["char"] += each @ p[f"cw{d}"].T
        return loss, g

    def _token_gates(self, t: Tokens) -> dict[str, np.ndarray]:
        """Input gates of each distinct token, for both directions of the word networks."""
        p, n = self.p, len(t.size)
        order = np.argsort(-t.size, kind="stable")
        size, chars = t.size[order], t.chars[order]
        state = np.zeros((n, 2 * CHAR_STATE), np.float32)
        for k, d in enumerate("fb"):
            table = p["char"] @ p[f"cw{d}"] + p[f"cb{d}"]
            h = np.zeros((n, CHAR_STATE), np.float32)
            for step in range(int(size[0]) if n else 0):
                m = int(np.searchsorted(-size, -step, "left"))  # tokens longer than the step
                at = np.full(m, step) if d == "f" else size[:m] - 1 - step
                h[:m] = _advance(table[chars[np.arange(m), at]], h[:m], p[f"cu{d}"])
            state[order, k * CHAR_STATE : (k + 1) * CHAR_STATE] = h
        vec = np.concatenate([p["word"][t.bucket], state], axis=1)
        return {d: vec @ p[f"ww{d}"] + p[f"wb{d}"] for d in "fb"}

    def window_logits(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(row, logit) of every window of every text."""
        row, first, length = t.windows()
        gates, p = self._token_gates(t), self.p
        logits = np.empty(len(row), np.float32)
        for a in range(0, len(row), _AT_ONCE):
            f, n = first[a : a + _AT_ONCE], length[a : a + _AT_ONCE]
            h = np.zeros((WINDOW, len(f), 2 * STATE), np.float32)
            for k, d in enumerate("fb"):
                s = np.zeros((len(f), STATE), np.float32)
                for step in range(WINDOW):
                    on = np.flatnonzero(n > step)
                    if not len(on):
                        break
                    at = np.full(len(on), step) if d == "f" else n[on] - 1 - step
                    s[on] = _advance(gates[d][t.index[f[on] + at]], s[on], p[f"wu{d}"])
                    h[at, on, k * STATE : (k + 1) * STATE] = s[on]
            score = (np.tanh(h @ p["att"]) @ p["pick"])[..., 0]
            score = np.where(np.arange(WINDOW)[:, None] < n[None], score, -1e9)
            weight = np.exp(score - score.max(0))
            weight /= weight.sum(0)
            logits[a : a + _AT_ONCE] = ((weight[..., None] * h).sum(0) @ p["out"])[:, 0] + p["bias"][0] + self.shift
        return row, logits

    def score(self, column: pa.Array) -> np.ndarray:
        """Score of each text: that of its highest window, 0 without tokens."""
        row, logits = self.window_logits(Tokens(column))
        out = np.full(len(column), -np.inf)
        np.maximum.at(out, row, logits)
        return 0.5 * (np.tanh(0.5 * out) + 1)


def _advance(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    hidden = h.shape[1]
    inner = h @ u
    zr = sigmoid(gates[:, : 2 * hidden] + inner[:, : 2 * hidden])
    n = np.tanh(gates[:, 2 * hidden :] + zr[:, hidden:] * inner[:, 2 * hidden :])
    return n + zr[:, :hidden] * (h - n)


def typical(t: Tokens, label: np.ndarray) -> np.ndarray:
    """How typical of toxic texts each distinct token is: the best of its word and its beginnings."""
    row = np.repeat(np.arange(len(label)), np.diff(t.row))
    best = np.full(len(t.size), -np.inf)
    for size in (3, 4, 5, 6, PIECE):
        _, kind = np.unique(np.ascontiguousarray(np.where(np.arange(PIECE)[None] < size, t.chars, 0)).view(f"V{PIECE}").ravel(), return_inverse=True)
        kind = kind.ravel()
        seen = np.unique(kind[t.index] * len(label) + row)  # each kind of token once a text
        bad, good = (np.bincount(seen[label[seen % len(label)] == y] // len(label), minlength=int(kind.max()) + 1) for y in (1, 0))
        odds = np.log((bad + 0.5) / (label == 1).sum()) - np.log((good + 0.5) / (label == 0).sum())
        best = np.maximum(best, (odds * np.sqrt(bad))[kind])
    return best


def train(texts: list[str], labels: list[int], seed: int = 11) -> Network | None:
    """A network fitted to whole texts and their labels; None without rows of both classes."""
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    t = Tokens(pa.array(texts, pa.string()))
    net, g = Network(seed), np.random.default_rng(seed)
    row, first, length = t.windows()
    if not len(row) or not (label[row] == 1).any() or not (label[row] == 0).any():
        return None
    token_value = typical(t, label)[t.index]
    value = np.array([token_value[a : a + n].max() for a, n in zip(first, length, strict=True)])
    slow = {k: np.zeros_like(v) for k, v in net.p.items()}
    fast = {k: np.zeros_like(v) for k, v in net.p.items()}
    updates = 0
    for turn in range(ROUNDS):
        if turn:
            value = net.window_logits(t)[1]
        by_value = np.lexsort((-value, row))
        lead = by_value[np.flatnonzero(np.diff(row[by_value], prepend=-1))]  # each text's highest window
        bad, hard = lead[label[row[lead]] == 1], lead[label[row[lead]] == 0]
        for _ in range(EPOCHS):
            clean = np.flatnonzero(label[row] == 0)
            chosen = np.concatenate([bad, bad, hard, g.choice(clean, min(len(clean), 2 * len(bad) + 200))])
            g.shuffle(chosen)
            for a in range(0, len(chosen), BATCH):
                some = chosen[a : a + BATCH]
                some = some[np.argsort(-length[some], kind="stable")]
                steps = int(length[some].max())
                at = np.minimum(first[some][:, None] + np.arange(steps)[None], len(t.index) - 1)
                ids, tokens = np.unique(t.index[at], return_inverse=True)
                order = np.argsort(-t.size[ids], kind="stable")
                ids, tokens = ids[order], np.argsort(order)[tokens]
                keep = (g.random(len(ids)) < 0.5).astype(np.float32) * 2
                _, grads = net.loss(t.chars[ids], t.size[ids], t.bucket[ids], tokens.reshape(at.shape), length[some], label[row[some]], keep)
                updates += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
                for k, v in grads.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-9))
                    slow[k] += 0.1 * (v - slow[k])
                    fast[k] += 0.001 * (v * v - fast[k])
                    net.p[k] -= RATE * (slow[k] / (1 - 0.9**updates)) / (np.sqrt(fast[k] / (1 - 0.999**updates)) + 1e-8)
    row, logits = net.window_logits(t)
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, row, logits)
    good, bad = np.sort(top[(label == 0) & np.isfinite(top)]), np.sort(top[(label == 1) & np.isfinite(top)])
    cuts = np.unique(np.concatenate([good, bad]))
    wrong = (len(good) - np.searchsorted(good, cuts, "right")) + np.searchsorted(bad, cuts, "right")
    best = int(np.argmin(wrong))
    upper = bad[bad > cuts[best]]
    lower = good[good <= cuts[best]]
    net.shift = -float((upper[0] + lower[-1]) / 2) if len(upper) and len(lower) else 0.0
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Train on a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).distinct()
    usable = usable.where(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0)
    order = [F.xxhash64("id"), F.col("id"), F.col("y")]
    picked = usable.where("y = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(usable.where("y = 0").orderBy(*order).limit(MOST_CLEAN))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text").between(1, MOST_BYTES))
    rows = texts.join(F.broadcast(picked), "id").orderBy(*order, "text").limit(MOST_TOXIC + MOST_CLEAN).collect()  # bounded: 4000 rows, 128 MB
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def with_scores(docs: DataFrame, network: Network | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of each row's whole text."""
    if network is None:
        return docs.withColumn(name, F.lit(0.0))
    model = docs.sparkSession.sparkContext.broadcast(network)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, SLICE):
                yield pa.record_batch([*b.columns, pa.array(model.value.score(b.columns[-1]), pa.float64())], names=[*b.schema.names, name])

    arranged = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))
    out = arranged.mapInArrow(run, T.StructType([*arranged.schema.fields, T.StructField(name, T.DoubleType())]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_scores(narrow, fit(docs, labels, id_col, text_col))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text is not judged toxic, with all their columns."""
    name = "score"
    while name in docs.columns:
        name = "_" + name
    return with_scores(docs, fit(docs, labels, id_col, text_col), name, text_col).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
