"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

Training (numpy, on the driver) sees a bounded sample of labelled rows: at most
``per_class`` documents of each label, chosen by a hash of doc_id, one text of each
doc_id (the first in order) of at most ``longest`` characters, and none with
crc32(doc_id as text) mod 3 equal to 1.  A label says that something in a document is
toxic, not where: in each epoch every document is represented by its worst window so
far.  Texts are held as numbers of words; only distinct words are strings.

Scoring runs in the tasks over all overlapping windows of every whole text; a
document's score is its worst window's.  Windows move by half their width, so any
run of half a window's words lies whole in one of them.

Nulls and edge cases: a text that is null or has no words scores 0; each row
gives one row; a null doc_id isn't held out and trains nothing; labels that are
null are left out, and a document with several labels takes the largest; without
labels of both kinds every score is 0; other columns are ignored by ``score``
and kept by ``clean_documents``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow, mixed, release, released, small_batches, starts

WINDOW, STRIDE = 32, 16
CHAR_ROWS, WIDE, HIDDEN = 1 << 14, 8, 8
#: A word has an embedding of its own if so many documents of the sample have it; all other words share one.
LEAST_DF = 4
PER_CLASS, LONGEST, EPOCHS = 2000, 12_000, 8
#: Share of known words that pass for unknown ones in training, so that characters have to tell.
UNKNOWN = 0.3
LEAST_STEPS = 200
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+|\d+")
#: A longer word (a run of a script without spaces, words joined) is cut into pieces of so many characters, one every so many; each is a word of the windows.
PIECE, PIECE_STRIDE = 24, 12


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    if all(len(x) <= PIECE for x in words):
        return words
    return [x[k : k + PIECE] for x in words for k in range(0, max(1, len(x) - PIECE + PIECE_STRIDE), PIECE_STRIDE)]


def char_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' beginnings (3 to 7 characters) and character trigrams, ends marked, word by word; and how many each word has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join([f"<{x}>" for x in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = starts(size + 2)[:-1]
    owner = np.repeat(np.arange(len(words)), size)
    place = np.repeat(at - starts(size)[:-1], size) + np.arange(len(owner))
    rows, owners = [(codes[place] * base + codes[place + 1]) * base + codes[place + 2]], [owner]
    head = codes[at] * base + codes[at + 1]
    for k in range(2, 7):
        long = np.flatnonzero(size >= k)
        head[long] = head[long] * base + codes[at[long] + k]
        rows.append(head[long] + np.uint64(k << 50))
        owners.append(long)
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (mixed(rows[order]) >> np.uint64(20)).astype(np.int32) & (CHAR_ROWS - 1), np.bincount(owners, minlength=len(words))


def windows(n_words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of each window."""
    counts = np.array([0 if n == 0 else 1 + max(0, -(-(n - WINDOW) // STRIDE)) for n in n_words], np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return doc, first, np.minimum(WINDOW, np.asarray(n_words, np.int64)[doc] - first)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def recur(x: np.ndarray, u: np.ndarray, keep: bool = False):
    """One direction over x[time, window, 3 * HIDDEN]; gates z, r and candidate c.  With ``keep`` also what the gradient needs."""
    steps, n, _ = x.shape
    h, out, kept = np.zeros((n, HIDDEN), x.dtype), np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep:
            kept.append((h, hu, z, r, c))
        h = c + z * (h - c)
        out[t] = h
    return out, kept


def recur_back(grad: np.ndarray, kept: list, u: np.ndarray):
    """Gradients by x and u."""
    gx, gu, dh = np.empty((*grad.shape[:2], 3 * HIDDEN), grad.dtype), np.zeros_like(u), np.zeros(grad.shape[1:], grad.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, hu, z, r, c = kept[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
        gx[t] = np.concatenate([dz, dr, dc], 1)
        dhu = np.concatenate([dz, dr, dc * r], 1)
        gu += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return gx, gu


class Network:
    """Weights by name.  Inputs are a word's own embedding beside the mean of its beginnings' and trigrams' embeddings."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: dict[str, int]):
        self.w, self.vocabulary = weights, vocabulary
        self.row: dict[str, int] = {}
        self.projected: list[np.ndarray] = []

    @staticmethod
    def fresh(rng: np.random.Generator, known: int) -> dict[str, np.ndarray]:
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        w = {"word": f(known + 1, WIDE, scale=0.05), "char": f(CHAR_ROWS, WIDE, scale=0.05), "v": f(HIDDEN, scale=0.3), "a": f(2 * HIDDEN, HIDDEN, scale=0.3), "o": f(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            w |= {f"w{d}": f(2 * WIDE, 3 * HIDDEN, scale=0.25), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": f(HIDDEN, 3 * HIDDEN, scale=0.25)}
        return w

    def mean_chars(self, flat: np.ndarray, per_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w["char"][flat], np.cumsum(per_word) - per_word, axis=0) / per_word[:, None].astype(np.float32)

    def projections(self, words: list[str], most: int = 20_000) -> np.ndarray:
        """Projected inputs of distinct words."""
        out = [np.zeros((0, 6 * HIDDEN), np.float32)]
        for k in range(0, len(words), most):
            part = words[k : k + most]
            rows = np.array([self.vocabulary.get(x, 0) for x in part], np.int64)
            out.append(self.project(np.concatenate([self.w["word"][rows], self.mean_chars(*char_rows(part))], 1)).astype(np.float32))
        return np.concatenate(out)

    def pool(self, h: np.ndarray, dead: np.ndarray):
        """Attention over time: (logits, attention, its inner tanh, pooled states)."""
        inner = np.tanh(h @ self.w["a"])
        e = inner @ self.w["v"] - 1e9 * dead
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = np.einsum("tm,tmh->mh", a, h)
        return pooled @ self.w["o"] + self.w["b"][0], a, inner, pooled

    def logits(self, tokens: np.ndarray, first: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of the windows of ``size`` words from ``first`` on.  Tokens are rows of ``table``, the words' projections; row 0 is no word and leaves a state as it is."""
        out, step = np.empty(len(first), np.float32), np.arange(WINDOW)[:, None]
        for k in range(0, len(first), 2048):
            n = size[k : k + 2048]
            ids = np.where(step < n, tokens[np.minimum(first[k : k + 2048] + step, len(tokens) - 1)], 0)
            x = table[ids]
            forth, _ = recur(x[:, :, : 3 * HIDDEN], self.w["uf"])
            back, _ = recur(x[::-1, :, 3 * HIDDEN :], self.w["ub"])
            out[k : k + 2048] = self.pool(np.concatenate([forth, back[::-1]], 2), step >= n)[0]
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.w["wf"] + self.w["bf"], x @ self.w["wb"] + self.w["bb"]], 1)

    def nothing(self) -> np.ndarray:
        """Projection of no word: gate z is open, so the state stays."""
        gate = np.zeros(3 * HIDDEN, np.float32)
        gate[:HIDDEN] = 40
        return np.concatenate([gate, gate])[None]

    def score(self, texts: list[str | None], most: int = 80_000) -> np.ndarray:
        """Worst window's probability of each text; 0 where there are no words."""
        words = [words_of(x) for x in texts]
        flat = [w for row in words for w in row]
        if len(self.row) > most or not self.projected:
            self.row, self.projected = {}, [self.nothing()]
        new = list(set(flat) - self.row.keys())
        if new:
            base = 1 + len(self.row)
            self.row |= {w: base + k for k, w in enumerate(new)}
            self.projected = [np.concatenate([*self.projected, self.projections(new)])]
        tokens = np.fromiter(map(self.row.__getitem__, flat), np.int32, len(flat))
        n = [len(x) for x in words]
        doc, first, size = windows(n)
        out = np.zeros(len(texts), np.float64)
        if len(doc):
            np.maximum.at(out, doc, sigmoid(self.logits(tokens, (np.cumsum(n) - n)[doc] + first, size, self.projected[0]).astype(np.float64)))
        return out


def gradients(net: Network, ids: np.ndarray, rows: np.ndarray, flat: np.ndarray, per_word: np.ndarray, target: np.ndarray, weight: np.ndarray):
    """(loss, its gradients by weight).  ids[time, window] number the words from 1 on (0: none), whose embeddings are ``rows`` and whose characters' are ``flat``, ``per_word`` of each."""
    w = net.w
    x = np.concatenate([w["word"][rows], net.mean_chars(flat, per_word)], 1)
    p = np.concatenate([net.nothing().astype(x.dtype), net.project(x)])[ids]
    forth, kf = recur(p[:, :, : 3 * HIDDEN], w["uf"], True)
    back, kb = recur(p[::-1, :, 3 * HIDDEN :], w["ub"], True)
    h = np.concatenate([forth, back[::-1]], 2)
    logit, a, inner, pooled = net.pool(h, ids == 0)
    loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum())
    d = ((sigmoid(logit) - target) * weight).astype(x.dtype)
    g = {"o": pooled.T @ d, "b": np.array([d.sum()], x.dtype)}
    dp = d[:, None] * w["o"]
    da = np.einsum("tmh,mh->tm", h, dp)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tm,tmh->h", de, inner)
    di = de[:, :, None] * w["v"] * (1 - inner * inner)
    g["a"] = np.einsum("tmi,tmj->ij", h, di)
    dh = a[:, :, None] * dp + di @ w["a"].T
    gf, g["uf"] = recur_back(dh[:, :, :HIDDEN], kf, w["uf"])
    gb, g["ub"] = recur_back(dh[::-1, :, HIDDEN:], kb, w["ub"])
    gp = np.zeros((len(rows) + 1, 6 * HIDDEN), x.dtype)
    np.add.at(gp, ids, np.concatenate([gf, gb[::-1]], 2))
    gp = gp[1:]
    g["wf"], g["wb"] = x.T @ gp[:, : 3 * HIDDEN], x.T @ gp[:, 3 * HIDDEN :]
    g["bf"], g["bb"] = gp[:, : 3 * HIDDEN].sum(0), gp[:, 3 * HIDDEN :].sum(0)
    gx = gp[:, : 3 * HIDDEN] @ w["wf"].T + gp[:, 3 * HIDDEN :] @ w["wb"].T
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    np.add.at(g["word"], rows, gx[:, :WIDE])
    np.add.at(g["char"], flat, np.repeat(gx[:, WIDE:] / per_word[:, None], per_word, axis=0).astype(x.dtype))
    return loss, g


def train(texts, labels: list[int], seed: int = 7, epochs: int = EPOCHS, odds_start: bool = True) -> Network | None:
    """A network, or None where the labels aren't of both kinds.  ``texts`` may be any iterable: each is turned into numbers of words as it comes."""
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    parts = [np.array([number.setdefault(x, len(number) + 1) for x in words_of(text)], np.int32) for text in texts]
    n = [len(x) for x in parts]
    if not sum(n):
        return None
    df = np.zeros((2, len(number) + 1), np.float32)
    for k, x in enumerate(parts):
        df[int(y[k])][np.unique(x)] += 1
    tokens, vocabulary = np.concatenate(parts), list(number)
    del parts, number
    known = np.flatnonzero(df.sum(0) >= LEAST_DF)
    net = Network(Network.fresh(rng, len(known)), {vocabulary[k - 1]: i + 1 for i, k in enumerate(known.tolist())})
    w = net.w
    rows = np.zeros(len(vocabulary), np.int64)
    rows[known - 1] = np.arange(1, len(known) + 1)
    # A word's smoothed log-odds over the sample: its own embedding may begin with them, and the first windows are chosen by them.
    share = (df[1] + 6 * y.mean()) / (df.sum(0) + 6)
    odds = np.where(df.sum(0) >= LEAST_DF, np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())), 0).clip(-3, 5).astype(np.float32)
    if odds_start:
        w["word"][1:, 0] = 0.5 * odds[known]
        w["word"][0] = 0
    doc, first, size = windows(n)
    first, step = (np.cumsum(n) - n)[doc] + first, np.arange(WINDOW)[:, None]
    worst = np.array([odds[tokens[a : a + k]].max() for a, k in zip(first.tolist(), size.tolist(), strict=True)], np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    flat, per_word = char_rows(vocabulary)
    begin, count = np.cumsum(per_word) - per_word, 0
    # A small sample is gone through more often.
    epochs = max(epochs, -(-LEAST_STEPS * 96 // max(96, len(y))))
    for epoch in range(epochs):
        if epoch:
            worst = net.logits(tokens, first, size, np.concatenate([net.nothing(), net.projections(vocabulary)]))
        # The worst window of each document, and for documents without a label 1 another one at random.
        order = np.lexsort((rng.random(len(doc)), worst, doc))
        last = np.append(np.flatnonzero(np.diff(doc[order])), len(doc) - 1)
        chosen = np.concatenate([order[last], rng.permutation(np.flatnonzero(y[doc] == 0))[: len(last) // 2]])
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        rng.shuffle(chosen)
        for k in range(0, len(chosen), 96):
            pick = chosen[k : k + 96]
            got = np.where(step < size[pick], tokens[np.minimum(first[pick] + step, len(tokens) - 1)], 0)
            used, local = np.unique(got, return_inverse=True)
            # Without a window that has an end that isn't filled there is no 0 among the words.
            local, used = local.reshape(got.shape) + int(used[0] > 0), used[used > 0] - 1
            chars = np.repeat(begin[used] - starts(per_word[used])[:-1], per_word[used]) + np.arange(per_word[used].sum())
            own_rows = np.where(rng.random(len(used)) < UNKNOWN, 0, rows[used])
            _, g = gradients(net, local, own_rows, flat[chars], per_word[used], y[doc[pick]], weight[doc[pick]] / len(pick))
            count += 1
            rate = 0.01 * min(1, count / 10) * (1 - 0.8 * epoch / epochs)
            for name, grad in g.items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                w[name] -= rate * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.99**count)) + 1e-6)
                if name in ("word", "char"):
                    w[name] *= 1 - 3e-4
    return Network(w, net.vocabulary)


def held_out(doc_id=None):
    return F.coalesce(F.crc32(F.col("doc_id" if doc_id is None else doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> list:
    """The bounded sample: at most ``per_class`` documents of each label, by a hash of doc_id, one text of each."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(picks), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, **options) -> Network | None:
    rows = training_rows(docs, labels, per_class, longest)
    return train((r.text for r in rows), [r.toxic for r in rows], **options)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((network.w, network.vocabulary) if network else None)

    def run(batches):
        net = Network(*sent.value) if sent.value else None
        for batch in small_batches(batches, 2_000_000):
            texts = batch.column("text").to_pylist()
            yield arrow({"doc_id": (batch.column("doc_id"), pa.int64()), "score": (net.score(texts) if net else np.zeros(len(texts)), pa.float64())})
            release()

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")


def clean_documents(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast((network.w, network.vocabulary) if network else None)

    def run(batches):
        net = Network(*sent.value) if sent.value else None
        for batch in small_batches(batches, 2_000_000):
            yield batch.filter(pa.array(net.score(batch.column("text").to_pylist()) < threshold)) if net else batch
            release()

    return docs.mapInArrow(released(run), docs.schema)
