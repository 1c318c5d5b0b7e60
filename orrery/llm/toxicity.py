"""Toxicity by a linear-chain conditional random field over words.

Method. Labels are given for documents, so tokens of the labelled training
documents are labelled first: a word of a toxic document is toxic if the word,
or its first letters, occur in many different contexts of toxic documents and
hardly ever in clean ones. A chain of two states is trained on these tokens. When scoring,
forward-backward gives each word's marginal; a document's score is its largest
one, and words at or above the threshold, as offsets, are its offending spans.

The model is fitted on a bounded sample of labelled rows: at most ``TRAIN_DOCS``
documents of each label (those of the smallest hash of the id) and ``TRAIN_BYTES``
of text, of which all pieces with a cue are learned from and ``CLEAN_PIECES`` times
as many, at random, of the clean ones. Every document is scored whole. The
forward-backward pass of a batch is one chain that starts anew at each
document, cut into blocks that are multiplied side by side.

Defined cases. Null and empty texts, and texts without letters, score 0. With
no labelled toxic or no clean document nothing can be learned and all scores
are 0. A document with several label rows is toxic if one says so. Repeated
rows give repeated results. Input columns besides id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Labelled documents of each label, and bytes of their texts, that the model is fitted on at most.
TRAIN_DOCS, TRAIN_BYTES = 1500, 48_000_000
#: Words of a training sequence, and sequences without a toxic word for each one with some.
PIECE, CLEAN_PIECES = 64, 3
#: Training sequences whose gradient is computed at once.
BATCH = 1024
#: Weights of hashed features.
BITS = 18
#: How unlikely by chance a feature's contexts must be, and how many toxic ones outweigh a clean one.
EVIDENCE, PENALTY = 18.0, 50
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learned."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) & ((1 << BITS) - 1)


def own_features(w: str) -> list[int]:
    return [_slot("w", w), _slot("p3", w[:3]), _slot("p4", w[:4]), _slot("p5", w[:5]), _slot("s3", w[-3:]), _slot("b", "")]


def neighbour_features(side: str, w: str) -> list[int]:
    return [_slot(side, w), _slot(side + "p4", w[:4])]


class Corpus:
    """Labelled documents as arrays of word numbers, so that a word is held once."""

    def __init__(self, docs: list[str], toxic: np.ndarray):
        number: dict[str, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int64) for t in docs]
        self.words, self.toxic = list(number), toxic

    def contexts(self, toxic: bool) -> np.ndarray:
        """Of each word, the number of different contexts (its neighbours) in documents of a label."""
        n = len(self.words) + 1
        keys = []
        for ids, t in zip(self.docs, self.toxic, strict=True):
            if t == toxic and len(ids):
                padded = np.r_[n - 1, ids, n - 1]
                keys.append((padded[1:-1] * n + padded[:-2]) * n + padded[2:])
        found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        return np.bincount(found // (n * n), minlength=n)[:-1]


def token_cues(corpus: Corpus) -> set[str]:
    """Features ("=word" or "^first letters") that occur in toxic documents and hardly ever in clean ones.

    What is counted are different contexts (the word with both neighbours), so
    that copies of one document don't vouch for each other. A feature counts
    if chance would put all of its contexts into toxic documents with a
    probability below exp(-EVIDENCE), and at most a PENALTY-th are clean.
    """
    counts = [corpus.contexts(False), corpus.contexts(True)]
    clean, bad = Counter(), Counter()
    for w, a, b in zip(corpus.words, counts[0].tolist(), counts[1].tolist(), strict=True):
        for cue in {f"={w}", *(f"^{w[:k]}" for k in (4, 5) if len(w) >= k)}:
            clean[cue] += a
            bad[cue] += b
    surprise = -np.log(counts[1].sum() / max(1, counts[0].sum() + counts[1].sum()))
    found = {c for c, n in bad.items() if n * surprise >= EVIDENCE and clean[c] * PENALTY <= n}
    # First letters that stand for one word only say no more than the word, and might catch others.
    for w in [c[1:] for c in found if c[0] == "="]:
        found -= {c for c in (f"^{w[:4]}", f"^{w[:5]}") if c in found and bad[f"={w}"] >= 0.85 * bad[c]}
    return found


def has_cue(w: str, cues: set[str]) -> bool:
    return f"={w}" in cues or f"^{w[:4]}" in cues or f"^{w[:5]}" in cues


class Chain:
    """Weights of the features for the toxic state, and scores of the four transitions and the start."""

    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.t = np.zeros((2, 2))
        self.start = np.zeros(2)

    def fit(self, feats: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 40, rate: float = 0.2) -> None:
        """feats: (sequences, words, features) slots; y, mask: (sequences, words). Full-batch Adam on the likelihood."""
        m = [np.zeros_like(self.w), np.zeros((2, 2)), np.zeros(2)]
        v = [np.zeros_like(self.w), np.zeros((2, 2)), np.zeros(2)]
        n = max(1, len(y))
        for step in range(1, rounds + 1):
            sums = [np.zeros(1 << BITS), np.zeros((2, 2)), np.zeros(2)]
            for k in range(0, len(y), BATCH):
                for total, part in zip(sums, self._gradient(feats[k : k + BATCH], y[k : k + BATCH], mask[k : k + BATCH]), strict=True):
                    total += part
            grads = [(sums[0] / n + 1e-4 * self.w).astype(np.float32), sums[1] / n + 1e-3 * self.t, sums[2] / n + 1e-3 * self.start]
            for k, (x, g) in enumerate(zip((self.w, self.t, self.start), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(x.dtype)

    def _gradient(self, feats: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected less observed counts of the features, transitions and starts of some sequences."""
        flat, width = feats[mask], feats.shape[2]
        pair_mask = mask[:, 1:] & mask[:, :-1]
        s = np.zeros(y.shape)
        s[mask] = self.w[flat].sum(axis=1)
        p, pairs, start = self._expect(s, mask, pair_mask)
        error = (p - y)[mask]
        g = np.zeros(1 << BITS)
        for k in range(width):
            g += np.bincount(flat[:, k], error, 1 << BITS)
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] -= (pair_mask & (y[:, :-1] == i) & (y[:, 1:] == j)).sum()
        return g, pairs, start - np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()])

    def _expect(self, s, mask, pair_mask):
        """Marginals of the toxic state, expected transitions and starts of padded sequences."""
        n, length = s.shape
        e = np.ones((n, length, 2))
        e[:, :, 1] = np.exp(np.clip(s, -30, 30))
        tr = np.exp(self.t)
        a, b = np.zeros((n, length, 2)), np.ones((n, length, 2))
        a[:, 0] = np.exp(self.start) * e[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for i in range(1, length):
            x = (a[:, i - 1] @ tr) * e[:, i]
            a[:, i] = np.where(pair_mask[:, i - 1, None], x / x.sum(1, keepdims=True), a[:, i - 1])
        for i in range(length - 2, -1, -1):
            x = (b[:, i + 1] * e[:, i + 1]) @ tr.T
            b[:, i] = np.where(pair_mask[:, i, None], x / x.sum(1, keepdims=True), 1.0)
        p = a * b
        p /= p.sum(2, keepdims=True)
        x = a[:, :-1, :, None] * tr * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        x /= x.sum((2, 3), keepdims=True)
        return p[:, :, 1] * mask, (x * pair_mask[:, :, None, None]).sum((0, 1)), p[:, 0].sum(0)

    def marginals(self, s: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Marginal of the toxic state of each word of a row of documents; begins: whether a document starts there."""
        n = len(s)
        if not n:
            return np.empty(0)
        rows = max(1, int(np.sqrt(n)))
        cols = -(-n // rows)
        pad = rows * cols - n
        s, begins = np.r_[s, np.zeros(pad)], np.r_[begins, np.ones(pad, bool)]
        m = np.where(begins[:, None, None], np.exp(self.start)[None, None, :], np.exp(self.t)[None])
        m = m * np.stack([np.ones(rows * cols), np.exp(np.clip(s, -30, 30))], 1)[:, None, :]
        m /= m.sum((1, 2), keepdims=True)
        m = m.reshape(cols, rows, 2, 2).transpose(1, 0, 2, 3)  # m[i, k]: word i of block k
        product = m[0].copy()
        for i in range(1, rows):
            product = product @ m[i]
            product /= product.sum((1, 2), keepdims=True)
        fore, back = np.empty((cols, 2)), np.empty((cols, 2))
        x = np.array([0.5, 0.5])
        for k in range(cols):
            fore[k] = x
            x = x @ product[k]
            x /= x.sum()
        x = np.array([0.5, 0.5])
        for k in range(cols - 1, -1, -1):
            back[k] = x
            x = product[k] @ x
            x /= x.sum()
        a, b = np.empty((rows, cols, 2)), np.empty((rows, cols, 2))
        for i in range(rows):
            fore = np.einsum("ki,kij->kj", fore, m[i])
            fore /= fore.sum(1, keepdims=True)
            a[i] = fore
        for i in range(rows - 1, -1, -1):
            b[i] = back
            back = np.einsum("kij,kj->ki", m[i], back)
            back /= back.sum(1, keepdims=True)
        p = a * b
        p = p[:, :, 1] / p.sum(2)
        return p.T.ravel()[:n]


def fit(docs: list[str], toxic: list[bool], seed: int = 7) -> Chain | None:
    """The model of some labelled documents, or None if they teach nothing."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    corpus = Corpus(docs, y)
    cues = token_cues(corpus)
    tagged = np.array([has_cue(w, cues) for w in corpus.words], bool)
    rich, poor = [], []
    for ids, t in zip(corpus.docs, y, strict=True):
        for k in range(0, len(ids), PIECE):
            part = ids[k : k + PIECE]
            # Pieces of toxic documents without a cue say nothing reliable, as their cue may be unknown.
            if not t:
                poor.append(part)
            elif tagged[part].any():
                rich.append(part)
    if not rich:
        return None
    pick = np.random.default_rng(seed).permutation(len(poor))[: CLEAN_PIECES * len(rich)]
    pieces = rich + [poor[i] for i in pick]
    used = np.unique(np.concatenate(pieces))
    slots = np.zeros((len(corpus.words), 10), np.int32)
    for i in used.tolist():
        w = corpus.words[i]
        slots[i] = own_features(w) + neighbour_features("l", w) + neighbour_features("r", w)
    none = _slot("none", "")
    feats = np.full((len(pieces), PIECE, 10), none, np.int32)
    tags, mask = np.zeros((len(pieces), PIECE), np.int8), np.zeros((len(pieces), PIECE), bool)
    for r, part in enumerate(pieces):
        n = len(part)
        feats[r, :n, :6] = slots[part, :6]
        feats[r, 1:n, 6:8] = slots[part[:-1], 6:8]
        feats[r, : n - 1, 8:] = slots[part[1:], 8:]
        tags[r, :n] = tagged[part] if r < len(rich) else 0
        mask[r, :n] = True
    chain = Chain()
    chain.fit(feats, tags, mask)
    return chain


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """Fit on the labelled documents outside the held-out fold."""
    known = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    picked = [known.filter(f"toxic = {k}").orderBy(rank, "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    chosen = picked[0].union(picked[1]).select(F.col("doc_id").alias("id"), "toxic")  # 2 * TRAIN_DOCS rows at most
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("t")).join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("t"))
    # An id may occur again: the texts are chosen by their sizes before any is fetched.
    rank = [F.xxhash64("id"), F.col("id"), F.col("h")]
    sizes = rows.select("id", "h", F.octet_length("t").alias("size")).distinct().orderBy(*rank).limit(2 * TRAIN_DOCS).collect()
    total, wanted = 0, []
    for r in sizes:
        if total + r["size"] <= TRAIN_BYTES:
            total += r["size"]
            wanted.append((r["id"], r["h"]))
    if not wanted:
        return None
    few = docs.sparkSession.createDataFrame(wanted, rows.select("id", "h").schema)
    found = rows.join(F.broadcast(few), ["id", "h"]).dropDuplicates(["id", "h"]).orderBy(*rank).collect()
    return fit([r["t"] for r in found], [r["toxic"] == 1 for r in found])


class Scorer:
    """Scores documents; remembers what each word adds to its own and its neighbours' scores."""

    def __init__(self, chain: Chain):
        self.chain, self.at, self.parts = chain, {}, []
        self.none = float(chain.w[_slot("none", "")]) * 2

    def learn(self, words: set[str]) -> None:
        if len(self.at) > REMEMBERED:
            self.at, self.parts = {}, []
        new = [w for w in words if w not in self.at]
        if not new:
            return
        slots = np.array([own_features(w) + neighbour_features("l", w) + neighbour_features("r", w) for w in new])
        x = self.chain.w[slots].astype(float)
        base = len(self.at)
        self.at.update((w, base + i) for i, w in enumerate(new))
        self.parts.append(np.stack([x[:, :6].sum(1), x[:, 6:8].sum(1), x[:, 8:10].sum(1)], 1))
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, and where each document with words begins."""
        self.learn({w for ws in docs for w in ws})
        at = np.fromiter((self.at[w] for ws in docs for w in ws), np.int64)
        starts = np.cumsum([0, *(len(ws) for ws in docs if ws)])[:-1].astype(np.int64)
        if not len(at):
            return np.empty(0), starts[:0]
        begins = np.zeros(len(at), bool)
        begins[starts] = True
        ends = np.r_[begins[1:], True]
        own, left, right = self.parts[0][at].T
        s = own + np.where(begins, self.none, np.r_[0.0, left[:-1]]) + np.where(ends, self.none, np.r_[right[1:], 0.0])
        return self.chain.marginals(s, begins), starts


def score(df: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``score`` and ``spans`` (start, end, p of words at or above the threshold) of every document."""
    types = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(chain)  # 2^BITS weights

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts, scores, spans = batch.column(1).to_pylist(), [], []
            k = 0
            while k < len(texts):
                group, size = [], 0
                while k < len(texts) and (not group or size + len(texts[k]) < 1_500_000):
                    size += len(texts[k])
                    group.append(texts[k])
                    k += 1
                if scorer is None:
                    scores += [0.0] * len(group)
                    spans += [[]] * len(group)
                    continue
                docs = [words_of(t) for t in group]
                p, starts = scorer.marginals(docs)
                ends = [*starts[1:].tolist(), len(p)]
                of = iter(zip(starts.tolist(), ends, strict=True))
                for text, ws in zip(group, docs, strict=True):
                    if not ws:
                        scores.append(0.0)
                        spans.append([])
                        continue
                    a, b = next(of)
                    scores.append(float(p[a:b].max()))
                    bad = set(np.flatnonzero(p[a:b] >= threshold).tolist())
                    found = enumerate(_WORD.finditer(text)) if bad else ()
                    spans.append([{"start": m.start(), "end": m.end(), "p": float(p[a + i])} for i, m in found if i in bad])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], [id_col, "score", "spans"])

    src = df.select(F.col(id_col), text_of(df, text_col).alias("t"))
    return map_arrow(src, run, f"`{id_col}` {types[id_col]}, score double, spans array<struct<start:int,end:int,p:double>>")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, each judged where it stands."""
    chain = train(df, labels, id_col, text_col)
    schema, at = df.schema, df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            keep = np.ones(len(texts), bool)
            k = 0
            while scorer and k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size + len(texts[end]) < 1_500_000):
                    size += len(texts[end])
                    end += 1
                docs = [words_of(t) for t in texts[k:end]]
                p, starts = scorer.marginals(docs)
                if len(p):
                    has = np.flatnonzero([bool(ws) for ws in docs])
                    keep[k + has] = np.maximum.reduceat(p, starts) < threshold
                k = end
            yield batch.filter(pa.array(keep))

    return map_arrow(df, run, schema)
