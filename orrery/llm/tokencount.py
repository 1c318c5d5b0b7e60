"""Token counts by dynamic programming over a trie of pre-tokens.

Method. Texts are cut into pre-tokens. The distinct ones not counted yet are
taken in sorted order, which walks their trie depth first: the unigram forward
scores (the best score of any segmentation of a prefix, and its number of
tokens) are kept for the current path, so that a prefix shared by many
pre-tokens is scored once. The score at a pre-token's end gives its terminal
count, which is stored and looked up for every occurrence.

The vocabulary is that of a public tokenizer; it is never trained here. A token
of rank r has the unigram score -log(r + ``OFFSET``), by the Zipf-Mandelbrot law
that ranked vocabularies follow. Every byte is a token, so every text has a
segmentation. Of equal scores the one with fewer tokens counts.

Defined cases. Null and empty texts have 0 tokens. A long text is counted in
slices of pre-tokens. Repeated rows give repeated results; an empty table gives
an empty result. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import math
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import GROUP_CHARS, PATTERN, grouped
from .common import map_arrow, text_of

OFFSET = 10
#: Pre-tokens of a text held at once, and distinct ones whose counts a worker remembers.
SLICE, REMEMBERED = 200_000, 500_000

_CUT = regex.compile(PATTERN)


class Unigram:
    """Scores of the tokens, and the endings of tokens, by which a search backwards ends early."""

    def __init__(self, ranks: dict[bytes, int]):
        self.score = {t: -math.log(r + OFFSET) for t, r in ranks.items()}
        self.endings = {t[k:] for t in ranks for k in range(len(t))}

    @classmethod
    def load(cls, path: str) -> Unigram:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def count(self, words: list[bytes]) -> dict[bytes, int]:
        """Terminal counts of distinct pre-tokens, each shared prefix scored once."""
        out: dict[bytes, int] = {}
        best: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) of the prefix of each length on the path
        last = b""
        score, endings = self.score, self.endings
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                top = None
                for i in range(j - 1, -1, -1):
                    part = word[i:j]
                    if part not in endings:
                        break
                    s = score.get(part)
                    if s is not None:
                        before = best[i]
                        now = (before[0] + s, before[1] - 1)
                        if top is None or now > top:
                            top = now
                best.append(top)
            out[word] = -best[len(word)][1]
            last = word
        return out


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_pre_tokens`` and ``n_tokens`` of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(Unigram.load(path))  # of the vocabulary's size

    def run(batches):
        model, known = shared.value, {}

        def learn(words: set[str]) -> None:
            new = {w for w in words if w not in known}
            if len(known) > REMEMBERED:
                known.clear()
                new = words
            found = model.count([w.encode() for w in new])
            known.update((w, found[w.encode()]) for w in new)

        for batch in batches:
            pre, n = [], []
            for group in grouped(batch.column(1).to_pylist()):
                if sum(map(len, group)) <= GROUP_CHARS:
                    cut = [_CUT.findall(t) for t in group]
                    learn({w for part in cut for w in part})
                    pre += map(len, cut)
                    n += [sum([known[w] for w in part]) for part in cut]
                    continue
                words, p, k = _CUT.finditer(group[0]), 0, 0
                while part := [m.group() for m in islice(words, SLICE)]:
                    learn(set(part))
                    p += len(part)
                    k += sum([known[w] for w in part])
                pre.append(p)
                n.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre, pa.int64()), pa.array(n, pa.int64())], [id_col, "n_pre_tokens", "n_tokens"])

    src = df.select(F.col(id_col), text_of(df, text_col).alias("t"))
    return map_arrow(src, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_pre_tokens long, n_tokens long")

