"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Method. A text is cut into pre-tokens by the vocabulary's pattern. Pre-tokens
not seen yet are laid out as one flat array of symbols. In each round the keys
``left * V + right`` of all neighbouring symbols are found by binary search in
the sorted pair keys; the lowest rank of every word is merged at all its
places, from left to right, and words without a known pair leave the array.

Defined cases. A null text counts as empty: no tokens, the hashes of the empty
string. A text of any length is processed in slices of pre-tokens, so that
memory stays bounded. Repeated rows give repeated results. Strings of special
tokens inside a text are encoded as these tokens. Columns besides the id and
the text are not read, so their names can't clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a text that are held at once.
SLICE = 200_000
#: Characters of texts that are pre-tokenized together.
GROUP_CHARS = 2_000_000
#: Distinct pre-tokens whose encoding a worker remembers before it starts afresh.
REMEMBERED = 300_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a printable byte is itself, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass
class Tables:
    """A vocabulary as arrays; small enough to broadcast, as its size is that of the vocabulary file."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    width: int
    token_bytes: list[bytes]
    specials: dict[str, int]
    _cut: object = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> Tables:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        width = max([*vocab.values(), *specials.values()]) + 1
        token_bytes = [b""] * width
        for token, i in vocab.items():
            token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in specials.items():
            token_bytes[i] = token.encode()
        byte_ids = np.full(256, -1, np.int64)
        for c, b in alphabet.items():
            byte_ids[b] = vocab.get(c, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(byte_ids, keys[order], order.astype(np.int64), merged[order], width, token_bytes, specials)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by merge rounds over all of them at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        if len(symbols) and symbols.min() < 0:
            known = symbols >= 0  # bytes without a token are left out, as in a vocabulary without an unknown token
            symbols, owner = symbols[known], owner[known]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            known = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            rank = np.full(len(symbols), NONE)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            active = lowest < NONE
            places = np.flatnonzero(active & (rank == lowest))
            run = np.r_[True, np.diff(places) != 1] if len(places) else np.empty(0, bool)
            first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            symbols[places] = self.merged[at[places]]
            if not active.all():
                done.append((owner[~active], symbols[~active]))
            active[places + 1] = False
            symbols, owner = symbols[active], owner[active]
        out: list[list[int]] = [[] for _ in words]
        if done:
            owner = np.concatenate([x for x, _ in done])
            symbols = np.concatenate([x for _, x in done])
            order = np.argsort(owner, kind="stable")
            owner, symbols = owner[order], symbols[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for w, part in zip(owner[starts].tolist(), np.split(symbols, starts[1:]), strict=True):
                out[w] = part.tolist()
        return out

    def pre_tokens(self, text: str) -> Iterator[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self._cut is None:
            split = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
            self._cut = (regex.compile(PATTERN), regex.compile(f"({split})") if split else None)
        words, special = self._cut
        if special is None or not special.search(text):
            return (m.group() for m in words.finditer(text))
        return (w for part in special.split(text) if part for w in ([part] if part in self.specials else words.findall(part)))

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder:
    """Encodes texts with a bounded memory of pre-tokens that were encoded before, whose ids are kept as bytes."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for w in new:
            if w in self.tables.specials:
                self.known[w] = _packed([self.tables.specials[w]])
        new = [w for w in new if w not in self.tables.specials]
        self.known.update(zip(new, map(_packed, self.tables.encode_words([w.encode() for w in new])), strict=True))

    def ids(self, words: list[str]) -> list[int]:
        """The ids of learned pre-tokens, in order."""
        known = self.known
        return np.frombuffer(b"".join([known[w] for w in words]), np.int32).tolist()

    def slices(self, text: str) -> Iterator[list[str]]:
        words = self.tables.pre_tokens(text)
        while part := list(islice(words, SLICE)):
            yield part

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, slice by slice."""
        for part in self.slices(text):
            self.learn(set(part))
            yield self.ids(part)

    def encode_each(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of some short texts, one by one, whose new pre-tokens are merged in the same rounds."""
        cut = [list(self.tables.pre_tokens(t)) for t in texts]
        self.learn({w for part in cut for w in part})
        return map(self.ids, cut)

    def encode_group(self, texts: list[str]) -> list[list[int]]:
        return list(self.encode_each(texts))


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of a column, of which some are taken out of it at once."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def grouped(texts: Iterable[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Neighbouring texts of ``most`` characters together; a longer one stands alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _digest(parts: Iterator[list[int]], tables: Tables, names: list[str]) -> tuple[int, str, str]:
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        ids_hash.update((b"," if n else b"") + ",".join([names[i] for i in ids]).encode())
        text_hash.update(decoder.decode(b"".join([tables.token_bytes[i] for i in ids])).encode())
        n += len(ids)
    text_hash.update(decoder.decode(b"", True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(Tables.load(path))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            out = []
            for group in grouped(texts_of(batch.column(1))):
                out += encoder.encode_group(group) if sum(map(len, group)) <= GROUP_CHARS else [[i for part in encoder.encode(group[0]) for i in part]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [id_col, "ids"])

    src = df.select(F.col(id_col), text_of(df, text_col).alias("t"))
    return map_arrow(src, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of rows of ids; ids outside the vocabulary are an error, a null list is the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Tables.load(path))

    def run(batches):
        tables = shared.value
        for batch in batches:
            out = [tables.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    return map_arrow(df.select(id_col, ids_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Ids and texts are hashed as they come, so that a row of any length needs
    the memory of a slice, and only the digests leave the worker.
    """
    shared = df.sparkSession.sparkContext.broadcast(Tables.load(path))

    def run(batches):
        tables = shared.value
        encoder, names = Encoder(tables), [str(i) for i in range(tables.width)]
        for batch in batches:
            out = []
            for group in grouped(texts_of(batch.column(1))):
                if sum(map(len, group)) <= GROUP_CHARS:
                    out += [_digest(iter([ids]), tables, names) for ids in encoder.encode_each(group)]
                else:
                    out.append(_digest(encoder.encode(group[0]), tables, names))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(F.col(id_col), text_of(df, text_col).alias("t"))
    return map_arrow(src, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
