"""Language-model scores by cross-entropy difference.

Method. Two word bigram models of the same order, smoothing and vocabulary are
counted: the target model over the documents that the labels call good, the
background model over all documents. A document's score is the mean over its
tokens of the target's loss less the background's, so that a lower score means
closer to the target.

Between white space, a token is a run of ASCII punctuation or one of all other
characters, as written; one mark begins and ends each document. The shared
vocabulary is every token of the corpus; nothing is cut off by frequency, so the
table of grams grows with the input. Tokens and bigrams are counted by 64-bit
hashes. Every document is scored without its own counts, in either model that
holds it, so that no model has seen what it scores. The counts ``k`` of both models
are scaled to the target's size ``N``, so that what neither has seen costs the same
in both. With the vocabulary's size ``V``:

    p(w) = (k(w) + FLOOR) / (N + FLOOR V)        p(w | v) = (k(v w) + PRIOR p(w)) / (k(v) + PRIOR)

Plan. Texts are written to the shared folder once, in blocks of ``BLOCK`` bytes, each
one row of compressed pieces. Where it lies, each block is counted and sends every
distinct gram once, packed by hash range; a task for each range adds the counts up
and answers each block in the order of its grams; each block is then scored with its
answers. Only this last step sends texts, so that their copies on disk are two. A gram
of every document costs one entry for each block, and no task holds more than one
range or one block (or one longer text). Each range is of one kind of gram and holds
that of several blocks, as a row for each block and range has a cost of its own.
Nothing but three sums reaches the driver, and nothing is broadcast but the good ids,
if they are few.

Defined cases. Null and empty texts, and those of white space, have no tokens and
losses of 0. Without good documents both models are uniform over the vocabulary, and
scores are 0; so is the target for its only document. An empty table gives an empty result. Repeated rows count as often as they occur, and
each is scored without itself only. Only id and text are read, so other columns
can't clash; several labels of a document make it good if one does. ``n_tokens``
leaves the marks out; the losses are means over the tokens and the closing mark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, small, text_of

#: Counts by which a token's own frequency smooths the bigrams that end in it.
PRIOR = 1000.0
#: Count that each token of the vocabulary has beforehand.
FLOOR = 0.1
#: Bytes of text in a block, unless one text is longer.
BLOCK = 8_000_000
#: Bytes of text that are compressed together, unless one text is longer.
PIECE = 1_000_000
#: Level of zstd for texts; each is written to disk twice, which costs more than the time.
LEVEL = 6
#: Binary digits by which there are fewer hash ranges of bigrams than blocks, and fewer of tokens than of bigrams.
WIDER = 2
#: Events whose losses are computed at once, unless one document has more.
EVENTS = 250_000
#: Bytes of tokens that are hashed at once, unless one token is longer.
CHUNK = 1_000_000

#: Class of each byte: 0 white space, 1 ASCII punctuation, 2 others.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
_MARK = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MARK)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of the texts, and each text's number of tokens."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    kind = _CLASS[data]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]])
    token = kind[edge[:-1]] > 0
    start, end = edge[:-1][token], edge[1:][token]
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, "right")))
        length = end[k:to] - start[k:to]
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), _MARK), dtype=np.uint64)
            out[k:to] = mix(np.add.reduceat(_BYTES[data[np.repeat(start[k:to], length) + place]] * power[place], first))
        k = to
    return out, np.bincount(np.searchsorted(bounds, start, "right"), minlength=len(texts))


class Events:
    """The tokens of a block in order: for each its document, its gram of one word and its bigram."""

    def __init__(self, texts: list[str]):
        found, self.n_tokens = tokens(texts)
        #: Documents with tokens, which alone have events.
        self.docs = np.flatnonzero(self.n_tokens)
        n = self.n_tokens[self.docs]
        self.last = np.cumsum(n + 1) - 1
        self.first = self.last - n
        self.doc = np.repeat(self.docs, n + 1)
        at = np.arange(len(found)) + np.repeat(np.arange(len(n)), n)
        self.token, before = (np.full(len(self.doc), _MARK) for _ in range(2))
        self.token[at], before[at + 1] = found, found
        with np.errstate(over="ignore"):
            self.pair = mix(before * np.uint64(0xD6E8FEB86659FD93) + mix(self.token))

    def groups(self):
        """Runs of whole documents of ``EVENTS`` events, unless one has more: the events' slice, and each document's first and last in it."""
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.last, self.first[a] + EVENTS)))
            yield slice(self.first[a], self.last[b - 1] + 1), self.first[a:b] - self.first[a], self.last[a:b] - self.first[a]
            a = b


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte of equal weight, as high bytes are mostly zero; their number stands before them."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = 8 * int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def read_block(data: pa.Scalar) -> pa.Table:
    """id, good and t of the rows of a block."""
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def blocks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, good and text, as one compressed Arrow stream for each block, written to the shared folder."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_id")).distinct().withColumn("good", F.lit(True))
    src = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("t"))
    src = src.join(small(good), F.col("id") == F.col("good_id"), "left")
    src = src.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("good", F.lit(False)).alias("good"), "t")

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        block, size = None, 0
        for batch in batches:
            start, held = 0, 0
            numbers, lengths = batch.column(0).to_pylist(), pa.compute.binary_length(batch.column(3)).to_pylist()
            for k, (number, length) in enumerate(zip(numbers, lengths, strict=True)):
                full = block is None or size + length > BLOCK
                if k > start and (full or held + length > PIECE):
                    out.write_batch(rows(batch, start, k))
                    start, held = k, 0
                if full:
                    if block is not None:
                        yield ended(block, sink, out)
                    block, size, sink = number, 0, pa.BufferOutputStream()  # a block is named by its first row
                    out = pa.ipc.new_stream(sink, rows(batch, 0, 0).schema, options=options)
                size, held = size + length, held + length
            if batch.num_rows:
                out.write_batch(rows(batch, start, batch.num_rows))
        if block is not None:
            yield ended(block, sink, out)

    def rows(batch, start, end):
        return pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in batch.columns[1:]], ["id", "good", "t"])

    def ended(block, sink, out):
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "pieces"])

    return materialize(map_arrow(src, run, "block long, pieces binary"), "blocks")


def count_grams(held: DataFrame, bits: int) -> DataFrame:
    """Per block, kind (0 tokens, 1 bigrams) and hash range, of ``bits`` binary digits for bigrams: the sorted grams' differences, and counts in all and in good texts."""

    def run(batches):
        for batch in batches:
            for block, pieces in zip(*batch.columns, strict=True):
                yield count(block.as_py(), read_block(pieces))

    def count(block: int, texts: pa.Table) -> pa.RecordBatch:
        events = Events(texts.column("t").to_pylist())
        good = texts.column("good").to_numpy()[events.doc].astype(bool)
        rows = []
        for kind, (keys, bits) in enumerate(((events.token, token_bits), (events.pair, pair_bits))):
            grams, counts = np.unique(keys, return_counts=True)
            target = np.bincount(np.searchsorted(grams, keys[good]), minlength=len(grams))
            ranges = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            for part in np.split(np.arange(len(grams)), np.flatnonzero(np.diff(ranges)) + 1):
                if len(part):
                    steps = np.diff(grams[part], prepend=np.uint64(0))
                    rows.append((int(ranges[part[0]]), block, kind, pack(steps), pack(counts[part]), pack(target[part])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _COUNTED.types, strict=True)], schema=_COUNTED)

    pair_bits, token_bits = bits, max(0, bits - WIDER)
    return map_arrow(held, run, "range long, block long, kind int, steps binary, total binary, good binary")


_COUNTED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("steps", pa.binary()), ("total", pa.binary()), ("good", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("total", pa.binary()), ("good", pa.binary()), ("vocabulary", pa.int64()), ("n_total", pa.int64()), ("n_good", pa.int64())])


def add_up(counted: DataFrame) -> DataFrame:
    """The corpus's counts, for each block in the order of its grams; a row without block holds the range's sums of tokens."""

    def run(table: pa.Table) -> pa.Table:
        rows, sent = [], table.to_pylist()
        kind = sent[0]["kind"]
        held = [np.cumsum(unpack(r["steps"]), dtype=np.uint64) for r in sent]
        grams, at = np.unique(np.concatenate(held), return_inverse=True)
        sums = []
        for c in ("total", "good"):
            s = np.zeros(len(grams), np.int64)
            np.add.at(s, at, np.concatenate([unpack(r[c]) for r in sent]).astype(np.int64))
            sums.append(s)
        cuts = np.cumsum([len(h) for h in held])[:-1]
        for r, places in zip(sent, np.split(at, cuts), strict=True):
            rows.append((r["block"], kind, r["range"], pack(sums[0][places]), pack(sums[1][places]), None, None, None))
        if kind == 0:
            rows.append((None, None, None, None, None, len(grams), int(sums[0].sum()), int(sums[1].sum())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANSWER.types, strict=True)], schema=_ANSWER)

    schema = "block long, kind int, range long, total binary, good binary, vocabulary long, n_total long, n_good long"
    return materialize(counted.groupBy("kind", "range").applyInArrow(run, schema), "grams")


def losses(events: Events, good: np.ndarray, corpus: list[np.ndarray], n: tuple[int, int], vocabulary: int) -> np.ndarray:
    """(2, events): loss of each token in the target and in the background model, without its document's own counts.

    ``corpus`` holds, for tokens and for bigrams, the (2, grams) counts of the block's sorted grams; model 0 is the target.
    """
    found = []
    for keys in (events.token, events.pair):
        grams, at = np.unique(keys, return_inverse=True)
        found.append((len(grams), at.astype(np.int32)))
    out = np.empty((2, len(events.doc)))
    for part, first, last in events.groups():
        doc, own = events.doc[part], []
        for kinds, at in found:
            _, again, times = np.unique(doc * kinds + at[part], return_inverse=True, return_counts=True)
            own.append(times[again])
        length = (events.n_tokens + 1)[doc]
        for model, held in enumerate((good[doc], np.ones(len(doc), bool))):
            others = n[model] - length * held
            size = np.where(others > 0, n[0], 0)
            scale = size / np.maximum(others, 1)
            one, two = (scale * (c[model][at[part]] - o * held) for c, (_, at), o in zip(corpus, found, own, strict=True))
            p = (one + FLOOR) / (size + FLOOR * vocabulary)
            # The token before the first is the closing mark's twin.
            before = np.roll(one, 1)
            before[first] = one[last]
            out[model, part] = -np.log((two + PRIOR * p) / (before + PRIOR))
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``target_loss``, ``background_loss`` (means) and ``score`` of every document."""
    held = blocks(docs, labels, id_col, text_col)
    bits = max(0, max(0, held.count() - 1).bit_length() - WIDER)
    answers = add_up(count_grams(held, bits))
    sums = answers.filter("block is null").agg(F.sum("vocabulary"), F.sum("n_total"), F.sum("n_good")).first()
    vocabulary, n_total, n_good = (x or 0 for x in sums)
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([("n", pa.int64()), ("target", pa.float64()), ("background", pa.float64())])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        rows = read_block(block.column("pieces")[0])
        events = Events(rows.column("t").to_pylist())
        found = found.sort_by([("kind", "ascending"), ("range", "ascending")])
        corpus = []
        for k in (0, 1):
            mine = found.filter(pa.compute.equal(found.column("kind"), k))
            corpus.append(np.stack([np.concatenate([unpack(x) for x in mine.column(c).to_pylist()] or [np.empty(0, np.uint64)]).astype(np.int64) for c in ("good", "total")]))
        lost = losses(events, rows.column("good").to_numpy().astype(bool), corpus, (n_good, n_total), vocabulary)
        means = [np.bincount(events.doc, weights=x, minlength=rows.num_rows) / (events.n_tokens + 1) for x in lost]
        sums = pa.Table.from_arrays([pa.array(events.n_tokens, pa.int64()), pa.array(means[0]), pa.array(means[1])], schema=schema)
        return pa.Table.from_arrays([rows.column("id"), *sums.columns], ["id", "n", "target", "background"])

    out = held.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInArrow(run, f"id {kind}, n long, target double, background double")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("target").alias("target_loss"), F.col("background").alias("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))
