"""Benchmark decontamination by latent semantic retrieval.

Method. Documents are cut into passages of words. Words of the benchmark are
the terms; their inverse document frequency is counted over all documents. A
distributed randomised SVD of the TF-IDF passages of all documents and of the
benchmark gives a latent space: every task sketches A'(A R) for a random R over
its own passages, the sketches are summed per term, and the driver finishes
with matrices of terms by ranks (the benchmark's vocabulary bounds them).
Sliding passages of every document are then compared by cosine with the items,
a long item by the passages that it has itself. Passages around which there are
too few of an item's rarer words for half of the item are passed over before: no
common subsequence could be long enough there. Items of which too few words have
weight, as when many documents hold the item, have no cosine to go by, and all
passages that hold enough of their words are candidates.
Candidates are checked on the words: the longest common subsequence with the
item and, where it covers the item only in part, as in a paraphrase, its answer
(the end of the item) must be there as well.

Defined cases. Null and empty documents are clean; items without words
match nothing; an empty benchmark leaves all documents clean. Items that share
an id are searched each with its own text, and one without id is named null.
Documents are read whole, a long one in slices that overlap by more than a leak
of the longest item. Repeated rows give repeated results. Input columns besides
id and text aren't read.
"""

from __future__ import annotations

import re
import string
import unicodedata
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release, small, tables, text_of

#: Words of a passage.
PASSAGE = 48
#: Words of sliding passages; an item is searched with the longest that it fills, and with the shortest otherwise.
SLIDING = (12, 24, 48)
#: Rank of the latent space, and columns by which the sketch is wider.
RANK, EXTRA = 96, 16
#: Cosine from which a passage and an item are candidates.
COSINE = 0.4
#: Share of the item in the common subsequence: certain, and enough if the answer is there too.
CERTAIN, PARTIAL = 0.75, 0.5
#: Share of the item that is its answer, and of the answer that must be found.
ANSWER, ANSWERED = 0.25, 0.7
#: A term in more than this share of documents has no weight.
COMMON = 0.1
#: Documents of which any number may hold a term without its being common.
FEW = 50
#: An item with a smaller share of words that have weight is compared with all passages instead.
WEIGHTED = 0.5
#: Items, and bytes of their texts, that are searched in one pass over the documents; a larger benchmark takes several.
ITEMS, ITEM_BYTES = 20_000, 1 << 24
#: Share of an item, beyond what a leak may lack, that its rarer words make up by which passages are passed over.
RARER = 0.15
#: Words of a block in which rarer words are counted, and items counted at once.
STEP, TOGETHER = 12, 256
#: Words of a document that are held at once.
SLICE = 200_000

_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def _runs(codes: list[int]) -> str:
    """A character class of some code points, by their runs."""
    runs = [[c for _, c in g] for _, g in groupby(enumerate(codes), lambda x: x[1] - x[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


#: Punctuation, symbols and spaces beyond ASCII, as Unicode has them (in the first plane).
_MARKS = re.compile(f"[{_runs([c for c in range(128, 0xFFFE) if unicodedata.category(chr(c))[0] in 'PSZ'])}]+")


def words_of(text: str) -> list[bytes]:
    """Lower-case words between white space, punctuation and symbols, in UTF-8."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_SPACED).split()


def lcs_mask(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one number for all of ``a``."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def matches(item: list[int], region: list[int]) -> float:
    """How much of the item (of term numbers) the region holds, if it counts as leaked, else 0."""
    have = set(region)
    if sum(w in have for w in item) < PARTIAL * len(item):
        return 0.0
    share = lcs_mask(item, region) / len(item)
    if share >= CERTAIN:
        return share
    answer = item[-max(1, round(ANSWER * len(item))) :]
    return share if share >= PARTIAL and lcs_mask(answer, region) >= ANSWERED * len(answer) else 0.0


class Terms:
    """The terms of the benchmark, by word, with their weights."""

    def __init__(self, words: list[bytes]):
        self.at = {w: i for i, w in enumerate(words)}
        self.idf = np.ones(len(words), np.float32)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and which terms they are."""
        ids = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(ids >= 0).astype(np.int32)
        return at, ids[at]


def term_places(src: DataFrame, terms: Terms, longest: int = PASSAGE) -> DataFrame:
    """row, id, part, at and term: the places of the benchmark's terms, of each document or, if long, of its slices.

    Texts are read and cut into words once; all later passes read these numbers.
    Slices overlap by the words among which a leak of the longest item is looked for.
    """
    overlap = 2 * longest + 2 * PASSAGE
    shared = src.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        t = shared.value
        kinds = [pa.int64(), None, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            kinds[1] = batch.column(1).type
            rows: list[list] = [[], [], [], [], []]
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (row, key), text in zip(ids, batch.column(2), strict=True):
                ws = words_of(text.as_py())
                for part, k in enumerate(range(0, max(1, len(ws)), SLICE)):
                    for column, x in zip(rows, (row, key, part, *t.find(ws[k : k + SLICE + overlap])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["row", "id", "part", "at", "term"])

    kind = dict(src.dtypes)["id"]
    marked = src.select(F.monotonically_increasing_id().alias("row"), "id", "t")
    return materialize(map_arrow(marked, run, f"row long, id {kind}, part int, at array<int>, term array<int>"), "terms")


def _arrays(column) -> list[np.ndarray]:
    """The rows of a list column as arrays, without copies."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def document_frequency(places: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Of each term, and the number of documents (slices of a very long one count each); a task sends a row for each term it met."""
    m = len(terms.at)

    def run(batches):
        df, n = np.zeros(m, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for ids in _arrays(batch.column(0)):
                df[np.unique(ids)] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*met.tolist(), -1], pa.int32()), pa.array([*df[met].tolist(), n], pa.int64())], ["term", "n"])

    out = np.zeros(m, np.int64)
    total = 0
    for term, n in map_arrow(places.select("term"), run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            total = n
        else:
            out[term] = n
    return out, total


def _weighted(idf: np.ndarray, ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF matrix of some passages, each of length 1, as (passage, term, weight) in order; part: passages from 0 on."""
    pair, count = np.unique(part * len(idf) + ids, return_counts=True)
    part, ids = np.divmod(pair, len(idf))
    w = idf[ids] * count.astype(np.float32)
    norm = np.sqrt(np.bincount(part, w * w))
    return part, ids, (w / np.maximum(norm[part], 1e-9)).astype(np.float32)


def latent_space(places: DataFrame, terms: Terms, items: list[list[int]], seed: int = 11) -> np.ndarray:
    """Terms by ranks: the leading right singular vectors of the passages' TF-IDF matrix."""
    width = RANK + EXTRA
    random = np.random.default_rng(seed).standard_normal((len(terms.at), width)).astype(np.float32)
    shared = places.sparkSession.sparkContext.broadcast((terms.idf, random))

    def sketch(idf: np.ndarray, r: np.ndarray, y: np.ndarray, ids: np.ndarray, part: np.ndarray) -> None:
        if not len(ids):
            return
        cut = np.r_[True, np.diff(part) != 0]
        part, ids, w = _weighted(idf, ids, np.cumsum(cut) - 1)
        x = r[ids]
        x *= w[:, None]
        z = np.add.reduceat(x, np.flatnonzero(np.r_[True, np.diff(part) != 0]), axis=0)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        np.take(z, part[order], axis=0, out=x)
        x *= w[order][:, None]
        cut = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
        y[ids[cut]] += np.add.reduceat(x, cut, axis=0)

    def run(batches):
        idf, r = shared.value
        y = np.zeros((len(idf), width), np.float32)
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            passages = size = 0
            for at, ids in zip(_arrays(batch.column(0)), _arrays(batch.column(1)), strict=True):
                use = idf[ids] > 0
                held.append((ids[use], at[use] // PASSAGE + passages))
                passages += (int(at[-1]) if len(at) else 0) // PASSAGE + 1
                size += len(held[-1][0])
                if size > 10_000:
                    sketch(idf, r, y, *map(np.concatenate, zip(*held, strict=True)))
                    held, passages, size = [], 0, 0
            if held:
                sketch(idf, r, y, *map(np.concatenate, zip(*held, strict=True)))
        met = np.flatnonzero(y.any(axis=1))
        for part in np.array_split(met, len(met) // 2000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([x.tobytes() for x in y[part]], pa.binary())], ["term", "y"])

    def add(batches):
        y: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32)
                y[term] = y[term] + x if term in y else x
        yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in y.values()], pa.binary())], ["term", "y"])

    kind = "term int, y binary"
    y = np.zeros((len(terms.at), width), np.float32)
    for term, x in map_arrow(map_arrow(places.select("at", "term"), run, kind).repartition("term"), add, kind).collect():
        y[term] = np.frombuffer(x, np.float32)
    for k, item in enumerate(items):
        ids = np.array(item, np.int32)
        use = terms.idf[ids] > 0
        sketch(terms.idf, random, y, ids[use], np.flatnonzero(use) // PASSAGE + k)
    # From the sketch Y = A'A R to the singular vectors of A (Nystroem, with a shift for stability).
    shift = 1e-6 * max(1e-12, float(np.linalg.norm(y)))
    y = y.astype(np.float64) + shift * random
    core = random.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(initial=0) * 1e-10, 1e-12)
    half = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :RANK].astype(np.float32)


class Index:
    """The items by their rarer words, by which passages are passed over, and by their latent vectors."""

    def __init__(self, terms: Terms, of: np.ndarray, space: np.ndarray, texts: list[list[int]]):
        """of: the document frequency of each term."""
        self.idf, self.texts = terms.idf, texts
        self.weighted = (space * terms.idf[:, None]).astype(np.float32)
        size = np.array([len(x) for x in texts])
        self.length = np.array([max([n for n in SLIDING if n <= len(x)], default=SLIDING[0]) for x in texts])
        #: Words before and after a passage in which the item is looked for.
        self.pad = np.maximum(self.length // 2, size - self.length // 2)
        rare = [{w for w in x if terms.idf[w] > 0} for x in texts]
        # A passage that holds half of an item has at least so many of its terms that have weight.
        self.rare = np.array([max(1, min(4, len(r) // 4)) for r in rare])
        self.poor = np.array([sum(w in r for w in x) < WEIGHTED * len(x) for x, r in zip(texts, rare, strict=True)])
        # Pieces of an item: the passages of a long one, else all of it.
        cuts = [range(0, len(x), PASSAGE) if len(x) >= 2 * PASSAGE else [0] for x in texts]
        pieces = [self.weighted[x[k : k + PASSAGE] if len(x) >= 2 * PASSAGE else x].sum(axis=0) for x, ks in zip(texts, cuts, strict=True) for k in ks]
        self.pieces = np.stack(pieces)
        self.pieces /= np.maximum(np.linalg.norm(self.pieces, axis=1, keepdims=True), 1e-9)
        self.first = np.cumsum([0, *map(len, cuts)])
        # A leak lacks at most some words of the item, so it has at least so many of the rarer ones.
        self.need, posts = np.zeros(len(texts), np.int64), []
        for q, x in enumerate(texts):
            words, counts = np.unique(x, return_counts=True)
            order = np.argsort(of[words], kind="stable")
            lacks = len(x) - int(np.ceil(PARTIAL * len(x)))
            sums = np.cumsum(counts[order])
            k = min(len(order) - 1, int(np.searchsorted(sums, lacks + max(1, round(RARER * len(x))))))
            self.need[q] = sums[k] - lacks
            posts.append(words[order[: k + 1]])
        self.chunks = []
        for k in range(0, len(texts), TOGETHER):
            part = posts[k : k + TOGETHER]
            word, item = np.concatenate(part), np.repeat(np.arange(len(part)), [len(p) for p in part])
            order = np.argsort(word, kind="stable")
            self.chunks.append((k, len(part), np.searchsorted(word[order], np.arange(len(of) + 1)), item[order]))
        #: Words by which documents on one line are kept apart; as each begins with a block, its neighbours make no difference.
        self.gap = (int((self.length + self.pad).max()) // STEP + 2) * STEP

    def _enough(self, at: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(items, first words of passages): the passages around which there are enough of the item's rarer words."""
        found, blocks = [], int(at[-1]) // STEP + 1
        block = at // STEP
        for base, n, ptr, item in self.chunks:
            degree = ptr[ids + 1] - ptr[ids]
            ends = np.cumsum(degree)
            if not ends[-1]:
                continue
            q = item[np.repeat(ptr[ids] - ends + degree, degree) + np.arange(ends[-1])]
            width = -(-(self.length[base : base + n] + 2 * self.pad[base : base + n]) // STEP) + 1
            most = int(width.max())
            sums = np.zeros((n, blocks + 2 * most), np.int32)
            sums[:, most + 1 : most + 1 + blocks] = np.bincount(q * blocks + np.repeat(block, degree), minlength=n * blocks).reshape(n, blocks)
            np.cumsum(sums, axis=1, out=sums)
            # sums[:, k] has the places of the blocks before k - most.
            for w in np.unique(width):
                group = np.flatnonzero(width == w)
                held = sums[group, w:] - sums[group, :-w] >= self.need[base + group, None]
                g, j = np.nonzero(held)
                found.append((base + group[g], j - most))
        return found

    def candidates(self, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, first words of passages) where enough rarer words are around and the cosine is high enough."""
        found = self._enough(at, ids)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, j = (np.concatenate(x) for x in zip(*found, strict=True))
        step, low = self.length[q] // 4, j * STEP + self.pad[q]
        begin = -(-low // step) * step
        each = np.maximum(0, -(-(low + STEP - begin) // step))
        ends = np.cumsum(each)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, begin = np.repeat(q, each), np.repeat(begin, each) + (np.arange(ends[-1]) - np.repeat(ends - each, each)) * np.repeat(step, each)
        poor = self.poor[q]
        near = self._near(at, ids, q[~poor], begin[~poor])
        return np.concatenate([q[poor], q[~poor][near]]), np.concatenate([begin[poor], begin[~poor][near]])

    def sharing(self, ids: np.ndarray, qs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of some regions (places lo to hi) share enough words with their items, each as often as both have it."""
        order = np.argsort(ids, kind="stable")
        spot = np.empty(len(ids), np.int64)
        spot[order] = np.arange(len(ids))
        held, enough = np.zeros(len(self.idf), np.int32), np.zeros(len(qs), bool)
        by = np.argsort(qs, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(qs[by])) + 1) if len(by) else ():
            text = self.texts[qs[part[0]]]
            words, counts = np.unique(text, return_counts=True)
            held[words] = counts
            size = hi[part] - lo[part]
            region = np.repeat(np.arange(len(part)), size)
            at = np.repeat(lo[part] - np.cumsum(size) + size, size) + np.arange(len(region))
            times = held[ids[at]]
            use = times > 0
            region, at, times = region[use], at[use], times[use]
            # An occurrence counts unless as many before it, as the item has, are in the region.
            back = spot[at] - times
            before = order[np.maximum(back, 0)]
            first = (back < 0) | (ids[before] != ids[at]) | (before < lo[part][region])
            enough[part] = np.bincount(region[first], minlength=len(part)) >= PARTIAL * len(text)
            held[words] = 0
        return enough

    def _near(self, at: np.ndarray, ids: np.ndarray, q: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which of some passages have an item's terms and a cosine with it, or a piece of it, that is high enough."""
        use = self.idf[ids] > 0
        at, ids = at[use], ids[use]
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, begin + self.length[q])
        left = np.flatnonzero(hi - lo >= self.rare[q])
        keep = []
        for k in range(0, len(left), 4096):
            part = left[k : k + 4096]
            # Passages of several items are summed once.
            spans, of = np.unique(np.stack([lo[part], hi[part]], 1), axis=0, return_inverse=True)
            size = spans[:, 1] - spans[:, 0]
            starts = np.cumsum(size) - size
            x = np.add.reduceat(self.weighted[ids[np.repeat(spans[:, 0] - starts, size) + np.arange(size.sum())]], starts, axis=0)
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            first, pieces = self.first[q[part]], self.first[q[part] + 1] - self.first[q[part]]
            starts = np.cumsum(pieces) - pieces
            piece = np.repeat(first - starts, pieces) + np.arange(pieces.sum())
            cosine = np.einsum("ij,ij->i", x[np.repeat(of.ravel(), pieces)], self.pieces[piece])
            keep.append(part[np.maximum.reduceat(cosine, starts) >= COSINE])
        return np.concatenate(keep) if keep else left


def _search(places: DataFrame, index: Index, numbers: list[int | None]) -> DataFrame:
    """row, id and found (item, share) of every document or slice."""
    kind = dict(places.dtypes)["id"]
    shared = places.sparkSession.sparkContext.broadcast((index, numbers))

    def run(batches):
        index, numbers = shared.value
        texts = index.texts
        for batch in batches:
            places, terms = _arrays(batch.column(2)), _arrays(batch.column(3))
            best: list[dict[int, float]] = [{} for _ in places]
            k = 0
            while k < len(places):
                # Documents stand one after another on one line of places, so far apart that no passage spans two.
                bases, line, end, size = [], [], index.gap, 0
                first = k
                while k < len(places) and size < 50_000:
                    bases.append(end)
                    line.append(places[k].astype(np.int64) + end)
                    end += ((int(places[k][-1]) if len(places[k]) else 0) // STEP + 1) * STEP + 2 * index.gap
                    size += len(places[k])
                    k += 1
                at, ids = np.concatenate(line), np.concatenate(terms[first:k])
                if not len(at):
                    continue
                qs, begin = index.candidates(at, ids)
                pad, length = index.pad[qs], index.length[qs]
                lo, hi = np.searchsorted(at, begin - pad), np.searchsorted(at, begin + length + pad)
                some = index.sharing(ids, qs, lo, hi)
                # A passage's document is that of its last place.
                doc = np.searchsorted(np.array(bases), at[np.maximum(hi, 1) - 1], side="right") - 1
                for q, d, a, b in zip(*(x[some].tolist() for x in (qs, doc, lo, hi)), strict=True):
                    known = best[first + d]
                    if known.get(q, 0) < 1:
                        share = matches(texts[q], ids[a:b].tolist())
                        if share > known.get(q, 0):
                            known[q] = share
            out = [[{"item": numbers[q], "share": s} for q, s in sorted(x.items())] for x in best]
            found = pa.array(out, pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["row", "id", "found"])

    return map_arrow(places.select("row", "id", "at", "term"), run, f"row long, id {kind}, found array<struct<item:bigint,share:double>>")


def leaks(src: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id and found (item, share) of every row of src, which has id and t."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item"), text_of(benchmark).alias("t"))
    items, size = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks, out = max(-(-items // ITEMS), -(-size // ITEM_BYTES)), None
    for k in range(blocks):
        # The stated query set against all documents, a block of items at a time.
        rows = bench.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).distinct().orderBy("item", "t").collect()
        words = [(r["item"], ws) for r in rows if (ws := words_of(r["t"]))]
        if not words:
            continue
        terms = Terms(sorted({w for _, ws in words for w in ws}))
        texts = [[terms.at[w] for w in ws] for _, ws in words]
        places = term_places(src, terms, max(map(len, texts)))
        of, n = document_frequency(places, terms)
        idf = np.log((1 + n) / (1 + of)) + 0.1
        idf[of > max(COMMON * n, FEW)] = 0
        terms.idf = idf.astype(np.float32)
        found = _search(places, Index(terms, of, latent_space(places, terms, texts), texts), [i for i, _ in words])
        out = found if out is None else out.union(found)
    if out is None:
        none = F.expr("cast(array() as array<struct<item:bigint,share:double>>)")
        out = src.select(F.monotonically_increasing_id().alias("row"), "id", none.alias("found"))
    # Slices of a document, and blocks of items, come together by the number of the row.
    return out.groupBy("row", "id").agg(F.flatten(F.collect_list("found")).alias("found")).drop("row")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``items`` (the benchmark items found, ascending), ``share`` (the largest) and ``contaminated`` of every document."""
    out = leaks(df.select(F.col(id_col).alias("id"), text_of(df, text_col).alias("t")), benchmark)
    return out.select(
        F.col("id").alias(id_col),
        F.expr("array_sort(array_distinct(transform(found, x -> x.item)))").alias("items"),
        F.expr("coalesce(array_max(transform(found, x -> x.share)), 0.0D)").alias("share"),
        (F.size("found") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, each judged by its text, whatever its id."""
    before, text = tables(), text_of(df, text_col)
    found = leaks(df.select(F.md5(text).alias("id"), text.alias("t")), benchmark)
    bad = materialize(found.filter(F.size("found") > 0).select(F.col("id").alias("_md5")).distinct(), "leaked")
    release(keep=before | {bad._table})
    bad = small(bad)
    return df.join(bad, F.md5(text) == bad["_md5"], "left_anti").select(df.columns)
