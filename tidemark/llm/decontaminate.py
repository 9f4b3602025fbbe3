"""Benchmark decontamination by latent semantic retrieval.

Texts are sequences of lower-cased words, known by 32-bit hashes; words fall into `dims` hashed terms. Passages of 64 words make a TF-IDF matrix (inverse
document frequencies from all passages). Its right singular vectors come from a distributed randomised SVD: with a
random matrix O, tasks add up Y = X'X O, and the driver finishes the small problem (Nystroem form: one pass). A text's
latent vector is its TF-IDF vector times the singular vectors, each divided by the square root of its singular value.

Search. An item is compared with all windows of about its own length (window classes 16 to 128 words; a window starts every
quarter of it, but not more often than every 8 words): cosine of latent vectors of `least_cosine` or more makes a candidate.
So do a fixed number of an item's rarest words in a stretch of two and a half windows, that starts at any half window: a text with
`least_lcs` of an item in order cannot have fewer of them, so what the cosine misses is found. A candidate's region, the window and half
of it on both sides, must hold enough of the item's words (an upper bound of the next step), then enough of the item in order
(longest common subsequence, bit-parallel), and the item's answer: its `answer` column if it has one, else the last fifth
of its words, must be there in order too, unless nearly the whole item is. So paraphrases that keep most words in order count,
texts that only share subject matter do not.

Fit and index. Document frequencies, basis, windows, candidates and checks cover all texts: every passage enters the sketch, by sums over
its words rather than as a dense row. A caller can bound the passages of the basis by `fit_passages` (by position, spread over all groups); nothing here does.
Recall of the cosine search against brute force is measured in the tests.

Scale. Texts are split once and written as packed word numbers; the later passes read these, without any shuffle. What
is sent to executors is the basis (dims x rank floats) and at most `max_items` items with their vectors; a larger benchmark is searched in parts,
one pass over the packed words for each. Memory: one group of documents and a chunk of windows.

Defined results. Null and empty texts hold nothing; null and empty items are in nothing. Items of fewer than `min_tokens` words are matched exactly: all words in order and next to each other, with the whole
answer, if there is an answer column, shortly behind or before. Items of more than 128 words are searched in parts of 128, each of which counts as the item. Repeated
rows each get their result, judged by their own text; a text of any length is searched whole. Other columns, whatever their names, are not read; `drop_contaminated` returns them. Empty benchmark: nothing is contaminated. Empty table: empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, quoted
from .packing import LETTERS, WordHasher, arrow_type, as_hashes, lower_bytes, pack_documents, ranges, squeeze, unsqueeze

BLOCK, PASSAGE = 8, 64
#: Words of the window classes.
CLASSES = (16, 24, 32, 48, 64, 96, 128)
CHUNK = 1 << 12  # blocks whose vectors are added up at once
#: Blocks whose window sums are made at once, and cosines at once.
STRETCH, COSINES = 1 << 10, 1 << 22
#: Passages sketched at once, and words of a term in them from which a matrix product is cheaper.
SKETCHED, COMMON = 1 << 11, 64

@dataclass
class Item:
    """A benchmark item, or a part of a long one."""

    place: int
    words: np.ndarray  # 32-bit hash of each word
    answer: np.ndarray

    @property
    def window(self) -> int:
        return next(c for c in CLASSES if c >= len(self.words))


def item_parts(items: list[tuple[str | None, str | None]], min_tokens: int) -> tuple[list[Item], list[Item]]:
    """(text, answer or None) of each item: those to search, in parts of up to 128 words, and those of fewer than `min_tokens` words, to be matched exactly.

    The last part of a long item reaches back to the full length, so that no tail is left over."""
    hasher, out, short = WordHasher(LETTERS), [], []
    hashed = lambda text: hasher([lower_bytes(text)])[1].astype(np.uint32)
    longest = CLASSES[-1]
    for k, (text, answer) in enumerate(items):
        words = hashed(text)
        told = hashed(answer) if answer else np.empty(0, np.uint32)
        if 0 < len(words) < min_tokens:
            short.append(Item(k, words, told))
        for at in sorted({min(at, max(0, len(words) - longest)) for at in range(0, len(words), longest)}) if len(words) >= min_tokens else ():
            part = words[at : at + longest]
            out.append(Item(k, part, told if len(told) and len(words) <= longest else part[-max(3, len(part) // 5) :]))
    return out, short


class ShortItems:
    """Items of a few words: all of them, in order and next to each other, and then the answer, if there is one, in the words after or before."""

    def __init__(self, items: list[Item]) -> None:
        self.by_length: dict[int, tuple[np.ndarray, list[list[Item]]]] = {}
        for n in {len(i.words) for i in items}:
            mine: dict[int, list[Item]] = {}
            for i in items:
                if len(i.words) == n:
                    mine.setdefault(int(self._keys(i.words, n)[0]), []).append(i)
            keys = sorted(mine)
            self.by_length[n] = np.array(keys, np.uint64), [mine[k] for k in keys]

    @staticmethod
    def _keys(tokens: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words."""
        out = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
        for k in range(n):
            out = (out ^ tokens[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def enter(self, group: Packed, found: dict[int, dict[int, float]]) -> None:
        for n, (keys, items) in self.by_length.items():
            runs = self._keys(group.tokens, n)
            place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            for at in np.nonzero(keys[place] == runs)[0].tolist():
                d = int(np.searchsorted(group.end, at, side="right"))
                if at + n > group.end[d]:
                    continue
                for item in items[place[at]]:
                    reach = 4 * len(item.answer) + BLOCK
                    sides = group.tokens[at + n : min(at + n + reach, group.end[d])], group.tokens[max(group.start[d], at - reach) : at]
                    masks = masks_of(item.answer.tolist())
                    if np.array_equal(group.tokens[at : at + n], item.words) and any(lcs_length(masks, len(item.answer), side.tolist()) == len(item.answer) for side in sides):
                        found.setdefault(d, {})[item.place] = 1.0


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence of a pattern of n words, given as bit masks by word, and a word list."""
    row, full = (1 << n) - 1, (1 << n) - 1
    for w in words:
        if (m := masks.get(w)) is not None:
            low = row & m
            row = ((row + low) | (row - low)) & full
    return n - row.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


class RareWords:
    """Finds the stretches that can hold `least_lcs` of an item: all of them.

    A text that has m of an item's n words in order has c of any n - m + c of them; the rarest are looked for."""

    def __init__(self, items: list[Item], frequency: np.ndarray, least_lcs: float) -> None:
        words, owner, self.least = [], [], np.zeros(len(items), np.int64)
        for k, item in enumerate(items):
            n = len(item.words)
            need = math.ceil(least_lcs * n - 1e-9)
            self.least[k] = max(1, min(need, n // 5))
            rarest = np.argsort(frequency[item.words & np.uint32(len(frequency) - 1)], kind="stable")[: n - need + self.least[k]]
            words.append(np.unique(item.words[rarest]))
            owner.append(np.full(len(words[-1]), k))
        every, owner = np.concatenate([np.empty(0, np.uint32), *words]), np.concatenate([np.empty(0, np.int64), *owner]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        self.words, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.some = np.zeros(1 << 18, bool)  # by the low bits of words
        self.some[self.words & np.uint32(len(self.some) - 1)] = True
        self.owner, self.half = owner[order], np.array([i.window // 2 for i in items], np.int64)

    def stretches(self, group: Packed, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, documents, first words, last words)."""
        if not len(self.words) or not len(group.tokens):
            return
        at = np.nonzero(self.some[group.tokens & np.uint32(len(self.some) - 1)])[0]
        place = np.minimum(np.searchsorted(self.words, group.tokens[at]), len(self.words) - 1)
        same = self.words[place] == group.tokens[at]
        at, place = at[same], place[same]
        doc = np.searchsorted(group.end, at, side="right")
        buckets = int((group.end - group.start).max()) // int(self.half.min()) + 8  # with room behind the last
        made = np.cumsum(self.count[place])
        low = 0
        while low < len(at):  # whole documents with about so many pairs
            high = int(np.searchsorted(made, (made[low - 1] if low else 0) + most, side="right"))
            high = max(int(np.searchsorted(doc, doc[min(high, len(at) - 1)])) if high < len(at) else high, int(np.searchsorted(doc, doc[low], side="right")))
            times = self.count[place[low:high]]
            item = self.owner[ranges(self.first[place[low:high]], times)]
            d = np.repeat(doc[low:high], times)
            key = np.sort((item * len(group.ids) + d) * buckets + (np.repeat(at[low:high], times) - group.start[d]) // self.half[item])
            total = np.append(np.nonzero(np.diff(key, prepend=-1))[0], len(key))
            key = key[total[:-1]]
            starts = np.sort(np.concatenate([np.maximum(key - k, key - key % buckets) for k in range(5)]))  # of all stretches with any
            starts = starts[np.diff(starts, prepend=-1) > 0]
            item = starts // buckets // len(group.ids)
            keep = total[np.searchsorted(key, starts + 5)] - total[np.searchsorted(key, starts)] >= self.least[item]
            key, item = starts[keep], item[keep]
            d, begin = key // buckets % len(group.ids), key % buckets * self.half[item]
            for k, part in zip(*_runs(item, np.arange(len(item))), strict=True):
                begins = group.start[d[part]] + begin[part]
                yield int(k), d[part], begins, np.minimum(begins + 5 * self.half[k], group.end[d[part]])
            low = high


class Packed:
    """A group of packed documents with block boundaries. Blocks of 8 words do not cross documents."""

    def __init__(self, row: dict, dims: int) -> None:
        self.ids = row["ids"]
        self.tokens = unsqueeze(row["tokens"], np.uint32)
        self.dims = (self.tokens & np.uint32(dims - 1)).astype(np.int32)
        lengths = unsqueeze(row["lengths"], np.int32).astype(np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.end = self.start + lengths
        per_doc = -(-lengths // BLOCK)
        self.first_block = np.cumsum(per_doc) - per_doc
        self.n_blocks = int(per_doc.sum())
        self.block_doc = np.repeat(np.arange(len(lengths)), per_doc)
        self.block_start = self.start[self.block_doc] + (np.arange(self.n_blocks) - self.first_block[self.block_doc]) * BLOCK

    def block_sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of table rows over the words of each block."""
        padded = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])  # the last row stands for no word
        out = np.zeros((self.n_blocks, table.shape[1]), np.float32)
        for at in range(0, self.n_blocks, CHUNK):
            words = self.block_start[at : at + CHUNK, None] + np.arange(BLOCK)
            ends = self.end[self.block_doc[at : at + CHUNK], None]
            terms = np.where(words < ends, self.dims[np.minimum(words, len(self.dims) - 1)], len(table))
            part = out[at : at + CHUNK]
            for k in range(BLOCK):
                part += padded[terms[:, k]]
        return out

    def passages(self) -> np.ndarray:
        """First block of each passage of 64 words."""
        return np.nonzero((np.arange(self.n_blocks) - self.first_block[self.block_doc]) % (PASSAGE // BLOCK) == 0)[0]


def _frequencies(packed: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """(passages with each term, passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                group = Packed(row, dims)
                if group.n_blocks:
                    first = group.block_start[group.passages()]
                    passage = np.repeat(np.arange(len(first), dtype=np.int64), np.diff(np.append(first, len(group.tokens))))
                    pairs = passage * dims + group.dims
                    pairs = pairs.astype(np.int32) if len(first) * dims < 1 << 31 else pairs  # sorts faster
                    pairs.sort()
                    counts[:dims] += np.bincount(pairs[np.nonzero(np.diff(pairs, prepend=-1))[0]] % dims, minlength=dims)
                    counts[dims] += len(first)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["term", "n"])

    rows = packed.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most dims + 1 rows
    counts = np.zeros(dims + 1, np.int64)
    counts[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return counts[:dims], int(counts[dims])


def _add_products(total: np.ndarray, terms: np.ndarray, weighted: np.ndarray, idf: np.ndarray) -> None:
    """total += X'X O without the outer weights, for passages given as rows of terms; len(idf) stands for no word."""
    n = len(terms)
    passage, place = np.nonzero(terms < len(idf))
    key = np.sort(terms[passage, place] * n + passage)  # words by term
    at = np.nonzero(np.diff(key, prepend=-1))[0]
    times = np.diff(np.append(at, len(key)))
    term, holder = key[at] // n, key[at] % n
    square = np.bincount(holder, (times * idf[term]) ** 2, minlength=n)
    vectors = np.zeros((n, weighted.shape[1]), np.float32)
    for k in range(terms.shape[1]):
        vectors += weighted.take(terms[:, k], axis=0, mode="clip")
    vectors /= np.maximum(square, 1e-9)[:, None].astype(np.float32)
    count = np.bincount(term, times, minlength=len(total)).astype(np.int64)
    common = np.nonzero(count > COMMON)[0]  # by a matrix product
    column = np.full(len(total), -1)
    column[common] = np.arange(len(common))
    column = column[term]
    dense = column >= 0
    matrix = np.zeros((n, len(common)), np.float32)
    matrix[holder[dense], column[dense]] = times[dense]
    total[common] += matrix.T @ vectors
    rest = np.nonzero((count > 0) & (count <= COMMON))[0]  # a word of each at a time
    rest = rest[np.argsort(-count[rest], kind="stable")]
    first, count = (np.cumsum(count) - count)[rest], count[rest]
    sums = np.zeros((len(rest), vectors.shape[1]), np.float32)
    for k in range(int(count.max(initial=0))):
        more = int(np.searchsorted(-count, -k))  # so many have more than k
        sums[:more] += vectors.take(key[first[:more] + k] % n, axis=0, mode="clip")
    total[rest] += sums


def _sketch(packed: DataFrame, idf: np.ndarray, omega: np.ndarray, every: int) -> np.ndarray:
    """Y = X'X O over each `every`-th passage, rows of X of length 1."""
    dims, width = omega.shape
    weighted = np.vstack([omega * idf[:, None], np.zeros((1, width))]).astype(np.float32)  # the last row stands for no word
    rows_a_piece = 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, width))
        for batch in batches:
            for row in batch.to_pylist():
                group = Packed(row, dims)
                first = group.passages()[xxhash.xxh64_intdigest(row["group"]) % every :: every]  # spread over groups
                for at in range(0, len(first), SKETCHED):
                    part = first[at : at + SKETCHED]
                    low = group.block_start[part]
                    high = np.minimum(group.end[group.block_doc[part]], low + PASSAGE)
                    words = low[:, None] + np.arange((high - low).max())
                    terms = np.where(words < high[:, None], group.dims[np.minimum(words, len(group.dims) - 1)], dims)
                    _add_products(total, terms, weighted, idf)
        if total.any():
            pieces = total.astype(np.float32).reshape(-1, rows_a_piece * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces)), pa.int64()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "y"])

    def add(pieces: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in pieces.column("y"))
        return pa.table({"piece": pieces.column("piece").slice(0, 1), "y": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    found = packed.mapInArrow(run, "piece long, y binary").groupBy("piece").applyInArrow(add, "piece long, y binary").toArrow()  # dims x width floats
    y = np.zeros((dims // rows_a_piece, rows_a_piece * width), np.float32)
    for piece, blob in zip(found.column("piece").to_pylist(), found.column("y").to_pylist(), strict=True):
        y[piece] = np.frombuffer(blob, np.float32)
    return y.reshape(dims, width).astype(np.float64) * idf[:, None]


def latent_basis(packed: DataFrame, rank: int, dims: int, fit_passages: int | None = None, seed: int = 5, frequencies: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """dims x rank: inverse document frequency times singular vector over the root of the singular value. Fitted on all passages, or on about `fit_passages`."""
    frequency, passages = frequencies or _frequencies(packed, dims)
    idf = np.log((1 + passages) / (1 + frequency)) + 1e-3
    omega = np.random.default_rng(seed).standard_normal((dims, rank + 16))
    y = _sketch(packed, idf, omega, max(1, -(-passages // fit_passages)) if fit_passages else 1)
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, max(1e-6 * value.max(), 1e-12))
    u, s, _ = np.linalg.svd(y @ (vector / np.sqrt(value)), full_matrices=False)
    s = np.maximum(s[:rank], max(1e-4 * s[0], 1e-12))  # roots of the eigenvalues of X'X: the singular values
    return (u[:, :rank] / np.sqrt(s) * idf[:, None]).astype(np.float32)


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def latent_items(items: list[Item], basis: np.ndarray) -> np.ndarray:
    return unit(np.stack([basis[i.words & np.uint32(len(basis) - 1)].sum(0) for i in items])).astype(np.float32)


def candidates(group: Packed, blocks: np.ndarray, items: list[Item], vectors: np.ndarray, least_cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, first words, last words) of the windows near each item. blocks: running sums of block vectors."""
    yield from near_windows(group, np.diff(blocks, axis=0).astype(np.float32), items, vectors, least_cosine)


def near_windows(group: Packed, blocks: np.ndarray, items: list[Item], vectors: np.ndarray, least_cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As candidates, from the block vectors themselves. Sums of so many blocks are made of smaller ones, for STRETCH rows at a time, which stay in the cache."""
    place = np.arange(group.n_blocks) - group.first_block[group.block_doc]
    doc_end = np.append(group.first_block[1:], group.n_blocks)[group.block_doc]
    classes = []
    for size in sorted({i.window for i in items}):
        m, step = size // BLOCK, max(1, size // 4 // BLOCK)
        mine = [k for k, i in enumerate(items) if i.window == size]
        first = np.nonzero((place % step == 0) & ((place == 0) | (place - step + m < doc_end - group.first_block[group.block_doc])))[0]
        classes.append((size, mine, vectors[mine].T.copy(), first, []))
    room = classes[-1][0] // BLOCK
    row = np.arange(group.n_blocks) + room * np.cumsum(place == 0)  # empty rows between documents, so that no sum goes beyond one
    widths = {1}
    for size, *_ in classes:  # a width is the largest power of two below it and a rest, which is one here, too
        m = size // BLOCK
        while m > 1:
            widths |= {m, *(1 << k for k in range((m - 1).bit_length()))}
            m -= 1 << (m - 1).bit_length() - 1
    widths = sorted(widths)
    sums = {m: np.zeros((STRETCH + room, blocks.shape[1]), np.float32) for m in widths}
    for low in range(0, int(row[-1]) + 1, STRETCH):
        b0, b1 = np.searchsorted(row, [low, low + STRETCH + room])
        sums[1][:] = 0
        sums[1][row[b0:b1] - low] = blocks[b0:b1]
        for m in widths[1:]:
            part = 1 << (m - 1).bit_length() - 1
            np.add(sums[part][:-part], sums[m - part][part:], out=sums[m][:-part])
        b1 = np.searchsorted(row, low + STRETCH)
        for size, mine, own, first, hits in classes:
            f = first[slice(*np.searchsorted(first, [b0, b1]))]
            vector = sums[size // BLOCK][row[f] - low]
            least = least_cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", vector, vector)), 1e-12)
            for at in range(0, len(mine), COSINES // STRETCH):
                w, k = np.divmod(np.flatnonzero(vector @ own[:, at : at + COSINES // STRETCH] >= least[:, None]), min(COSINES // STRETCH, len(mine) - at))
                hits.append((f[w], k + at))
    for size, mine, _, _, hits in classes:
        w, k = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(k, kind="stable")
        for j, part in zip(*_runs(k[order], w[order]), strict=True):
            begin = group.block_start[part]
            yield mine[j], begin, np.minimum(begin + size, group.end[group.block_doc[part]])


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cut = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[cut], np.split(values, cut[1:]) if len(cut) else []


def find_items(group: Packed, items: list[Item], short: ShortItems, vectors: np.ndarray, basis: np.ndarray, rare: RareWords, least_cosine: float, least_lcs: float) -> dict[int, dict[int, float]]:
    """For each document of the group with any: the items in it and the share of each that is there in order."""
    found: dict[int, dict[int, float]] = {}
    short.enter(group, found)
    if not group.n_blocks or not items:
        return found
    for k, begin, end in near_windows(group, group.block_sums(basis), items, vectors, least_cosine):
        doc = np.searchsorted(group.end, begin, side="right")
        half = items[k].window // 2
        near = np.nonzero(np.diff(doc * (1 << 32) + (begin - group.start[doc]) // half, prepend=-1))[0]  # windows that begin in the same half
        doc, low, high = doc[near], np.maximum(begin[near] - half, group.start[doc[near]]), np.maximum.reduceat(end, near)
        _check(group, items[k], doc, low, np.minimum(high + half, group.end[doc]), len(basis), least_lcs, found)
    for k, doc, low, high in rare.stretches(group):
        _check(group, items[k], doc, low, high, len(basis), least_lcs, found)
    return found


def _check(group: Packed, item: Item, doc: np.ndarray, low: np.ndarray, high: np.ndarray, dims: int, least_lcs: float, found: dict[int, dict[int, float]]) -> None:
    """Enter into `found` the documents of which a region holds the item."""
    n = len(item.words)
    mark = np.zeros(dims, np.uint8)
    mark[item.words & np.uint32(dims - 1)] = 1
    width = int((high - low).max())
    hits = np.empty(len(low), np.int64)
    for at in range(0, len(low), CHUNK):
        words = low[at : at + CHUNK, None] + np.arange(width)
        inside = words < high[at : at + CHUNK, None]
        hits[at : at + CHUNK] = (mark[group.dims[np.minimum(words, len(group.dims) - 1)]] & inside).sum(1)
    masks = answer = None
    for c in np.nonzero(hits >= least_lcs * n)[0]:
        d = int(doc[c])
        if found.get(d, {}).get(item.place, 0.0) * n >= min(int(hits[c]), n):  # no larger share can be here
            continue
        region = group.tokens[low[c] : high[c]].tolist()
        if masks is None:
            masks, told = masks_of(item.words.tolist()), item.answer.tolist()
            answer = masks_of(told)
        share = lcs_length(masks, n, region) / n
        if share >= 0.9 or share >= least_lcs and lcs_length(answer, len(told), region) >= 0.6 * len(told):
            mine = found.setdefault(d, {})
            mine[item.place] = max(mine.get(item.place, 0.0), share)


@dataclass
class Search:
    """The items of a benchmark, or of a part of it, ready to be looked for. Bounded by `max_items`."""

    names: list
    items: list[Item]
    short: ShortItems
    vectors: np.ndarray
    rare: RareWords

    def found(self, group: Packed, basis: np.ndarray, least_cosine: float, least_lcs: float) -> dict[int, dict[int, float]]:
        return find_items(group, self.items, self.short, self.vectors, basis, self.rare, least_cosine, least_lcs)


def _searches(
    packed: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, answer_col: str | None, rank: int, dims: int, fit_passages: int | None, least_lcs: float, min_tokens: int, max_items: int
) -> tuple[list[Search], np.ndarray]:
    """The benchmark in parts of about `max_items` items, by the hash of their texts, and the latent basis that all share."""
    rows = benchmark.select(quoted(item_col), quoted(item_text_col).cast("string"), quoted(answer_col).cast("string") if answer_col else F.lit(None).cast("string"))
    rows = rows.toDF("item", "text", "answer")
    n_parts = max(1, -(-rows.count() // max_items))
    frequencies = basis = None
    out = []
    for part in range(n_parts):
        mine = rows.where(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).orderBy("item", "text").collect()  # about max_items rows
        items, short = item_parts([(r["text"], r["answer"]) for r in mine], min_tokens)
        if items and basis is None:
            frequencies = _frequencies(packed, dims)
            basis = latent_basis(packed, rank, dims, fit_passages, frequencies=frequencies)
        vectors = latent_items(items, basis) if items else np.zeros((0, rank), np.float32)
        out.append(Search([r["item"] for r in mine], items, ShortItems(short), vectors, RareWords(items, frequencies[0] if items else np.zeros(dims, np.int64), least_lcs)))
    return out, basis if basis is not None else np.zeros((dims, rank), np.float32)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    rank: int = 96, dims: int = 1 << 13, fit_passages: int | None = None, least_cosine: float = 0.55, least_lcs: float = 0.6, min_tokens: int = 8, max_items: int = 20_000,
) -> DataFrame:
    """One row per document: id, contaminated, items (their ids in order), overlap (the largest share found)."""
    packed = pack_documents(docs, id_col, text_col, "decontaminate-packed", LETTERS, lower_bytes, as_hashes)
    item_type, id_type = benchmark.schema[item_col].dataType, packed.schema["ids"].dataType.elementType
    searches, basis = _searches(packed, benchmark, item_col, item_text_col, answer_col, rank, dims, fit_passages, least_lcs, min_tokens, max_items)
    kind = arrow_type(item_type)

    def look_for(search: Search) -> DataFrame:
        """A row per group: its ids, and for each document the items found and the largest share."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = search.found(Packed(row, dims), basis, least_cosine, least_lcs)
                    each = [found.get(d, {}) for d in range(len(row["ids"]))]
                    held = [[[search.names[p] for p in sorted(x)] for x in each]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["group"]]), pa.array([row["ids"]], pa.list_(arrow_type(id_type))), pa.array(held, pa.list_(pa.list_(kind))), pa.array([[max(x.values(), default=0.0) for x in each]], pa.list_(pa.float64()))],
                        ["group", "ids", "items", "overlap"],
                    )

        return packed.mapInArrow(run, f"group string, ids array<{id_type.simpleString()}>, items array<array<{item_type.simpleString()}>>, overlap array<double>")

    parts = [look_for(s) for s in searches]
    joined = parts[0]
    for other in parts[1:]:  # part by part of a benchmark beyond max_items
        other = materialize(other.select("group", F.col("items").alias("more"), F.col("overlap").alias("most")), "decontaminate-part")
        joined = joined.join(other, "group").select(
            "group", "ids", F.zip_with("items", "more", lambda a, b: F.array_sort(F.concat(a, b))).alias("items"), F.zip_with("overlap", "most", lambda a, b: F.greatest(a, b)).alias("overlap")
        )
    each = joined.select(F.explode(F.arrays_zip("ids", "items", "overlap")).alias("x"))
    return each.select(F.col("x.ids").alias(id_col), (F.size("x.items") > 0).alias("contaminated"), F.col("x.items").alias("items"), F.col("x.overlap").alias("overlap"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    rank: int = 96, dims: int = 1 << 13, fit_passages: int | None = None, least_cosine: float = 0.55, least_lcs: float = 0.6, min_tokens: int = 8, max_items: int = 20_000,
) -> DataFrame:
    """The documents that hold no benchmark item. Each row is judged by its own text where it lies: no list of ids, no shuffle."""
    packed = pack_documents(docs, id_col, text_col, "decontaminate-packed", LETTERS, lower_bytes, as_hashes)
    searches, basis = _searches(packed, benchmark, item_col, item_text_col, answer_col, rank, dims, fit_passages, least_lcs, min_tokens, max_items)
    discard(packed)
    at_text = docs.columns.index(text_col)
    for search in searches:  # one, unless the benchmark is beyond max_items

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher(LETTERS)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    lengths, hashes = hasher([lower_bytes(t.as_py()) for t in part.column(at_text)])
                    group = Packed({"ids": range(part.num_rows), "lengths": squeeze(lengths.astype(np.int32)), **as_hashes(hashes)}, dims)
                    found = search.found(group, basis, least_cosine, least_lcs)
                    yield part.filter(pa.array([d not in found for d in range(part.num_rows)], pa.bool_()))

        docs = map_batches(docs, run)
    return docs
