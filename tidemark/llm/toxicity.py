"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of 4 and 6 bytes (compounds and inflections share them). Every term of the labelled examples is a
dimension; its weight in a text is (1 + log tf) x idf x emphasis, with document frequencies counted over all documents. The emphasis lies
between 1 and 1 + `emphasis` and grows with the share of toxic rows among those that hold the term, shrunk towards the overall share by
`pseudo_rows`: rare terms keep the weight that their idf gives, terms that mark the label count more, and none is left out. The k nearest examples vote with the square of their
cosine, each class weighted back to its share among all labelled rows, shrunk towards the overall share: a calibrated
probability, with the nearest examples as evidence.

Index. Examples are numbered so that similar ones stand together, in blocks; postings are sorted by term and example; for each term and block the
largest weight is kept. A query adds up these maxima into an upper bound per block, takes the blocks with the highest bounds,
and then only those whose bound reaches the k-th best cosine found: exact, ties go to the smaller number.

Scale. The classifier is fitted on a bounded sample: at most `sample` labelled training rows of each class, by the hash of
their id (the bound is this parameter), so what is sent to executors is bounded whatever the corpus: some 15 MB, as examples hold some
hundred terms each. Document frequencies and scores cover all documents, each text being read whole, in two passes without a shuffle of texts.
Words are hashed and counted for many texts at once.

Defined results. Null and empty texts, and texts that share no term with any example, have no neighbours: their score is the share of toxic rows. Texts of any length count whole.
Several labels for one id: toxic if any says so; a null label is none. Labelled rows whose id is null, or in no document, are no examples, but count in the shares. Repeated rows are each scored.
Near copies among the examples of a class (same signature) count once. Other columns, whatever their names, are not read; `drop_toxic` returns them.
Without training rows of both classes every score is the share of toxic rows (0 without any). Empty table: empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .packing import LETTERS, WordHasher, lower_bytes, ranges

WORD = re.compile(r"[^\W\d_]+")
#: Bytes of the word beginnings that are terms.
BEGINNINGS = (4, 6)
#: Texts that are hashed and counted at once.
TEXTS = 64
K = 16
#: Weight of the overall share in a vote: so many exact matches of the less numerous class.
PRIOR = 0.05


def signature(text: str | None) -> int:
    """The smallest hash of the text's 5-word shingles: mostly the same for near copies."""
    words = WORD.findall((text or "").lower())
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) - (1 << 63)


def term_counts(hasher: WordHasher, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count), sorted by text and term."""
    text, terms = hasher.terms([lower_bytes(t) for t in texts], BEGINNINGS)
    order = np.lexsort((terms, text))
    text, terms = text[order], terms[order]
    first = np.nonzero((np.diff(text, prepend=-1) != 0) | (np.diff(terms, prepend=np.uint64(0)) != 0))[0]
    return text[first], terms[first], np.diff(np.append(first, len(text)))


class Vocabulary:
    """Places of sorted term hashes, found by their top bits and a few steps from there."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.steps = int(np.diff(self.first).max()) if len(hashes) else 0

    def counted(self, hasher: WordHasher, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, count) of the vocabulary's terms, sorted by text and place."""
        text, terms = hasher.terms([lower_bytes(t) for t in texts], BEGINNINGS)
        top = terms >> self.shift
        at, stop = self.first[top], self.first[top + np.uint64(1)]
        found = np.full(len(terms), -1)
        open_ = np.nonzero(at < stop)[0]
        for _ in range(self.steps):
            hit = self.hashes[at[open_]] == terms[open_]
            found[open_[hit]] = at[open_[hit]]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < stop[open_])]
            if not len(open_):
                break
        known = found >= 0
        pair = np.sort(text[known] * max(1, len(self.hashes)) + found[known])
        first = np.nonzero(np.diff(pair, prepend=-1))[0]
        return pair[first] // max(1, len(self.hashes)), pair[first] % max(1, len(self.hashes)), np.diff(np.append(first, len(pair)))


def unit_weights(owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of sparse vectors of length 1."""
    raw = (1 + np.log(counts)) * weight[terms]
    return raw / np.maximum(np.sqrt(np.bincount(owner, weights=raw * raw, minlength=n)), 1e-12)[owner]


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse vectors of length 1, given as (example, term, weight)."""

    #: Blocks that are looked at before any is left out.
    FIRST = 3

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, n_examples: int, block: int = 32) -> None:
        self.block, self.n_examples, self.n_blocks = block, n_examples, max(1, -(-n_examples // block))
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float32)
        cell = term[order] * self.n_blocks + self.example // block
        first = np.nonzero(np.diff(cell, prepend=-1))[0]
        self.cell_block = (cell[first] % self.n_blocks).astype(np.int32)
        self.cell_first = np.append(first, len(cell))
        self.highest = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0, np.float32)
        self.term_first = np.searchsorted(cell[first] // self.n_blocks, np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (cosine, example), best first; only cosines above zero."""
        held = self.term_first[terms + 1] - self.term_first[terms]
        cells = ranges(self.term_first[terms], held)
        block, times = self.cell_block[cells], np.repeat(weights, held)
        bound = np.bincount(block, weights=times * self.highest[cells], minlength=self.n_blocks)
        turn = np.argsort(-bound, kind="stable")
        looked = turn[: self.FIRST]
        scores = self._scores(cells, block, times, looked)
        best = np.sort(scores[scores > 0])[::-1]
        least = best[k - 1] - 1e-6 if len(best) >= k else 0.0  # margin: bounds and scores add up in different orders
        others = turn[self.FIRST :]
        others = others[(bound[others] > 0) & (bound[others] >= least)]
        if len(others):
            scores += self._scores(cells, block, times, others)
        scores = np.round(scores, 9)
        some = np.nonzero(scores > 0)[0]
        if len(some) > 4 * k:  # all that may be among the best, ties included
            some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
        some = some[np.lexsort((some, -scores[some]))][:k]
        return list(zip(scores[some].tolist(), some.tolist(), strict=True))

    def _scores(self, cells: np.ndarray, block: np.ndarray, times: np.ndarray, looked: np.ndarray) -> np.ndarray:
        wanted = np.zeros(self.n_blocks, bool)
        wanted[looked] = True
        inside = np.nonzero(wanted[block])[0]
        low = self.cell_first[cells[inside]]
        size = self.cell_first[cells[inside] + 1] - low
        at = ranges(low, size)
        return np.bincount(self.example[at], weights=self.weight[at] * np.repeat(times[inside], size), minlength=self.n_examples)


class Classifier:
    """Fitted: vocabulary, weights, index of examples. Bounded by the sample, the same whatever the corpus."""

    def __init__(self, examples: list[tuple[object, int, np.ndarray, np.ndarray]], class_rows: tuple[int, int], frequencies=None, emphasis: float = 5.0, pseudo_rows: float = 20.0) -> None:
        """examples: (id, toxic, term hashes, counts); frequencies(vocabulary) gives (documents with each term, documents)."""
        self.share = class_rows[1] / max(1, sum(class_rows))
        self.vocabulary = Vocabulary(np.unique(np.concatenate([np.empty(0, np.uint64), *(t for _, _, t, _ in examples)])))
        n_terms, n = len(self.vocabulary.hashes), len(examples)
        documents, n_docs = frequencies(self.vocabulary) if n_terms else (np.empty(0), 0)
        owner = np.repeat(np.arange(n), [len(t) for _, _, t, _ in examples])
        terms = np.searchsorted(self.vocabulary.hashes, np.concatenate([np.empty(0, np.uint64), *(t for _, _, t, _ in examples)]))
        counts = np.concatenate([np.empty(0, np.int64), *(c for _, _, _, c in examples)])
        toxic = np.array([y for _, y, _, _ in examples], int)
        stands_for = np.array([class_rows[c] / max(1, int((toxic == c).sum())) for c in (0, 1)])  # rows that an example stands for
        held = [np.bincount(terms[toxic[owner] == c], minlength=n_terms) * stands_for[c] for c in (0, 1)]
        said = (held[1] + pseudo_rows * self.share) / (held[0] + held[1] + pseudo_rows)
        marks = np.maximum(0.0, (said - self.share) / max(1e-12, 1 - self.share))
        self.weight = np.log((1 + n_docs) / (0.5 + np.minimum(documents, n_docs))) * (1 + emphasis * marks)
        weights = unit_weights(owner, terms, counts, self.weight, n)
        place = self._places(owner, terms, weights, n, n_terms)
        self.ids = [str(examples[k][0]) for k in np.argsort(place)]
        self.toxic = toxic[np.argsort(place)]
        self.index = BlockMaxIndex(place[owner], terms, weights, n_terms, n)
        self.rows = stands_for / max(float(stands_for.max()), 1e-12)

    @staticmethod
    def _places(owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, leaders: int = 32) -> np.ndarray:
        """New numbers of the examples: those that are nearest to the same leader stand together."""
        chosen = np.unique(np.linspace(0, max(0, n - 1), leaders).astype(int))
        best, own = np.full(n, -1.0), np.zeros(n, int)
        for k, e in enumerate(chosen if n else ()):
            row = np.zeros(n_terms)
            row[terms[owner == e]] = weights[owner == e]
            cosine = np.bincount(owner, weights=weights * row[terms], minlength=n)
            own[cosine > best + 1e-12] = k
            best = np.maximum(best, cosine)
        place = np.empty(n, np.int64)
        place[np.lexsort((-best, own))] = np.arange(n)
        return place

    def scores(self, hasher: WordHasher, texts: list[str | None], k: int = K) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """(probability, nearest examples) of each text."""
        owner, terms, counts = self.vocabulary.counted(hasher, texts)
        weights = unit_weights(owner, terms, counts, self.weight, len(texts))
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        prior = PRIOR * float(self.rows.min())
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            near = self.index.nearest(terms[low:high], weights[low:high], k) if high > low else []
            if not near:
                yield self.share, []
                continue
            said = self.toxic[[e for _, e in near]]
            votes = np.array([s for s, _ in near]) ** 2 * self.rows[said]
            yield float((votes @ said + prior * self.share) / (votes.sum() + prior)), near


def fit(
    docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1024, emphasis: float = 5.0, pseudo_rows: float = 20.0,
) -> Classifier:
    """training: a boolean column of labels' id, true for the rows to learn from. sample: the most examples of each class."""
    rows = labels.where(training & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = materialize(rows.where(F.col("toxic").isin(0, 1)), "toxic-labels")
    by_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    class_rows = (by_class.get(0, 0), by_class.get(1, 0))
    if not all(class_rows):
        return Classifier([], class_rows)
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = rows.where("toxic = 0").orderBy(*order).limit(sample).unionByName(rows.where("toxic = 1").orderBy(*order).limit(sample))
    chosen = materialize(chosen, "toxic-sample")  # at most 2 x sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id").select("id", "t", "toxic")
    kind = texts.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(t.as_py()) for t in batch.column(1)], pa.int64())], ["id", "t", "toxic", "s"])

    once = texts.mapInArrow(signed, f"id {kind}, t string, toxic int, s long").groupBy("s", "toxic").agg(F.min_by("t", "id").alias("t"), F.min("id").alias("id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(LETTERS)
        for batch in batches:
            for k in range(batch.num_rows):
                _, terms, counts = term_counts(hasher, [batch.column(2)[k].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([terms.tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], ["id", "toxic", "terms", "counts"])

    found = once.select("id", "toxic", "t").mapInArrow(counted, f"id {kind}, toxic int, terms binary, counts binary").orderBy("id", "toxic").collect()  # at most 2 x sample rows
    examples = [(r["id"], r["toxic"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in found]
    return Classifier(examples, class_rows, lambda vocabulary: _document_frequencies(docs, text_col, vocabulary), emphasis, pseudo_rows)


def _document_frequencies(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all documents. A task gives a row per term at most."""
    n_terms = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(LETTERS), np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                _, terms, _ = vocabulary.counted(hasher, batch.column(0).slice(at, TEXTS).to_pylist())
                counts += np.bincount(terms, minlength=n_terms + 1)
            counts[-1] += batch.num_rows
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["term", "n"])

    rows = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term
    counts = np.zeros(n_terms + 1, np.int64)
    counts[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return counts[:-1], int(counts[-1])


def toxicity_scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, evidence: int = 3) -> DataFrame:
    """One row per document: id, score, predicted, near_ids and near_cosines (the nearest examples as evidence)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(LETTERS)
        for batch in batches:
            scored = [x for at in range(0, batch.num_rows, TEXTS) for x in model.scores(hasher, batch.column(1).slice(at, TEXTS).to_pylist())]
            ids = [[model.ids[e] for _, e in near[:evidence]] for _, near in scored]
            cosines = [[s for s, _ in near[:evidence]] for _, near in scored]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array([int(s >= threshold) for s, _ in scored], pa.int32()), pa.array(ids, pa.list_(pa.string())), pa.array(cosines, pa.list_(pa.float64()))],
                ["id", "score", "predicted", "near_ids", "near_cosines"],
            )

    plain = docs.select(F.col(id_col), F.col(text_col).alias("the text"))
    return plain.mapInArrow(run, f"{id_col} {kind}, score double, predicted int, near_ids array<string>, near_cosines array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, learnt from all rows of labels outside the held-out fold."""
    model = fit(docs, labels, training_fold(id_col), id_col, text_col)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(LETTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield part.filter(pa.array([s < threshold for s, _ in model.scores(hasher, part.column(at_text).to_pylist())], pa.bool_()))

    return map_batches(docs, run)


def training_fold(id_col: str = "doc_id"):
    """True unless crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2
