"""Language-model scoring by deleted interpolation of n-gram estimates.

Tokens are words and one end per text. The model is a bigram mixture: P(w | u) = a f(w | u) + b f(w) + c / (V + 1), where f
are maximum-likelihood estimates from the training documents and (a, b, c) depend on the bucket of the context's
frequency (powers of two). The weights come from expectation-maximisation over deleted counts: each training token is taken
out of the counts in turn (c(u, w) - 1 over c(u) - 1, c(w) - 1 over N - 1), so every count is held out once and no data
is set aside. For that, tokens are gathered in a histogram over bucket and the two estimates in steps of an eighth
octave; its size depends on the steps, not on the corpus, and the weights are fitted on it.

Plan. (1) Texts are split once and written as groups of packed word numbers. (2) Each group sends its distinct words and
bigrams, with their counts in training documents, to slices of the hash range; a slice adds them up and returns to each group
the totals of what it sent, in the same order: no token is shuffled, only distinct keys of a group, and no model is
gathered anywhere. (3) Groups meet their totals and write per-token counts; histogram and scores are read off that.

Exchange. What a group sends to a slice is one piece: sorted keys as differences, byte plane by byte plane. Words have
64-bit keys. Bigram keys have 20 bits more than the number of tokens has, whatever that is, so one bigram in a million shares its key;
with many keys to a group a difference takes under four bytes. The shuffle's files go when the totals are written, the packed table and the totals
when the counts are.

Scale. A slice takes `slice_keys` keys, a group about `group_bytes` of text: memory is bounded by these two, and the number of slices
follows the number of keys sent, words and bigrams apart. A word that fills the corpus is one key per group. A
piece holds (keys of a group) x slice_keys / (all keys) keys: some 300 keys at 30 GB. There are never more pieces than keys, but from some
terabytes on pieces hold a few keys only; then raise both parameters with the memory of the executors, as the number of pieces falls with their product.

Defined results. Null text is empty: one token, the end. A text of any length is whole in one group. Repeated rows are scored and counted as often as they are.
Rows with a null id count as id ''. Other columns, whatever their names, are not read. Without training tokens all estimates fall back to the uniform one.
Empty table: empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .packing import SPACED, as_vocabulary, ascii_lower_bytes, finish, pack_documents, squeeze_planes, unsqueeze, unsqueeze_planes

END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)  # keys of the end and of the place before a text
STEPS = 8  # of the histogram, per octave
EM_ROUNDS = 60
FLOOR = 1e-6  # least weight of the uniform estimate
#: Bits of a bigram's key beyond those that the number of tokens has.
SPARE_BITS = 20


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs (the splitmix64 finaliser over a combination of both)."""
    return finish(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))))


class Group:
    """A packed group with its end tokens: places of words and of their predecessors, and which tokens are for training."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, vocabulary: np.ndarray, training: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64) + 1
        self.keys = np.concatenate([vocabulary, [END, BEGIN]]).astype(np.uint64)
        n = len(vocabulary)
        last = np.cumsum(self.lengths) - 1
        self.cur = np.full(int(self.lengths.sum()), n, np.int32)
        is_word = np.ones(len(self.cur), bool)
        is_word[last] = False
        self.cur[is_word] = tokens
        self.prev = np.empty_like(self.cur)
        self.prev[1:] = self.cur[:-1]
        self.prev[last - self.lengths + 1] = n + 1
        self.training = np.repeat(training, self.lengths)

    @classmethod
    def of(cls, row: dict) -> Group:
        return cls(unsqueeze(row["lengths"], np.int32), unsqueeze_planes(row["tokens"], np.int32), np.frombuffer(row["vocabulary"], np.uint64), np.array(row["flags"], bool))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, training counts) of the group's words, the end and the beginning."""
        counts = np.bincount(self.cur[self.training], minlength=len(self.keys))
        counts[-1] = np.count_nonzero(self.training & (self.prev == len(self.keys) - 1))
        return self.keys, counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, training counts, each token's place) of the group's bigrams."""
        code = self.prev.astype(np.int64) * len(self.keys) + self.cur
        codes, place = np.unique(code, return_inverse=True)
        keys = mix(self.keys[codes // len(self.keys)], self.keys[codes % len(self.keys)])
        return keys, np.bincount(place[self.training], minlength=len(codes)), place


class Exchange:
    """How the keys of a kind are dealt over slices of the hash range, and how wide they are on the way."""

    def __init__(self, kind: str, keys: int, slice_keys: int, bits: int = 64) -> None:
        self.kind, self.n_slices, self.dropped = kind, max(1, -(-keys // slice_keys)), np.uint64(64 - bits)

    def order(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys in order, where the slices are cut)."""
        order = np.argsort(keys)
        slices = (keys[order] >> np.uint64(32)) * np.uint64(self.n_slices) >> np.uint64(32)
        return order, np.searchsorted(slices, np.arange(self.n_slices + 1, dtype=np.uint64))

    def pieces(self, keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """(slice, keys as differences, counts) of all slices that get any."""
        order, cut = self.order(keys)
        narrow, counts = keys[order] >> self.dropped, counts[order].astype(np.uint32)
        told = [(s, int(cut[s]), int(cut[s + 1])) for s in range(self.n_slices) if cut[s + 1] > cut[s]]
        return [(s, squeeze_planes(np.diff(narrow[a:b], prepend=np.uint64(0))), squeeze_planes(counts[a:b])) for s, a, b in told]

    def totals_of(self, keys: np.ndarray, pieces: dict[int, bytes]) -> np.ndarray:
        """The totals that came back, in the order of the keys."""
        out = np.empty(len(keys), np.uint64)
        out[self.order(keys)[0]] = np.concatenate([unsqueeze_planes(pieces[s], np.uint64) for s in sorted(pieces)])
        return out


def _send(packed: DataFrame, words: Exchange, pairs: Exchange) -> DataFrame:
    """(kind, slice, group, keys, counts): what each group sends to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = Group.of(row)
                for exchange, (keys, counts) in ((words, group.words()), (pairs, group.pairs()[:2])):
                    parts = exchange.pieces(keys, counts)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "kind": [exchange.kind] * len(parts), "slice": pa.array([s for s, _, _ in parts], pa.int32()), "group": [row["group"]] * len(parts),
                            "keys": [k for _, k, _ in parts], "counts": [n for _, _, n in parts],
                        }
                    )

    return packed.mapInArrow(run, "kind string, slice int, group string, keys binary, counts binary")


def _add_up(sent: pa.Table) -> pa.Table:
    """All that was sent to a slice: totals for each group, in its order, and how many keys and tokens have training counts."""
    kind, at = sent.column("kind")[0].as_py(), sent.column("slice")[0].as_py()
    keys = [np.cumsum(unsqueeze_planes(x.as_py(), np.uint64), dtype=np.uint64) for x in sent.column("keys")]
    sizes = [len(k) for k in keys]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unsqueeze_planes(x.as_py(), np.uint32) for x in sent.column("counts")])
    totals = np.bincount(place, weights=counts, minlength=len(every)).astype(np.uint64)  # exact up to 2^53
    back = np.split(totals[place], np.cumsum(sizes)[:-1])
    proper = totals[every != BEGIN] if kind == "word" else totals
    n = len(back)
    return pa.table(
        {
            "kind": [kind] * (n + 1), "slice": pa.array([at] * (n + 1), pa.int32()), "group": [*sent.column("group").to_pylist(), None], "totals": [*(squeeze_planes(b) for b in back), None],
            "distinct": pa.array([None] * n + [int(np.count_nonzero(proper))], pa.int64()), "tokens": pa.array([None] * n + [int(proper.sum())], pa.int64()),
        }
    )


def _counted(packed: DataFrame, totals: DataFrame, words: Exchange, pairs: Exchange) -> DataFrame:
    """Per group, for each token: the corpus counts of its word and of the bigram that it ends."""
    id_type = packed.schema["ids"].dataType.simpleString()

    def meet(groups: pa.Table, pieces: pa.Table) -> pa.Table:
        out = {"ids": [], "flags": [], "lengths": [], "begin": [], "word": [], "pair": []}
        came: dict[str, dict[int, bytes]] = {words.kind: {}, pairs.kind: {}}
        for kind, at, blob in zip(*(pieces.column(c).to_pylist() for c in ("kind", "slice", "totals")), strict=True):
            came[kind][at] = blob
        for row in groups.to_pylist():  # one row
            group = Group.of(row)
            by_word = words.totals_of(group.keys, came[words.kind])
            keys, _, place = group.pairs()
            by_pair = pairs.totals_of(keys, came[pairs.kind])
            for name, value in (("ids", row["ids"]), ("flags", row["flags"]), ("lengths", row["lengths"]), ("begin", int(by_word[-1])), ("word", squeeze_planes(by_word[group.cur])), ("pair", squeeze_planes(by_pair[place]))):
                out[name].append(value)
        types = {"ids": groups.schema.field("ids").type, "flags": pa.list_(pa.bool_()), "begin": pa.int64()}
        return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    sent = packed.select("group", "ids", "flags", "lengths", "tokens", "vocabulary").groupBy("group")
    return sent.cogroup(totals.where("group is not null").select("group", "kind", "slice", "totals").groupBy("group")).applyInArrow(meet, f"ids {id_type}, flags array<boolean>, lengths binary, begin long, word binary, pair binary")


def token_counts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens per document, counts of each token's word, predecessor and bigram). The predecessor is the word before, or the beginning."""
    lengths = unsqueeze(row["lengths"], np.int32).astype(np.int64) + 1
    word, pair = (unsqueeze_planes(row[k], np.uint64).astype(float) for k in ("word", "pair"))
    context = np.concatenate([[0.0], word[:-1]])
    context[np.cumsum(lengths) - lengths] = row["begin"]
    return lengths, word, context, pair


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(frequency))."""
    return np.where(context > 0, np.frexp(context)[1], 0)


def deleted_events(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram estimate, word estimate) of training tokens, each taken out of the counts."""
    left = context - 1.0
    two = np.divide(pair - 1.0, left, out=np.zeros(len(left)), where=left > 0)
    one = (word - 1.0) / max(n_tokens - 1, 1)
    return bucket_of(left), two, one


def _code(share: np.ndarray) -> np.ndarray:
    """Eighths of octaves below 1; 0 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, 1 + np.rint(-STEPS * np.log2(np.maximum(share, 1e-300))), 0).astype(np.int64)


def _share(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** (-(code - 1) / STEPS), 0.0)


def fit_weights(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, weight: np.ndarray, uniform: float) -> np.ndarray:
    """Mixture weights by bucket (64 x 3), by expectation-maximisation; buckets without events take the overall ones."""

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        shares = np.stack([two[rows], one[rows], np.full(int(rows.sum()), uniform)], 1)
        w, mixture = weight[rows].astype(float), start.copy()
        for _ in range(EM_ROUNDS):
            part = shares * mixture
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            mixture = (part * w[:, None]).sum(0) / w.sum()
            mixture[2] = max(mixture[2], FLOOR)
            mixture /= mixture.sum()
        return mixture

    third = np.full(3, 1 / 3)
    overall = fit(np.ones(len(bucket), bool), third) if len(bucket) else np.array([0.0, 0.0, 1.0])
    weights = np.tile(overall, (64, 1))
    for b in np.unique(bucket):
        weights[b] = fit(bucket == b, third)
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]  # no bigram estimate without a context
    return weights


def lm_scores(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 10 << 20, slice_keys: int = 2_000_000) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token.

    training: a boolean column, true for the documents to learn from."""
    packed = pack_documents(docs, id_col, text_col, "lm-packed", SPACED, ascii_lower_bytes, as_vocabulary, F.coalesce(training, F.lit(True)), group_bytes, bucketed=True)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    n_sent, n_every = packed.agg(total(F.length("vocabulary") / 8 + 2), total(F.col("n_words") + F.size("ids"))).first()
    words = Exchange("word", n_sent, slice_keys)
    pairs = Exchange("pair", n_every, slice_keys, min(64, SPARE_BITS + max(16, math.ceil(math.log2(n_every + 1)))))
    totals = _send(packed, words, pairs).groupBy("kind", "slice").applyInArrow(_add_up, "kind string, slice int, group string, totals binary, distinct long, tokens long")
    totals = materialize(totals, "lm-totals")
    known = totals.where("group is null and kind = 'word'").agg(total("distinct"), total("tokens")).first()
    n_words, n_tokens = int(known[0]), int(known[1])
    counted = materialize(_counted(packed, totals, words, pairs), "lm-counted")
    discard(packed, totals)
    cells = counted.mapInArrow(lambda batches: _histogram(batches, n_tokens), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, weight = cells.column("code").to_numpy(), cells.column("n").to_numpy()
    mixture = fit_weights(code >> 40, _share((code >> 20) & 0xFFFFF), _share(code & 0xFFFFF), weight, 1.0 / (n_words + 1))
    id_type = counted.schema["ids"].dataType.elementType.simpleString()
    scored = counted.mapInArrow(
        lambda batches: _score(batches, mixture, n_words, n_tokens), f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("bits_per_token", -F.col("score") / F.col("n_tokens") / F.log10(F.lit(2.0)))


def _histogram(batches: Iterator[pa.RecordBatch], n_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths, word, context, pair = token_counts(row)
            training = np.repeat(np.array(row["flags"], bool), lengths)
            bucket, two, one = deleted_events(word[training], context[training], pair[training], n_tokens)
            codes, n = np.unique(bucket.astype(np.int64) << 40 | _code(two) << 20 | _code(one), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])


def _score(batches: Iterator[pa.RecordBatch], mixture: np.ndarray, n_words: int, n_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, row in enumerate(batch.to_pylist()):
            lengths, word, context, pair = token_counts(row)
            base = np.log10((word + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
            w = mixture[bucket_of(context)]
            two = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
            model = np.log10(w[:, 0] * two + w[:, 1] * (word / max(n_tokens, 1)) + w[:, 2] / (n_words + 1))
            starts = np.cumsum(lengths) - lengths
            held = ~np.array(row["flags"], bool)
            total = pa.array(np.full(len(held), n_tokens))
            columns = [batch.column(0)[k].values, pa.array(held), pa.array(lengths), pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)), total, pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
