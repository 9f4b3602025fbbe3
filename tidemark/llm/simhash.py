"""SimHash near-deduplication by a binary trie self-join.

Fingerprint. Words of the lower-cased text form shingles; each shingle's XXH64 votes on 64 bits; a bit is set if more
than half of the shingles have it. A wide fingerprint has several such words of 64 bits, from further mixes of the hash.

Join. Distinct fingerprints (copies collapse before any join) whose 64 bits differ in at most `budget` bits are linked.
If two differ in at most `budget` bits, then in one of budget + 1 bands they agree. For each band, the bits
are rotated so that it comes first: those that share it form a binary trie, in which two node sets are walked down
together. Each step halves both nodes at the next bit; a pair that takes different branches adds one to its differing
bits; a pair beyond the budget is pruned. Sorted arrays serve as tries (a node is a range), and all node pairs of a
partition step down together in numpy. Pairs of small nodes are compared directly.

Similarity search. Texts that share 0.8 of their shingles differ in about 15 % of the bits, far more than a budget that a trie
can prune by. For them, parts of 32 bits of a wide fingerprint (each 16 bits in two parts) are searched with tries of their own
and a budget of 3; a pair that any part brings together is compared on 128 further bits, which no part has and which stand for the fingerprint, so that no more than they travel with each part. As they have no
bit that brought the pair together, unrelated texts pass both with a chance of 3e-10: they stay unlinked up to some billions of texts, where bits shared with the parts would join all texts into one group from a few millions on.
Repeats of a shingle vote once there, so
that fingerprints follow the sets of shingles. The bits only nominate: their bound is loose, and the members of a group that they make are
compared by the Jaccard similarity of their shingle sets (each set's rarest part by hash order finds all pairs that can
reach it). Only pairs that reach it are links. Sets of a few shingles, whose bits are not even, and those that are large enough to be similar to them are nominated by shared shingles. The sets are made from the texts again, of the nominated ones only.
A group of more than `set_bytes` of sets is split into chunks that meet in pairs, some at a time, so that a pass holds each set at most 2 * OFFSETS - 1 times.

Links. A group of m fingerprints may have m * m / 2 links; only a spanning forest of the links found in a cell leaves
the task (at most m - 1 links), which has the same components. Members of a crowded node are compared with a pivot
first; those linked to it need not be compared with each other. Cells with more than `cell_rows` fingerprints are split into
chunks and each pair of chunks is a cell of its own, so no task holds more than two chunks of a cell.

Components. Up to `TASK_LINKS` spanning links are joined by one task; of more, each part leaves a spanning forest first, and if
too many are left, large-star and small-star steps follow until nothing changes, each step written to the shared folder. Documents join their fingerprint's component with hot fingerprints spread.

Defined results. Null and empty texts have fingerprint zero, linked like any other. Texts of any length count whole. Other columns, whatever their names, are not read (`drop_near_duplicates` returns them). Repeated rows come back as often as
they are. A null id counts as larger than any other when the smallest id is taken. Empty table: empty result."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup_join, materialize, maybe_among, quoted, row_key, taken_apart, whole_rows

#: Node pairs with at most this many leaf pairs are compared directly.
LEAF_PAIRS = 32
#: Nodes whose members have the same searched bits go through a pivot from this many pairs on.
PIVOT_PAIRS = 4096
#: 64-bit words of a wide fingerprint that are searched, and further ones that stand for it.
WIDE_WORDS, KEPT_WORDS = 5, 2
#: Parts of a wide fingerprint that are searched, as pairs of 16-bit pieces, and how many bits may differ in a part.
WIDE_PARTS = [(k, k + 1) for k in range(0, 4 * WIDE_WORDS, 2)] + [(k, (k + 3) % (4 * WIDE_WORDS)) for k in range(0, 4 * WIDE_WORDS, 2)]
PART_BUDGET = 3
#: Sets of up to so many shingles, whose bits differ most and are mostly zeros if their number is even, are brought together by their shingles instead.
SHORT = 8
#: Links up to this many are brought to their components by one task (measured on random links of 16-byte nodes: 290 MB at a million links, 390 at two, the most that a task holds); of more, spanning forests of parts come first.
TASK_LINKS = 1 << 20
#: A pass over the large groups takes the meetings of each chunk with itself and those up to so many places on, less one.
OFFSETS = 4

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; of the whole word sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for low in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte, which numpy adds many at a time
            ones += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """The SimHash of a text, `words` words of 64 bits; zeros if it has no words. The first comes from XXH64 itself."""
    hashes = shingle_hashes(text, shingle, seed)
    return _mixed(hashes, words)


def _mixed(hashes: np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    out = [_majority(hashes)]
    for _ in range(words - 1):  # the splitmix64 step
        hashes = hashes + np.uint64(0x9E3779B97F4A7C15)
        mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(mixed ^ (mixed >> np.uint64(31))))
    return out


def add_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """(id, fp): fp holds 8 bytes a word, big-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [np.array(fingerprint(t.as_py(), shingle, seed, words), ">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp binary")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _halve(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where nodes [lo, hi) of sorted a, at the given depths, divide into bit 0 and bit 1."""
    bit = np.uint64(1) << (np.uint64(63) - depth)
    pivot = (a[lo] & ~((bit << np.uint64(1)) - np.uint64(1))) | bit
    return np.clip(np.searchsorted(a, pivot), lo, hi)


def trie_pairs(a: np.ndarray, cells: np.ndarray, depth: int, budget: int, near: Near, width: int = 64, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted uint64 array a that differ in at most `budget` of their first `width` bits, and that near() accepts.

    cells: rows (lo, hi) of ranges whose members share their first `depth` bits; each is joined with itself, each pair
    found once (of crowded nodes, enough pairs for the same components). At most about `most` node pairs step at once,
    the others wait, so memory is bounded."""
    cells = np.asarray(cells, np.int64).reshape(-1, 2)
    waiting = [(np.hstack([cells, cells]), np.zeros(len(cells), np.int8), np.full(len(cells), depth, np.uint64))]
    while waiting:
        nodes, differ, at = waiting.pop()
        if len(nodes) > most:
            half = len(nodes) // 2
            waiting += [(nodes[:half], differ[:half], at[:half]), (nodes[half:], differ[half:], at[half:])]
            continue
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        crowded = (at >= width) & (sizes > PIVOT_PAIRS)
        for lo, hi, lo2, hi2 in nodes[crowded]:
            yield from _crowd(np.arange(lo, hi), np.arange(lo2, hi2), near)
        leaf = ((sizes <= LEAF_PAIRS) | (at >= width)) & ~crowded
        if leaf.any():
            yield from _compare(a, nodes[leaf], sizes[leaf], budget, near)
        nodes, differ, at = nodes[~leaf & ~crowded], differ[~leaf & ~crowded], at[~leaf & ~crowded]
        if not len(nodes):
            continue
        m1, m2 = _halve(a, nodes[:, 0], nodes[:, 1], at), _halve(a, nodes[:, 2], nodes[:, 3], at)
        same = nodes[:, 0] == nodes[:, 2]
        zero = (nodes[:, 0], m1, nodes[:, 2], m2)
        one = (m1, nodes[:, 1], m2, nodes[:, 3])
        cross = (nodes[:, 0], m1, m2, nodes[:, 3])
        back = (m1, nodes[:, 1], nodes[:, 2], m2)
        children = np.concatenate([np.stack(x, 1) for x in (zero, one, cross, back)])
        count = np.concatenate([differ, differ, differ + 1, differ + 1])
        live = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2]) & (count <= budget)
        live[3 * len(nodes) :] &= ~same  # of a node with itself, the crossing pair counts once
        waiting.append((children[live], count[live], np.tile(at + np.uint64(1), 4)[live]))


def _compare(a: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, budget: int, near: Near, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all members of small node pairs."""
    for part in np.split(np.arange(len(nodes)), np.searchsorted(np.cumsum(sizes), np.arange(most, sizes.sum(), most))):
        if not len(part):
            continue
        n, size = nodes[part], sizes[part]
        within = _ranges(np.zeros(len(n), np.int64), size)
        width = np.repeat(n[:, 3] - n[:, 2], size)
        i, j = np.repeat(n[:, 0], size) + within // width, np.repeat(n[:, 2], size) + within % width
        close = (np.bitwise_count(a[i] ^ a[j]) <= budget) & ((i < j) | np.repeat(n[:, 0] != n[:, 2], size))
        i, j = i[close], j[close]
        if len(i) and (linked := near(i, j)).any():
            yield i[linked], j[linked]


def _crowd(left: np.ndarray, right: np.ndarray, near: Near, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between (or, if they are the same, within) crowded sets with the components that all links would have."""
    if not np.array_equal(left, right):
        step = max(1, most // len(right))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            i, j = np.repeat(some, len(right)), np.tile(right, len(some))
            if (linked := near(i, j)).any():
                yield i[linked], j[linked]
        return
    while len(left) > 1:
        pivot, others = np.full(len(left) - 1, left[0]), left[1:]
        linked = near(pivot, others)
        if linked.any():
            yield pivot[linked], others[linked]
            if (~linked).any():
                yield from _crowd(others[linked], others[~linked], near, most)
        left = others[~linked]


class Forest:
    """Union-find over 0 .. n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def flatten(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            self.flatten()
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, j, i)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all that are no roots."""
        self.flatten()
        member = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return member, self.parent[member]


def near_links(prints: DataFrame, budget: int, words: int = 1, parts: list[tuple[int, ...]] | None = None, differing: int | None = None, cell_rows: int = 200_000) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp): spanning forests that have all links' components.

    parts: 16-bit pieces of column `wide`, of `words` words, that make up each searched part (by default the whole of one word, of fp itself); each is
    searched with `budget`. differing: the most bits in which fingerprints fp may differ (the budget if there is one part)."""
    differing = budget if differing is None else differing
    parts = parts or [tuple(range(4 * words))]
    width, ones = 16 * len(parts[0]), np.uint64(0xFFFFFFFFFFFFFFFF)
    cuts = [width * k // (budget + 1) for k in range(budget + 2)]
    least = min(b - a for a, b in zip(cuts, cuts[1:], strict=False))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each band of each part: the part's bits, rotated within its width, at the top of 64 bits."""
        for batch in batches:
            raw = batch.column(0)
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
            for part, pieces in enumerate(parts):
                bits = np.zeros(len(wide), np.uint64)
                for at, piece in enumerate(pieces):
                    bits |= ((wide[:, piece // 4] >> np.uint64(48 - 16 * (piece % 4))) & np.uint64(0xFFFF)) << np.uint64(48 - 16 * at)
                for k in range(budget + 1):
                    turned = bits if not cuts[k] else ((bits << np.uint64(cuts[k])) | (bits >> np.uint64(width - cuts[k]))) & (ones << np.uint64(64 - width))
                    cell = (turned >> np.uint64(64 - least)).astype(np.int32)
                    band = np.full(len(turned), part * (budget + 1) + k, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(cell), pa.array(turned.view(np.int64)), raw], ["band", "cell", "turned", "fp"])

    turned = prints.select("fp", F.col("wide" if "wide" in prints.columns else "fp").alias("wide")).mapInArrow(deal, "band int, cell int, turned long, fp binary")
    crowded = turned.groupBy("band", "cell").count().where(F.col("count") > cell_rows)
    crowded = materialize(crowded.select("band", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks")), "simhash-crowded")
    if crowded.isEmpty():
        dealt = turned.withColumn("pair", F.lit(0))
    else:  # chunk c meets chunk o in the cell (lower, higher); few cells can be crowded
        dealt = turned.join(crowded, ["band", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.withColumn("pair", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
    dealt = dealt.select("band", "cell", "pair", "turned", "fp").repartition("band", "cell", "pair").sortWithinPartitions("band", "pair", "cell", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 100_000:
                done, rest = split(pa.Table.from_batches(waiting).combine_chunks())
                waiting = rest.to_batches()
                yield from join_cells(done)
        if waiting:
            yield from join_cells(pa.Table.from_batches(waiting).combine_chunks())

    def split(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Whole cells, and the last cell, which may go on."""
        key = np.stack([rows.column(i).to_numpy() for i in range(3)])
        changes = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0]
        cut = changes[-1] + 1 if len(changes) else 0
        return rows.slice(0, cut), rows.slice(cut)

    def join_cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        key = np.stack([rows.column(i).to_numpy() for i in (0, 2)])
        for part in np.split(np.arange(rows.num_rows), np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1):
            mine = rows.slice(part[0], len(part))
            a = mine.column(3).to_numpy().view(np.uint64)
            order = np.argsort(a, kind="stable")  # signed order is not the trie's
            a = a[order]
            raw = mine.column(4).take(pa.array(order)).combine_chunks()
            wide = np.frombuffer(b"".join(raw.to_pylist()), ">u8").reshape(len(raw), -1).astype(np.uint64)
            cut = np.concatenate([[0], np.nonzero(np.diff(a >> np.uint64(64 - least)))[0] + 1, [len(a)]])
            cells = np.stack([cut[:-1], cut[1:]], 1)
            forest = Forest(len(a))
            near = lambda i, j, w=wide: sum(np.bitwise_count(w[i, k] ^ w[j, k]).astype(np.int32) for k in range(w.shape[1])) <= differing
            for i, j in trie_pairs(a, cells[cells[:, 1] - cells[:, 0] > 1], least, budget, near, width):
                forest.join(i, j)
            i, j = forest.links()
            if len(i):
                yield pa.RecordBatch.from_arrays([raw.take(pa.array(i)), raw.take(pa.array(j))], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _forests(links: DataFrame, tasks: int, most: int) -> DataFrame:
    """(a, b): each task's links as a spanning forest, from each node to the smallest of its tree. A task that never has more than `most` links gives one forest; no task holds more than twice as many and a batch."""

    def spanning(rows: pa.Table) -> pa.Table:
        nodes = pa.chunked_array([*rows.column(0).chunks, *rows.column(1).chunks], rows.schema.field(0).type).combine_chunks().dictionary_encode()
        order = pc.sort_indices(nodes.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        i, j = np.split(place[nodes.indices.to_numpy()], 2)
        forest = Forest(len(order))
        forest.join(i, j)
        return pa.table([nodes.dictionary.take(order.take(pa.array(k))) for k in forest.links()], rows.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > 2 * most:
                held = [spanning(pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows > most:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if rows:
            yield from spanning(pa.concat_tables(held)).to_batches()

    return links.coalesce(tasks).mapInArrow(run, links.schema)


def components(links: DataFrame, most_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for the nodes of undirected links (a, b); root is the smallest of a component.

    Up to task_links links go through one task. More are made fewer by spanning forests of their parts, as long as that takes a quarter of them away; if
    still more are left, alternating large-star and small-star steps follow. These are some 15 stages a round, whose tasks the driver keeps account of."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    total = edges.count()
    while total > task_links:
        former, before = edges, total
        edges = materialize(_forests(edges, math.ceil(total / task_links), task_links), "cc-forests")
        discard(former)
        total = edges.count()
        if 4 * total > 3 * before:
            break
    if total <= task_links:
        return materialize(_forests(edges, 1, task_links), "cc-roots").toDF("node", "root")
    state = None
    for _ in range(most_rounds):
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = lookup_join(both, low, "a", "n", total, ["b"], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup_join(large, low, "a", "n", total, ["b"], "inner")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "cc-small")
        new = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classed(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, fp) with component_id, the smallest id of the fingerprint's component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("wide", "bytes") if c in prints.columns]), "simhash-distinct")
    roots = components(links(distinct))
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select("root", "low")
    heads = distinct.join(roots.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("root"), "low")
    least = materialize(linked.unionByName(heads).groupBy("root").agg(F.min("low").alias("least")), "simhash-least")
    rooted = roots.unionByName(least.select(F.col("root").alias("node"), "root")).join(least, "root").select(F.col("node").alias("fp"), "least")
    classes = materialize(distinct.join(rooted, "fp", "left").select("fp", "n", F.when(F.col("least").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")), "simhash-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup_join(prints.select("id", "fp"), classes, "fp", "n", total, ["id"], "inner")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, cell_rows: int = 200_000) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links)."""
    prints = materialize(add_fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    joined = _classed(prints, lambda distinct: near_links(distinct, budget, cell_rows=cell_rows))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def wide_fingerprint(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """(fp, wide): words of 64 bits, big-endian, on which each distinct shingle votes once. The KEPT_WORDS words of fp come after the WIDE_WORDS of wide."""
    raw = np.array(_mixed(shingles, WIDE_WORDS + KEPT_WORDS), ">u8").tobytes()
    return raw[8 * WIDE_WORDS :], raw[: 8 * WIDE_WORDS]


def add_wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, fp, wide, bytes, shingles): id has the id and the text's hash, nulls last; bytes is the size of the set of shingles; shingles are its distinct hashes in order, 8 bytes each, of sets that can be similar to one of SHORT."""
    longest = math.floor(SHORT / similarity + 1e-9)
    plain = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text")).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                fp, wide = zip(*map(wide_fingerprint, sets), strict=True)
                short = [x.tobytes() if len(x) <= longest else None for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.binary()), pa.array(wide, pa.binary()), pa.array([x.nbytes for x in sets], pa.int64()), pa.array(short, pa.binary())], ["id", "fp", "wide", "bytes", "shingles"])

    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp binary, wide binary, bytes long, shingles binary")


def shingle_sets(docs: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the texts whose hash is in column `text` of wanted, and of a few others; each fp once. shingles are distinct hashes in order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([wide_fingerprint(x)[0] for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "shingles"])

    plain = maybe_among(docs.select(quoted(text_col).alias("t")), F.xxhash64("t"), wanted, "text")
    return plain.mapInArrow(run, "fp binary, shingles binary").dropDuplicates(["fp"])


def differing_bits(similarity: float, words: int = KEPT_WORDS) -> int:
    """Bits in which fingerprints of so many words may differ: five standard deviations more than those of two equally large sets with this Jaccard similarity.

    Sets of a few shingles differ in more bits than large ones (0.19 against 0.15 of them at 0.8); that is within the bound."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * words * p + 5 * math.sqrt(64 * words * p * (1 - p)))


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sorted sets whose Jaccard similarity is `similarity` or more.

    Of such a pair, the first n - ceil(similarity * n) + 1 members of both sets have one in common."""
    forest, seen = np.arange(len(sets)), {}  # forest: number of the group of each set
    i, j = [], []
    sizes = np.array([len(x) for x in sets])
    for k, own in enumerate(sets):
        head = own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1].tolist()
        met = [seen[h] for h in head if h in seen]
        shared = np.bincount(np.concatenate([np.array(m) for m in met])) if met else np.empty(0, np.int64)
        left = np.nonzero(shared)[0]
        left = left[np.minimum(sizes[left], len(own)) >= similarity * np.maximum(sizes[left], len(own)) - 1e-9]
        left = left[np.argsort(-shared[left], kind="stable")]  # the likeliest first
        while len(left):
            o = int(left[0])
            common = len(np.intersect1d(own, sets[o], assume_unique=True))
            if common >= similarity * (len(own) + sizes[o] - common) - 1e-9:
                i.append(k)
                j.append(o)
                forest[forest == forest[k]] = forest[o]
                left = left[forest[left] != forest[o]]
            else:
                left = left[1:]
        for h in head:
            seen.setdefault(h, array("q")).append(k)
    return np.array(i, np.int64), np.array(j, np.int64)


def short_links(prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that nominate all similar pairs with a set of up to SHORT shingles: those that share one of their first (see similar_links)."""
    n = F.length("shingles") / 8
    heads = prints.where(F.length("shingles") > 0).select("fp", "shingles", F.explode(F.sequence(F.lit(0), (n - F.ceil(similarity * n - 1e-9)).cast("int"))).alias("k"))
    heads = heads.select("fp", F.expr("substring(shingles, 8 * k + 1, 8)").alias("head")).distinct()
    least = heads.groupBy("head").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    return lookup_join(heads, least, "head", "n", heads.count(), ["fp"], "inner").where("fp <> b").select(F.col("fp").alias("a"), "b")


def verified_links(prints: DataFrame, nominated: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, set_bytes: int = 8 << 20) -> DataFrame:
    """(a, b) links between fingerprints whose shingle sets are similar, among the components of the nominated links. sets_of: see shingle_sets."""
    roots = components(nominated)
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    held = prints.groupBy("fp").agg(F.max("bytes").alias("bytes"), F.min("id.text").alias("text"))
    members = materialize(held.join(rooted, F.col("fp") == F.col("node")).select("fp", "root", "bytes", "text"), "simhash-members")
    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("bytes") / set_bytes).cast("int").alias("chunks"))
    dealt = lookup_join(members.select("fp", "root"), groups, "root", "n", members.count(), ["fp"], "inner")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    sets = materialize(sets_of(members).join(dealt, "fp").select("fp", "root", "chunks", "own", "shingles"), "simhash-sets")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("fp")
        i, j = similar_links([np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()], similarity)
        return pa.table({"a": rows.column("fp").take(pa.array(i)), "b": rows.column("fp").take(pa.array(j))})

    def met(low: int) -> DataFrame:
        """Links between chunks that lie `low` to low + OFFSETS - 1 places apart, in a ring; two chunks lie at most half the ring apart."""
        apart = F.sequence(F.lit(low), F.least(F.lit(low + OFFSETS - 1), F.floor(F.col("chunks") / 2).cast("int")))
        others = F.array_distinct(F.flatten(F.transform(apart, lambda o: F.array(F.pmod(F.col("own") + o, F.col("chunks")), F.pmod(F.col("own") - o, F.col("chunks"))))))
        pairs = sets.where(F.col("chunks") >= 2 * low).withColumn("other", F.explode(others))
        pairs = pairs.withColumn("pair", F.least("own", "other").cast("long") * F.col("chunks") + F.greatest("own", "other"))
        return pairs.select("root", "pair", "fp", "shingles").groupBy("root", "pair").applyInArrow(run, "a binary, b binary")

    most = sets.agg(F.coalesce(F.max("chunks"), F.lit(1))).first()[0]
    found = [materialize(met(low), "simhash-met") for low in range(0, most // 2 + 1, OFFSETS)]  # one after the other: their shuffle files are never there together
    discard(sets)
    return reduce(DataFrame.unionByName, found)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, cell_rows: int, set_bytes: int) -> DataFrame:
    """(id, component_id), both of them structs as add_wide_fingerprints makes them."""
    prints = materialize(add_wide_fingerprints(docs, id_col, text_col, shingle, similarity), "simhash-wide")

    def links(distinct: DataFrame) -> DataFrame:
        longer = distinct.where(F.col("bytes") > 8 * SHORT)
        nominated = near_links(longer, PART_BUDGET, WIDE_WORDS, WIDE_PARTS, differing_bits(similarity), cell_rows)
        return verified_links(prints, nominated.unionByName(short_links(prints, similarity)), lambda members: shingle_sets(docs, text_col, shingle, members), similarity, set_bytes)

    return _classed(prints.select("id", "fp", "wide", "bytes"), links).select("id", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cell_rows: int = 200_000, set_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, component_id: documents whose sets of word shingles have this Jaccard similarity are linked."""
    joined = _similar(docs, id_col, text_col, shingle, similarity, cell_rows, set_bytes)
    return joined.select(F.col("id.id").alias(id_col), F.col("component_id.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cell_rows: int = 200_000, set_bytes: int = 8 << 20) -> DataFrame:
    """One document of each component stays: the one with the smallest id (of rows that share it, those that share the text too).

    Rows are dealt by id and text to meet the list of those that go; the same plan at any size."""
    found = materialize(_similar(docs, id_col, text_col, shingle, similarity, cell_rows, set_bytes), "simhash-result")
    going = found.where("id <> component_id").select(row_key(F.col("id.id"), F.col("id.text")).alias("key")).distinct()
    rows = whole_rows(docs, key=row_key(quoted(id_col), F.xxhash64(quoted(text_col))))
    return taken_apart(rows.join(materialize(going, "simhash-going").hint("shuffle_hash"), "key", "left_anti"), docs.columns)
