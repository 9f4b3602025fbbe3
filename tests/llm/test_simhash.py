import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.llm.common import maybe_among


def accept(a, budget):
    return lambda i, j: np.bitwise_count(a[i] ^ a[j]) <= budget


def pairs(a, budget, depth=0):
    out = set()
    for i, j in S.trie_pairs(a, [(0, len(a))], depth, budget, accept(a, budget)):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            assert (min(p, q), max(p, q)) not in out  # each pair once
            out.add((min(p, q), max(p, q)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 63), st.integers(0, 63)), max_size=60), st.integers(0, 6))
def test_trie_finds_all_pairs(base, flips, budget):
    values = {*base, *(base[k % len(base)] ^ (1 << a) ^ (1 << b) for k, a, b in flips)}
    a = np.array(sorted(values), np.uint64)
    brute = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= budget}
    assert pairs(a, budget) == brute


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_crowded_nodes_keep_components():
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 2, (300, 40))
    wide[:, 20:] = wide[0, 20:]
    near = lambda i, j: (wide[i] != wide[j]).sum(1) <= 4
    found = [(int(i), int(j)) for a, b in S._crowd(np.arange(300), np.arange(300), near) for i, j in zip(a, b, strict=True)]
    brute = [(i, j) for i in range(300) for j in range(i + 1, 300) if (wide[i] != wide[j]).sum() <= 4]
    assert components(300, found) == components(300, brute)
    forest = S.Forest(300)
    forest.join(*(np.array(x) for x in zip(*brute, strict=True)))
    forest.flatten()
    assert forest.parent.tolist() == components(300, brute)


def plain_fingerprint(text, shingle=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(n)]
    for _ in range(n // 2):
        copy = rng.choice(texts).split()
        if copy:
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    return [*texts, None, "", "  \t", "One", "ONE", "one two three", "w " * 30_000]


def test_fingerprints():
    for t in corpus(40):
        assert S.fingerprint(t)[0] == plain_fingerprint(t)


@pytest.mark.parametrize("cell_rows", [200_000, 3])
def test_components_against_brute_force(spark, cell_rows):
    rows = [(i * 3 % 1000 + 1, t, "x", "fp", 1) for i, t in enumerate(corpus())] + [(5000, "same text", "x", "fp", 1)] * 3 + [(None, "same text", "x", "fp", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, root long")
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    lowest = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    expected = sorted(((r[0], f"{p:016x}", lowest[g]) for r, p, g in zip(rows, prints, group, strict=True)), key=repr)
    assert sorted(map(tuple, S.simhash_components(df, cell_rows=cell_rows).collect()), key=repr) == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0 and S.drop_near_duplicates(df).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    originals = [rng.choices(vocabulary, k=200) for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(originals)]
    for k, words in enumerate(originals[:40]):
        copy = words.copy()
        for at in rng.sample(range(200), 2):
            copy[at] = "new"
        rows.append((1000 + k, " ".join(copy)))  # shares over 0.9 of the 5-word shingles
    for k, words in enumerate(originals[40:50]):
        rows.append((2000 + k, " ".join(words[:100] + rng.choices(vocabulary, k=100))))  # shares a third
    left = {r["doc_id"] for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= left and len([i for i in left if 1000 <= i < 2000]) <= 1 and len([i for i in left if i >= 2000]) == 10


def test_long_chain_is_one_component(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    roots = S.components(links).collect()
    assert {r["root"] for r in roots} == {0} and len(roots) == 300


@pytest.mark.parametrize("task_links", [1 << 20, 300, 20])  # one task, forests of parts first, star steps
def test_components_are_those_of_the_links_at_any_size(spark, task_links):
    rng = random.Random(5)
    nodes = [rng.randbytes(16) for _ in range(400)]
    links = [(0, k) for k in range(1, 200)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(k, (7 * k) % 200) for k in range(200)]
    place = sorted(range(400), key=nodes.__getitem__)
    rank = {k: at for at, k in enumerate(place)}
    group = components(400, [(rank[i], rank[j]) for i, j in links])
    expected = {(nodes[place[k]], nodes[place[g]]) for k, g in enumerate(group) if g != k}
    found = S.components(spark.createDataFrame([(nodes[i], nodes[j]) for i, j in links], "a binary, b binary").repartition(6), task_links=task_links).collect()
    assert len(found) == len(expected) and {(bytes(r["node"]), bytes(r["root"])) for r in found} == expected


def test_components_of_few_links_take_few_tasks(spark):
    """The driver keeps account of each task: star steps over 211 partitions took it beyond its memory."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-tasks", "components")
    try:
        S.components(spark.range(300).selectExpr("id AS a", "id + 1 AS b"), most_rounds=60).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < len(stages) <= 12


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("set_bytes", [8 << 20, 3000])
def test_links_are_those_of_the_shingle_sets(spark, set_bytes):
    """Documents that share a much repeated line stay; documents that differ in how often they repeat it do not."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    line = rng.choices(vocabulary, k=10)
    rows = [(k, " ".join(rng.choices(vocabulary, k=100) + line * 12)) for k in range(30)]
    for k in range(20):
        words = rng.choices(vocabulary, k=150)
        rows += [(100 + k, " ".join(words + line * 2)), (200 + k, " ".join(words + line * 30))]
    for k in range(40):
        words = rng.choices(vocabulary, k=8 + 5 * k)
        end = max(1, len(words) // rng.choice([8, 12, 20]))
        rows += [(300 + k, " ".join(words)), (400 + k, " ".join(words[:-end] + rng.choices(vocabulary, k=end)))]
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = components(len(rows), links)
    lowest = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df, set_bytes=set_bytes).collect()}
    assert len(links) > 40 and found == {r[0]: lowest[g] for r, g in zip(rows, group, strict=True)}


def test_recall_at_the_similarity(spark):
    """Of all pairs of given documents that share 0.8 of their shingles, found by an exact join of shingle sets, at least 0.9 end up in one class; no other classes are joined."""
    import collections
    import math

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [frozenset(shingle_set(r["text"] or "")) for r in rows]
    often = collections.Counter(x for s in set(sets) for x in s)
    seen, links, first = collections.defaultdict(list), [], {}
    for k, own in enumerate(sets):
        if own in first:
            links.append((first[own], k))
            continue
        first[own] = k
        rarest = sorted(own, key=lambda x: (often[x], x))[: len(own) - math.ceil(0.8 * len(own)) + 1]
        for j in {j for x in rarest for j in seen[x]}:
            if len(own & sets[j]) >= 0.8 * len(own | sets[j]):
                links.append((j, k))
        for x in rarest:
            seen[x].append(k)
    group = components(len(rows), links)
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()}
    near = [(i, j) for i, j in links if sets[i] != sets[j]]
    together = sum(found[rows[i]["doc_id"]] == found[rows[j]["doc_id"]] for i, j in near)
    assert len(near) > 30 and together >= 0.9 * len(near)
    classes = collections.defaultdict(set)
    for k, r in enumerate(rows):
        classes[found[r["doc_id"]]].add(group[k])
    apart = sum(len(c) > 1 for c in classes.values())
    print(f"{len(near)} pairs, {together} found, {apart} classes joined beyond")
    assert apart == 0


def test_unrelated_texts_are_not_nominated(spark, monkeypatch):
    """The bits that are compared are none of those that brought a pair together, so chance does not link texts (some thousands of links here if they overlap and texts of two shingles are among them)."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.getrandbits(32):x}" for _ in range(6 if k % 10 == 0 else 30))) for k in range(20_000)]
    counts, whole = [], S.components
    monkeypatch.setattr(S, "components", lambda links: counts.append(links.count()) or whole(links))
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counts[0] <= 3 and all(r["doc_id"] == r["component_id"] for r in found)


def test_large_groups_are_compared_in_passes(spark, monkeypatch):
    """A group of many chunks is compared in several passes over one table of its sets, and the classes are those of the group in one chunk."""
    rng = random.Random(6)
    base = [f"{rng.getrandbits(32):x}" for _ in range(200)]
    rows = []
    for k in range(300):
        words = base.copy()
        for at in rng.sample(range(200), 6):
            words[at] = f"{rng.getrandbits(32):x}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent, write = [], S.materialize

    def counted(table, label, *more):
        back = write(table, label, *more)
        if label == "simhash-sets":
            sent.append(back.count())
        if label == "simhash-met":
            sent.append(label)
        return back

    classes = sorted(map(tuple, S.near_duplicates(df).collect()))
    monkeypatch.setattr(S, "materialize", counted)
    assert sorted(map(tuple, S.near_duplicates(df, set_bytes=20_000).collect())) == classes
    assert sent[0] <= 300 and sent[1:].count("simhash-met") > 1  # about 24 chunks in more than one pass


def test_maybe_among_leaves_no_wanted_row_out(spark):
    rows, wanted = spark.range(3000).selectExpr("id", "xxhash64(id) AS h"), spark.range(0, 3000, 7).selectExpr("xxhash64(id) AS h")
    exact = set(range(0, 3000, 7))
    for bits, most in ((1 << 25, 2), (64, 3000)):
        found = {r["id"] for r in maybe_among(rows, F.col("h"), wanted, "h", bits).collect()}
        assert exact <= found and len(found - exact) <= most
    assert maybe_among(rows, F.col("h"), wanted.limit(0), "h").count() == 0
