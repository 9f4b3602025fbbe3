"""Toxicity and decontamination, and the pipeline."""

import binascii
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm import toxicity as T
from tidemark.llm.packing import LETTERS, WordHasher, as_hashes, lower_bytes, squeeze


@pytest.mark.parametrize("seed", range(8))
def test_index_is_exact(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 300))
    dense = np.zeros((n, 40))
    for k in range(n):
        terms = rng.choice(40, rng.integers(1, 8), replace=False)
        dense[k, terms] = rng.choice([0.5, 1.0, 2.0], len(terms))  # many ties
        dense[k] = (dense[k] / np.linalg.norm(dense[k])).astype(np.float32)
    example, term = np.nonzero(dense)
    index = T.BlockMaxIndex(example, term, dense[example, term], 40, n, block=16)
    for _ in range(30):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        weights = rng.random(len(terms))
        cosine = np.round(dense[:, terms] @ weights, 9)
        brute = sorted((-c, k) for k, c in enumerate(cosine) if c > 0)[:7]
        found = index.nearest(terms, weights, 7)
        assert [k for _, k in found] == [k for _, k in brute] and np.allclose([s for s, _ in found], [-c for c, _ in brute])


def plain_toxicity(rows, labels, k=16, emphasis=5.0, pseudo=20.0):
    """Scores by the definition, with dictionaries and all cosines: shares no code with the operator. One example per label."""
    def terms(text):
        words = [w.encode() for w in re.findall(r"[\w\x80-\uffff]+", (text or "").lower())]
        found = {}
        for t in [("w", w) for w in words] + [(n, w[:n]) for n in (4, 6) for w in words if len(w) > n]:
            found[t] = found.get(t, 0) + 1
        return found

    counts = [terms(t) for _, t, *_ in rows]
    text_of = {i: c for (i, *_), c in zip(rows, counts, strict=True)}
    told = [(i, y) for i, _, y in labels if binascii.crc32(str(i).encode()) % 4 != 2]
    of_class = [sum(y == c for _, y in told) for c in (0, 1)]
    examples = sorted((i, y) for i, y in told if i in text_of)
    stands = [of_class[c] / max(1, sum(y == c for _, y in examples)) for c in (0, 1)]
    share = of_class[1] / sum(of_class)
    documents = {}
    for c in counts:
        for t in c:
            documents[t] = documents.get(t, 0) + 1
    held = {}
    for i, y in examples:
        for t in text_of[i]:
            held.setdefault(t, [0.0, 0.0])[y] += stands[y]
    weight = {}
    for t, (clean, toxic) in held.items():
        mark = max(0.0, ((toxic + pseudo * share) / (clean + toxic + pseudo) - share) / (1 - share))
        weight[t] = math.log((1 + len(rows)) / (0.5 + documents[t])) * (1 + emphasis * mark)

    def vector(c):
        raw = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    vectors = [(vector(text_of[i]), y) for i, y in examples]
    out = []
    for c in counts:
        mine = vector(c)
        near = sorted(((sum(w * v.get(t, 0.0) for t, w in mine.items()), y) for v, y in vectors), reverse=True)[:k]
        near = [(s, y) for s, y in near if s > 0]
        votes = [s * s * stands[y] / max(stands) for s, y in near]
        prior = 0.05 * min(stands) / max(stands)
        out.append((sum(v for v, (_, y) in zip(votes, near, strict=True) if y) + prior * share) / (sum(votes) + prior) if near else share)
    return out


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Scumbag,", "nastyness", "NASTYLY", "zounds!"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (9003, "scumbag " * 50_000, "x"), (1, "twice", "x"), (None, "scumbag", "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, id string")
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(docs, marks, T.training_fold())
    found = T.toxicity_scores(docs, model).collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: y for i, _, y in labels}
    held = [r for r in found if r["doc_id"] in truth and binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    by = {r["doc_id"]: r for r in found}
    assert by[9003]["predicted"] == 1 and by[9003]["near_ids"] and by[9001]["predicted"] == by[9002]["predicted"] == 0
    left = T.drop_toxic(docs, marks)
    assert left.columns == docs.columns and sorted(map(repr, [r["doc_id"] for r in left.collect()])) == sorted(map(repr, [r["doc_id"] for r in found if not r["predicted"]]))


def test_toxicity_scores_are_those_of_all_cosines(spark):
    rows, labels = toxic_corpus(260, seed=9)
    rows += [(900, None, ""), (901, "", ""), (902, "ZZZZZ qqqqq", ""), (903, "scumbag, " * 3000, ""), (904, "Ünïcode nastily", "")]
    found = {r["doc_id"]: r for r in T.toxicity_scores(*(lambda d: (d, T.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), T.training_fold())))(spark.createDataFrame(rows, "doc_id long, text string, t string"))).collect()}
    for (i, *_), score in zip(rows, plain_toxicity(rows, labels), strict=True):
        assert found[i]["score"] == pytest.approx(score, abs=2e-4), i


def test_toxicity_of_the_given_documents(spark):
    """Held-out rows of a given table: nearly all texts have neighbours, the verdicts are right, and scores are calibrated."""
    from tidemark.llm.queries import op2_toxicity

    found = op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").toPandas()
    assert len(found) == 10_000 and (found.near_ids.str.len() > 0).mean() > 0.99
    held = found[found.held_out & found.toxic.notna()]
    assert held.predicted[held.toxic == 1].mean() > 0.9 and held.predicted[held.toxic == 0].mean() < 0.03
    tenth = (held.score * 10).clip(upper=9).astype(int)
    error = sum(abs(g.score.mean() - g.toxic.mean()) * len(g) for _, g in held.groupby(tenth)) / len(held)
    assert error < 0.03 and ((held.score - held.toxic) ** 2).mean() < 0.02


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.toxicity_scores(docs, T.fit(docs, none, F.lit(True))).first()["score"] == 0
    assert T.toxicity_scores(docs, T.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(True))).first()["predicted"] == 0
    both = T.fit(docs.limit(0), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), F.lit(True))
    assert T.toxicity_scores(docs.limit(0), both).count() == 0


# ---- decontamination


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.lists(st.integers(0, 5), max_size=60))
def test_lcs(pattern, text):
    best = [0] * (len(pattern) + 1)
    for w in text:
        previous = best.copy()
        for i, p in enumerate(pattern):
            best[i + 1] = previous[i] + 1 if p == w else max(best[i], previous[i + 1])
    assert D.lcs_length(D.masks_of(pattern), len(pattern), text) == best[-1]


def prose(seed, n_docs, n_items):
    rng = random.Random(seed)
    rare = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    common = ["the", "of", "and", "to", "in", "is", "a"]
    words = lambda k: [rng.choice(common) if rng.random() < 0.35 else rng.choice(rare) for _ in range(k)]
    items = [words(rng.choice([12, 20, 35, 60, 150])) for _ in range(n_items)]
    docs, truth = [], []
    for d in range(n_docs):
        text, held = words(rng.choice([0, 3, 60, 400, 1500])), None
        if d % 3 == 0:
            held = rng.randrange(n_items)
            item = items[held].copy()
            if d % 2:  # a paraphrase: a few words replaced, none of the last ones
                for at in rng.sample(range(len(item) * 3 // 4), len(item) // 8):
                    item[at] = rng.choice(rare)
            at = rng.randint(0, len(text))
            text = text[:at] + item + text[at:]
        docs.append((d, " ".join(text).capitalize() + "."))
        truth.append(held)
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], truth


def test_contamination(spark):
    docs, items, truth = prose(4, 240, 40)
    extra = [(900, None), (901, ""), (None, items[3][1].upper()), (5, "5 again"), (902, "the of and " * 20_000)]
    df = spark.createDataFrame([(*r, "c") for r in docs + extra], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*items, (77, None), (78, "too short"), (79, "")], "item_id long, text string")
    found = [(r["doc_id"], r["items"]) for r in D.contaminated(df, bench).collect()]
    assert len(found) == len(docs) + len(extra)
    by = dict(x for x in found if x[0] not in (5, None))
    for (d, _), held in zip(docs, truth, strict=True):
        if d != 5:
            assert by[d] == ([] if held is None else [held]), d
    assert by[900] == by[901] == by[902] == [] and (None, [3]) in found
    left = D.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, i in found if not i)
    in_parts = {(r["doc_id"], tuple(r["items"])) for r in D.contaminated(df, bench, max_items=12).collect()}
    assert in_parts == {(d, tuple(i)) for d, i in found}
    assert sorted(r["doc_id"] for r in D.drop_contaminated(df, bench, max_items=12).collect()) == sorted(d for d, i in found if not i)
    assert D.contaminated(df, bench.limit(0)).where("contaminated").count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def test_short_items_and_tails(spark):
    """Items of fewer than eight words are matched exactly, next to their answer if they have one; long items have no tail that is left out."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(260)]
    items = [(1, "Who wrote Hamlet?", None), (2, "capital of France", "Paris"), (3, " ".join(long), None), (4, "one two three four five six seven", None), (5, "capital of France", None)]
    texts = ["well: who wrote hamlet, then", "who then wrote hamlet", "Paris is the capital of France", "capital of France it is", " ".join(long[140:]), " ".join(long[245:]), "x one two three four five six", "one two three FOUR five six seven", "who wrote", "hamlet who", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = {r["doc_id"]: (r["items"], r["overlap"]) for r in D.contaminated(df, bench, answer_col="answer").collect()}
    assert {d: i for d, (i, _) in found.items()} == {0: [1], 1: [], 2: [2, 5], 3: [5], 4: [3], 5: [], 6: [], 7: [4], 8: [], 9: [], 10: []}
    assert found[0][1] == 1.0 and found[4][1] >= 0.9
    assert {r["doc_id"] for r in D.drop_contaminated(df, bench, answer_col="answer").collect()} == {1, 5, 6, 8, 9, 10}


def test_overlap_is_the_largest_share(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(900)]
    item = rng.choices(vocabulary, k=40)
    near = [w if k != 5 else "other" for k, w in enumerate(item)]
    texts = [" ".join(near + rng.choices(vocabulary, k=300) + item), " ".join(rng.choices(vocabulary, k=90) + near)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"]: r["overlap"] for r in D.contaminated(df, bench).collect()} == {0: 1.0, 1: 39 / 40}


def test_cosine_search_recall(spark):
    """Of all windows, those nearest to an item by full TF-IDF cosine must be among the candidates of the latent search."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    bench = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").column("text").to_pylist()
    dims, hasher = 1 << 13, WordHasher(LETTERS)
    lengths, hashes = hasher([lower_bytes(t) for t in texts])
    group = D.Packed({"ids": list(range(len(texts))), "lengths": squeeze(lengths.astype(np.int32)), **as_hashes(hashes)}, dims)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = D.pack_documents(df, "doc_id", "text", "recall", LETTERS, lower_bytes, as_hashes)
    basis = D.latent_basis(packed, 96, dims, 50_000)
    items, _ = D.item_parts([(t, None) for t in bench], 8)
    frequency, passages = D._frequencies(packed, dims)
    idf = np.log((1 + passages) / (1 + frequency)) + 1e-3
    blocks = np.zeros((group.n_blocks + 1, basis.shape[1]))
    np.cumsum(group.block_sums(basis), axis=0, dtype=np.float64, out=blocks[1:])
    found = {(k, int(b)) for k, begin, _ in D.candidates(group, blocks, items, D.latent_items(items, basis), 0.55) for b in begin}
    wanted = hit = 0
    for k, item in enumerate(items):
        weight = np.bincount(item.words & np.uint32(dims - 1), minlength=dims) * idf
        for _, begin, end in D.candidates(group, blocks, [item], np.zeros((1, basis.shape[1]), np.float32), -1.0):  # all its windows
            for b, e in zip(begin, end, strict=True):
                own = np.bincount(group.dims[b:e], minlength=dims) * idf if e - b > 8 else None
                if own is not None and weight @ own >= 0.6 * np.linalg.norm(weight) * np.linalg.norm(own):
                    wanted += 1
                    hit += (k, int(b)) in found
    assert wanted > 20 and hit / wanted >= 0.9


def test_basis_of_all_passages(spark, monkeypatch):
    """Of any number of passages, all enter the basis: X'X O by the definition, a word at a time."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for _ in range(50_500)]
    texts += [" ".join(rng.choices(vocabulary[:40] if n % 2 else vocabulary, k=n)) for n in (63, 64, 65, 200, 1001)] + ["the " * 300, "", None]
    seen, sketch = [], D._sketch

    def spy(packed, idf, omega, *more):
        seen.append((idf, omega, sketch(packed, idf, omega, *more)))
        return seen[-1][2]

    monkeypatch.setattr(D, "_sketch", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    D.contaminated(df, spark.createDataFrame([(1, texts[50_500])], "item_id long, text string"))
    (idf, omega, found), hasher = seen[0], WordHasher(LETTERS)
    term = {w: int(hasher([w.encode()])[1][0]) % len(idf) for w in [*vocabulary, "the"]}
    words = [[term[w] for w in (t or "").split()] for t in texts]
    passages = [x[at : at + 64] for x in words for at in range(0, len(x), 64)]
    assert len(passages) > 50_000
    expected, held = np.zeros(omega.shape), np.zeros(len(idf))
    for p in passages:
        row = {t: p.count(t) * idf[t] for t in set(p)}
        held[list(row)] += 1
        along = sum(v * omega[t] for t, v in row.items()) / sum(v * v for v in row.values())
        for t, v in row.items():
            expected[t] += v * along
    assert np.allclose(idf, np.log((1 + len(passages)) / (1 + held)) + 1e-3)
    assert np.allclose(found, expected, rtol=1e-4, atol=1e-4 * np.abs(expected).max())


def test_paraphrases_against_brute_force(spark):
    """Items with up to 40 % of their words replaced: all that the subsequence and answer checks accept anywhere are found."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    items = [rng.choices(vocabulary, k=rng.choice([8, 9, 10, 16, 24, 40, 100])) for _ in range(60)]
    docs = []
    for d in range(240):
        item = items[d % 60].copy()
        body = len(item) * 4 // 5
        for at in rng.sample(range(body), min(body, int(len(item) * rng.choice([0, 0.125, 0.25, 0.35, 0.4])))):
            item[at] = rng.choice(vocabulary)
        at, text = rng.randint(0, 60), rng.choices(vocabulary, k=rng.choice([60, 200]))
        docs.append(text[:at] + item + text[at:])
    expected = {}
    for d, words in enumerate(docs):
        for k, item in enumerate(items):
            masks, told = D.masks_of(item), item[-max(3, len(item) // 5) :]
            size = next(c for c in D.CLASSES if c >= len(item))
            for low in range(0, len(words), size // 2):
                region = words[low : low + size * 5 // 2]
                share = D.lcs_length(masks, len(item), region) / len(item)
                if share >= 0.9 or share >= 0.6 and D.lcs_length(D.masks_of(told), len(told), region) >= 0.6 * len(told):
                    expected.setdefault(d, set()).add(k)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {r["doc_id"]: set(r["items"]) for r in D.contaminated(df, bench).collect() if r["items"]}
    assert len(expected) > 220 and found == expected


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    after = {}
    frame = docs
    for name, stage in P.STAGES:
        frame = P.materialize(stage(spark, frame, "/root/testdata/sf0.001"), name)
        after[name] = {r["doc_id"]: r for r in frame.collect()}
        assert name == "mix" or frame.columns == docs.columns
    kept = after["toxicity"]
    smallest = {}
    for i in sorted(kept):
        smallest.setdefault(lower(kept[i]["text"]), i)
    assert set(after["exact_dedup"]) == set(smallest.values())
    squash = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    bench = [squash(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    held = {i for i, r in after["simhash_near_dedup"].items() if any(b in squash(r["text"]) for b in bench)}
    assert set(after["simhash_near_dedup"]) - set(after["decontaminate"]) == held
    last = after["mix"]
    assert set(last) <= set(after["decontaminate"]) and all(0 < r["mix_taken"] <= 3 * r["mix_size"] for r in last.values())
    assert {r["doc_id"] for r in P.run(spark, "/root/testdata/sf0.001").collect()} == set(last) and len(rows) > len(last)


@pytest.mark.parametrize("stretch", [7, 1024])
def test_windows_in_stretches_are_all_windows(monkeypatch, stretch):
    """Windows made a stretch of blocks at a time are those of sums over each window, for all classes, at the ends of texts and beside empty texts."""
    monkeypatch.setattr(D, "STRETCH", stretch)
    monkeypatch.setattr(D, "COSINES", 3 * stretch)
    rng = np.random.default_rng(3)
    lengths = np.array([0, 3, 700, 0, 0, 8, 129, 64, 1, 0], np.int32)
    tokens = rng.integers(0, 1 << 32, lengths.sum(), dtype=np.uint32)
    group = D.Packed({"ids": range(len(lengths)), "lengths": squeeze(lengths), "tokens": squeeze(tokens)}, 256)
    basis = rng.standard_normal((256, 12)).astype(np.float32)
    items = [D.Item(k, tokens[at : at + n], tokens[:0]) for k, (at, n) in enumerate([(3, 16), (90, 23), (200, 32), (300, 48), (711, 60), (400, 90), (711, 128), (5, 15), (40, 16), (60, 16)])]
    vectors = D.latent_items(items, basis)
    found = {(k, b, e) for k, begin, end in D.near_windows(group, group.block_sums(basis), items, vectors, 0.3) for b, e in zip(begin.tolist(), end.tolist(), strict=True)}
    expected = set()
    for k, item in enumerate(items):
        step = max(1, item.window // 4 // D.BLOCK) * D.BLOCK
        for start, stop in zip(group.start.tolist(), group.end.tolist(), strict=True):
            for b in range(start, stop, step):
                e = min(b + item.window, stop)
                v = basis[tokens[b:e] & 255].sum(0)
                if (b == start or -(-(stop - start) // D.BLOCK) * D.BLOCK > b - start - step + item.window) and v @ vectors[k] >= 0.3 * np.linalg.norm(v):
                    expected.add((k, b, e))
    assert found == expected and {k for k, _, _ in found} == set(range(len(items)))
