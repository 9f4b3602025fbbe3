"""Personal data, chat, language model, secrets."""

import binascii
import collections
import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, ngram_lm, pii, secret_scan
from tidemark.llm.packing import LETTERS, SPACED, WordHasher, ascii_lower_bytes, lower_bytes

# ---- personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and luhn) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+0123 9()_%é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


CASES = ["x@y.z@w.v", "a@b@c.d", "@a.b", "a@b.", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (017) 555-7713", "+1 (017) 555-7713 4111111111111111", "+49-30-1234567.", "9" * 30]


@pytest.mark.parametrize("text", CASES)
def test_base_cases(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_quick():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(t)


def test_revealing_terms(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, f"{word()} zorblatt {word()} jo@example.com the {word()}") for i in range(8)]
    rows += [(2000 + i, f"{word()} the {word()}") for i in range(300)]
    rows += [(3000 + i, "same copied words near ann@example.com always") for i in range(9)]  # one surrounding
    rows += [(1, None), (1, ""), (None, "x 10.0.0.1")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, base string")
    found = pii.find_pii(df).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    added = [(r["doc_id"], s) for r in found for s in r["added"]]
    assert {texts[i][s["start"] : s["end"]] for i, s in added} == {"zorblatt"} and len(added) == 8 and {s["kind"] for _, s in added} == {"remove"}
    spans = [(s["kind"], s["start"], s["end"]) for r in found if r["doc_id"] == 1000 for s in [*r["base"], *r["added"]]]
    clean = pii.sanitise(texts[1000], spans)
    assert "[EMAIL]" in clean and "zorblatt" not in clean and "the" in clean
    assert pii.find_pii(df.limit(0)).count() == 0
    text = df.where("doc_id = 1000").select(pii.span_digest(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in (("card", 2, 9), ("email", 2, 5), ("ip", 0, 1))])).alias("d")).first()["d"]
    assert text == "ip:0:1,email:2:5,card:2:9"


def plain_added(rows, window=10, support=3):
    """Terms that disclose an entity, by their definition over all texts: (row, start, end, kind)."""
    word, kinds = re.compile(r"[^\W\d_]{2,}"), pii.KINDS
    near, together, around, held = [], collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for k, text in enumerate(rows):
        spans = plain_spans(text)
        words = [m for m in word.finditer(text) if True]
        for a, kind, b in spans:
            value = text[a:b]
            entity = kinds[kind] + ":" + (value.lower() if kind == 0 else ".".join(str(int(x)) for x in value.split(".")) if kind == 1 else re.sub("[^0-9]", "", value))
            held[entity].add(k)
            close = [m for m in words if m.end() <= a][-window:] + [m for m in words if m.start() >= b][:window]
            close = [m for m in close if not any(x < m.end() and m.start() < y for x, _, y in spans)]
            around_all = " ".join(m[0].lower() for m in close)
            for m in close:
                near.append((k, m[0].lower(), entity, m.start(), m.end(), around_all))
    first = {}
    for k, term, entity, _, _, text in near:
        first.setdefault((term, entity, k), set()).add(text)
    for (term, entity, _), texts in first.items():
        together[term, entity] += 1
        around[term, entity] |= texts
    documents = collections.Counter(t for text in rows for t in {x.lower() for x in word.findall(text)})
    told = {}
    for (term, entity), n in together.items():
        if len(around[term, entity]) >= support and len(held[entity]) < len(rows):
            p = len(held[entity]) / len(rows)
            share = max(0.0, math.log2(min(1.0, n / documents[term]) / p)) / -math.log2(p)
            if share >= 0.8:
                told[term, entity] = "remove" if share >= 0.95 else "generalise"
    added = {}
    for k, term, entity, a, b, _ in near:
        if (term, entity) in told:
            added[k, a, b] = max(added.get((k, a, b), ""), told[term, entity])
    return {(*key, kind) for key, kind in added.items()}


def test_added_spans_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    people = [f"p{k}@example.com" for k in range(12)] + ["10.1.2.3", "+49 30 1234567"]
    rows = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for k in range(160):
        who = rng.randrange(len(people))
        gap = " " * rng.choice([1, 1, 400])
        clue = f"nick{'abcdefghijklmnop'[who]}" if rng.random() < 0.8 else "manager"
        rows.append(f"{word()} {word()}{gap}{clue} {'x' * rng.choice([3, 300])} {people[who]} of {word()} {word()}" + (f" {people[(who + 1) % 12]}" if k % 9 == 0 else ""))
    rows += [f"{word()} nicka {word()}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r["doc_id"], s["start"], s["end"], s["kind"]) for r in pii.find_pii(df).collect() for s in r["added"]}
    expected = plain_added(rows)
    assert len(expected) > 60 and {kind for *_, kind in expected} == {"remove", "generalise"} and found == expected


def test_terms_that_lower_case_alone_and_in_text_differ(spark):
    """A capital dotted I becomes two characters, a capital sigma depends on what follows the word."""
    rows = [f"plain{'abcdef'[k]} text" for k in range(6)]
    rows += [f"{'uvwxyz'[k]}nearby {name} a@example.com" for k in range(6) for name in ("\u0130zzet", "\u039d\u0399\u039a\u039f\u03a3'\u0391")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r["doc_id"], s["start"], s["end"], s["kind"]) for r in pii.find_pii(df).collect() for s in r["added"]}
    assert found == plain_added(rows, 10, 3)
    told = {rows[k][a:b] for k, a, b, _ in found}
    assert {"\u0130zzet", "\u039d\u0399\u039a\u039f\u03a3"} <= told


# ---- chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\<>/turn ü\n:#a0", max_size=30), st.text(alphabet="\\<>/turn ü\n:#a0", max_size=10))
def test_turns_round_trip(text, role):
    segment, start, end, _ = chat.format_turn(role, text)
    assert chat.read_turn(segment) == (role, text) and chat.body_text(segment[start:end]) == text
    assert segment.count("</turn>") == 1


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <image 9>"}, {"type": "image", "url": "a.png", "width": 56, "height": 57}, {"type": "audio", "ref": "b.wav", "seconds": 2.01},
        {"type": "document", "ref": "c.pdf", "parts": [{"type": "text", "text": "inner"}, {"type": "image", "ref": "d"}]}, {"type": "document", "pages": 3}, {"type": "hologram"}, "end", None, 7,
    ]
    segment, _, _, attachments = chat.format_turn("user", None, parts)
    assert segment == "<turn user>see \\<image 9\\><image 0><audio 1><document 2>inner<image 3><document 4><other 5>end7</turn>\n"
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in attachments] == [(0, "image", "a.png", 6), (1, "audio", "b.wav", 51), (2, "document", "c.pdf", 0), (3, "image", "d", 1), (4, "document", None, 1536), (5, "other", None, 0)]
    assert chat.read_turn(segment) == ("user", "see <image 9>innerend7")


@pytest.mark.parametrize("raw", ["[" * 100_000, '{"type":"image","width":1e300,"height":1e300}', '["\\ud800 x"]', '{"type":"\\ud800"}', '{"type":["a"],"ref":{"x":"\\udfff"}}', "1" * 5000, "true", '{"type":"document","parts":' * 400 + "1" + "}" * 400, '{"type":"text","text":' * 900 + '"in"' + "}" * 900])
def test_odd_parts(spark, raw):
    df = spark.createDataFrame([(1, 0, "user", "t", raw)], "conv_id long, turn long, role string, text string, parts string")
    row = chat.format_turns(df, parts_col="parts").first()
    assert row["segment"].startswith("<turn user>t") and row["attachment_tokens"] >= 0
    assert chat.read_turn(row["segment"])[1].startswith("t")


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b", None), (1, 1, "user", "a", None), (1, 2, "assistant", "b", None), (2, None, None, None, None), (None, 0, "assistant", "x" * 200_000, None), (3, 0, "assistant", "t", json.dumps([{"type": "image", "ref": "r"}])), (4, 0, "user", "", "not json")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    turns = chat.format_turns(df, parts_col="parts")
    whole = {r["conv"]: r for r in chat.read_back(turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert whole[1]["turns_sha256"] == sha("user\na\nassistant\nb\nassistant\nb\n") and whole[1]["n_turns"] == 3 and whole[1]["loss_sha256"] == sha("bb")
    assert whole[2]["turns_sha256"] == sha("\n\n") and whole[None]["loss_chars"] == 200_000 and whole[3]["loss_sha256"] == sha("t")
    assert whole[1]["formatted_chars"] == sum(len(chat.format_turn(r[2], r[3])[0]) for r in rows if r[0] == 1)
    assert turns.where("conv = 3").first()["attachments"][0]["ref"] == "r" and whole[4]["turns_sha256"] == sha("user\nnot json\n")
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# ---- language model


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé \t\n\x0b\x1c\x00.,_", max_size=30), max_size=8))
def test_word_hashes(texts):
    for table, bytes_of, words_of in ((SPACED, ascii_lower_bytes, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))), (LETTERS, lower_bytes, lambda t: re.findall(r"[\w\x80-\uffff]+", t.lower()))):
        counts, hashes = WordHasher(table)([bytes_of(t) for t in texts])
        words = [words_of(t) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def plain_scores(rows, fold):
    """The model by its definition, with dictionaries and floats: shares no code with the operator."""
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for _, t in rows]
    train = [binascii.crc32(str("" if i is None else i).encode()) % 5 != fold for i, _ in rows]
    steps = [list(zip([0, *words[:-1]], words, strict=True)) for words in texts]
    word = collections.Counter(w for words, t in zip(texts, train, strict=True) if t for w in words)
    pair = collections.Counter(s for own, t in zip(steps, train, strict=True) if t for s in own)
    before = collections.Counter(u for own, t in zip(steps, train, strict=True) if t for u, _ in own)
    n, v = sum(word.values()), len(word)
    bucket = lambda count: int(math.log2(count)) + 1 if count else 0
    events = collections.defaultdict(list)
    for own, t in zip(steps, train, strict=True):
        for u, w in own if t else ():
            left = before[u] - 1
            events[bucket(left)].append(((pair[u, w] - 1) / left if left else 0.0, (word[w] - 1) / (n - 1), 1 / (v + 1)))

    def fitted(shares):
        weights = [1 / 3] * 3
        for _ in range(60):
            sums = [0.0] * 3
            for x in shares:
                parts = [a * b for a, b in zip(weights, x, strict=True)]
                for k in range(3):
                    sums[k] += parts[k] / sum(parts)
            weights = [x / len(shares) for x in sums]
            weights[2] = max(weights[2], 1e-6)
            weights = [x / sum(weights) for x in weights]
        return weights

    overall = fitted([x for of in events.values() for x in of])
    weights = {b: fitted(of) for b, of in events.items()}
    none = weights.get(0, overall)
    weights[0] = [0.0, none[1] / (none[1] + none[2]), none[2] / (none[1] + none[2])]
    out = []
    for (i, _), words, own, t in zip(rows, texts, steps, train, strict=True):
        base = sum(math.log10((word[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = 0.0
        for u, w in own:
            a, b, c = weights.get(bucket(before[u]), overall)
            score += math.log10(a * (pair[u, w] / before[u] if before[u] else 0) + b * word[w] / n + c / (v + 1))
        out.append((i, not t, len(words), sum(word[w] > 0 for w in words), n, base, score))
    return out


def test_language_model_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % int(rng.expovariate(0.05)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)] + [(150, None), (151, ""), (1, "W1 w1"), (None, "w2 w3"), (152, "unseen words " * 3000)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, score int, group string").repartition(5)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    expected = plain_scores(rows, 1)
    for sizes in ({}, {"group_bytes": 500, "slice_keys": 300}):
        found = [tuple(r)[:7] for r in ngram_lm.lm_scores(df, training, **sizes).collect()]
        for a, b in zip(sorted(found, key=repr), sorted(expected, key=repr), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=3e-3)  # the weights are fitted on a histogram
    held = [r for r in expected if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base on held-out texts


def test_pieces_bring_totals_back_in_order():
    rng = np.random.default_rng(5)
    for bits, keys in ((64, rng.integers(0, 2**64, 5000, np.uint64)), (40, rng.integers(0, 2**64, 5000, np.uint64)), (64, np.empty(0, np.uint64))):
        exchange = ngram_lm.Exchange("pair", len(keys), 700, bits)
        counts = rng.integers(0, 1000, len(keys))
        pieces = exchange.pieces(keys, counts)
        shifted = np.concatenate([np.cumsum(ngram_lm.unsqueeze_planes(k, np.uint64), dtype=np.uint64) for _, k, _ in pieces] or [keys])
        assert np.array_equal(shifted, np.sort(keys) >> np.uint64(64 - bits))
        back = {s: ngram_lm.squeeze_planes(ngram_lm.unsqueeze_planes(n, np.uint32).astype(np.uint64)) for s, _, n in pieces}
        assert len(back) <= exchange.n_slices and (not len(keys) or np.array_equal(exchange.totals_of(keys, back), counts))


def test_language_model_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ngram_lm.lm_scores(df.limit(0), F.lit(True)).count() == 0
    untrained = ngram_lm.lm_scores(df, F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in untrained] == [(0, 0, 0, 0)] * 2


def test_mixture_is_a_distribution():
    rng = np.random.default_rng(1)
    bucket, two, one = rng.integers(0, 6, 500), rng.random(500) * rng.integers(0, 2, 500), rng.random(500) * 0.01
    w = ngram_lm.fit_weights(bucket, two, one, np.ones(500), 1e-4)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0 and (w[:, 2] > 0).all()


# ---- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train_forest(secret_scan.labelled_findings(spark, 3000))


def test_held_out_findings(spark, forest):
    from pyspark.ml.feature import VectorAssembler

    other = secret_scan.labelled_findings(spark, 1500, seed=99)
    rows = forest.transform(VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(secret_scan.add_features(other))).select("label", "prediction").collect()
    assert sum(r["label"] == r["prediction"] for r in rows) / len(rows) > 0.97


def test_findings_of_other_templates(spark):
    """Trained on one half of the templates, names and words, judged on the other half."""
    from pyspark.ml.feature import VectorAssembler

    right = []
    for part in (0, 1):
        forest = secret_scan.train_forest(secret_scan.labelled_findings(spark, 3000, part=part))
        other = secret_scan.add_features(secret_scan.labelled_findings(spark, 1500, seed=99, part=1 - part))
        rows = forest.transform(VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(other)).select("label", "prediction").collect()
        of_class = [[r["prediction"] == c for r in rows if r["label"] == c] for c in (0, 1)]
        right.append(sum(sum(x) / len(x) for x in of_class) / 2)  # 0.5 is chance, whatever the classes' shares
    print(right)
    assert min(right) > 0.5


def test_words_behind_a_candidate_count(spark, forest):
    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    df = spark.createDataFrame([(1, f"the {key} is the commit"), (2, f'token = "{key}"')], "doc_id long, text string")
    told = {r["id"]: (r["after_other"], r["closed"]) for r in secret_scan.add_features(secret_scan.candidates(df, "doc_id", "text")).collect()}
    assert told == {1: (1.0, 0.0), 2: (0.0, 1.0)}
    assert {r["doc_id"]: r["secret"] for r in secret_scan.scan_secrets(df, forest).collect()} == {1: False, 2: True}


def test_candidates_against_brute_force(spark):
    texts = [None, "", 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" x', "a" * 200_000, "0123456789abcdef" * 3 + " y " + "0123456789ABCDEF==", "password: correcthorsebatterystaple", "é0123456789abcdefé", "x" * 15 + "1", "1" * 15]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, value string")
    found = {(r["id"], r["finding"]): (r["value"], r["before"], r["after"]) for r in secret_scan.candidates(df, "doc_id", "text").collect()}
    expected = {}
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(secret_scan.CANDIDATE, t or "")]
        for k, (low, high) in enumerate(spans):
            before = t[spans[k - 1][1] if k else 0 : low][-48:]
            after = t[high : spans[k + 1][0] if k + 1 < len(spans) else len(t)][:24]
            if re.search("[0-9]", t[low:high]) or re.search(secret_scan.SECRET_WORDS + r"\W{0,4}$", before.lower()):
                expected[i, k] = (t[low:high], before, after)
    assert found == expected


def test_verdicts(spark, forest):
    rows = [(1, 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', None), (2, "commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", None), (3, "card 4952935900253052 end", None), (4, "TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!!", None), (5, "id 123e4567-e89b-12d3-a456-426614174000", None), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    verdict = {r["doc_id"]: r["secret"] for r in secret_scan.scan_secrets(df, forest, path_col="path").collect()}
    assert verdict == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert secret_scan.scan_secrets(df.limit(0), forest).count() == 0


def test_key_names_are_context_and_no_candidates(spark, forest):
    key, mixed, words = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ84LpT2sV", "wJalrXUtnFEMIxKrMDENGobPxRfiCYzQ"
    rows = [(1, f'GOOGLE_CLIENT_SECRET="{key}"'), (2, f"AWS_SECRET_ACCESS_KEY={mixed}"), (3, f"service_2_password_prod: {words}"), (4, f"commit {key}"), (5, f'token2 = "{mixed}", "{key}"'), (6, f"{key}: wrong checksum"), (7, "token = 0123456789abcdef==")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["id"], r["finding"]): (r["value"], r["context"]) for r in secret_scan.candidates(df, "doc_id", "text").collect()}
    assert {k: v for k, (v, _) in found.items()} == {(1, 0): key, (2, 0): mixed, (3, 0): words, (4, 0): key, (5, 0): mixed, (5, 1): key, (6, 0): key, (7, 0): "0123456789abcdef=="}
    for (i, _), (value, context) in found.items():
        text = dict(rows)[i]
        assert context == text[: text.index(value)][-48:]
    verdict = {(r["doc_id"], r["finding"]): r["secret"] for r in secret_scan.scan_secrets(df, forest).collect()}
    assert verdict[1, 0] and verdict[2, 0] and not verdict[4, 0]


def test_short_and_mixed_values_behind_a_secret_word(spark, forest):
    rows = [(1, 'password = "hunter2-abc9"', "hunter2-abc9"), (2, "db_password=P@ss.w0rd!9,", "P@ss.w0rd!9"), (3, 'x: "api key": \'a1$b2$c3\'', "a1$b2$c3"), (4, 'pwd = "two words 99"', "two words 99"), (5, "password: short", None), (6, "TOKEN=abcdefghijklmnop$qrst0", "abcdefghijklmnop"), (7, "password: required", "required"), (8, 'a = "hunter2-abc9"', None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["id"]: (r["value"], r["context"]) for r in secret_scan.candidates(df, "doc_id", "text").collect()}
    assert {k: v for k, (v, _) in found.items()} == {i: v for i, _, v in rows if v}
    assert all(c == dict(r[:2] for r in rows)[i].split(v)[0][-48:] for i, (v, c) in found.items())
    verdict = {r["doc_id"]: r["secret"] for r in secret_scan.scan_secrets(df, forest).collect()}
    assert verdict[1] and verdict[2] and not verdict[7]
