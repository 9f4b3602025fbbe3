"""Columns named like the operators' own helpers, or like their results, change no result and come back as they were."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, ngram_lm, pii, secret_scan
from tidemark.llm.decontaminate import contaminated, drop_contaminated
from tidemark.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from tidemark.llm.mixing import mix_sources, take_mix
from tidemark.llm.simhash import drop_near_duplicates, near_duplicates, simhash_components
from tidemark.llm.toxicity import drop_toxic, fit, toxicity_scores
from tidemark.llm.url_rules import judge_urls, rules_table

HELPERS = (
    "_id _sha _sha_own _source _url _rows _salt _deal _hot_key _t the.text id t h sha k n a b row rows key keep_id group_size kept text_sha256 size shard taken target place weight order start stack "
    "words fp shingles root component_id band cell pair turned low least host path top rule_key salt active last turn url_host url_path url_rule url_verdict n_rows c x group ids flags f lengths tokens "
    "vocabulary slice keys counts totals items overlap contaminated score predicted toxic label near base added entity term conv role segment loss value before after context finding features probability "
    "mix_size mix_target mix_taken held_out"
).split()
TEXTS = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha BETA gamma delta epsilon zeta eta theta iota kappa", "an idiot wrote this to jo@example.com", "token = \"4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e\"", "one two three four five six seven eight nine ten eleven", None, ""]


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i, t, f"http://example.org/{i}", "s", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, None), (None, TEXTS[0], None, None, None), (3, "another text", "x://org", "q", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, url string, source string, turn_no long")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in HELPERS])


def operators(spark):
    labels = spark.createDataFrame([(i, int(i == 2)) for i in range(6)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, TEXTS[4])], "item_id long, text string")
    rules = rules_table(spark, [("block", "example.org", "/1")])
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark, 400), trees=3, depth=4)
    return {
        "drop_toxic": lambda d: drop_toxic(d, labels), "drop_exact": drop_exact_duplicates, "drop_near": drop_near_duplicates, "drop_contaminated": lambda d: drop_contaminated(d, bench), "take_mix": take_mix,
        "judge_urls": lambda d: judge_urls(d, rules, id_col="doc_id"), "toxicity": lambda d: toxicity_scores(d, fit(d, labels, F.lit(True))), "exact": exact_dedup, "near": near_duplicates, "simhash": simhash_components,
        "contaminated": lambda d: contaminated(d, bench), "mix": mix_sources, "pii": pii.find_pii, "lm": lambda d: ngram_lm.lm_scores(d, F.lit(True)), "secrets": lambda d: scan(d, forest),
        "chat": lambda d: chat.format_turns(d, "doc_id", "turn_no", "source", "text"),
    }


def scan(docs, forest):
    return secret_scan.scan_secrets(docs, forest)


RESULTS = {"take_mix": ["mix_size", "mix_target", "mix_taken"], "judge_urls": ["url_host", "url_path", "url_rule", "url_verdict"]}


def test_every_operator(spark, plain, clashing):
    for name, operator in operators(spark).items():
        expected, found = operator(plain), operator(clashing)
        own = [c for c in found.columns if c in HELPERS and c not in RESULTS.get(name, []) and c not in expected.columns]
        if own:  # the rows come back
            assert set(clashing.columns) <= set(found.columns) | set(RESULTS.get(name, [])), name
            for r in found.select("doc_id", *[F.col(f"`{c}`") for c in own]).collect():
                assert set(r[1:]) == {f"own {'-' if r[0] is None else r[0]}"}, name
        names = expected.columns
        assert sorted(map(repr, map(tuple, found.select(names).collect()))) == sorted(map(repr, map(tuple, expected.collect()))), name


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rows = [(1, "clean words here"), (1, " ".join(TEXTS[4].split())), (None, "x y"), (None, TEXTS[4]), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, TEXTS[4])], "item_id long, text string")
    assert sorted(r["text"] for r in drop_contaminated(docs, bench).collect()) == ["clean words here", "x y", "x y"]
    assert sorted(map(repr, map(tuple, drop_exact_duplicates(docs).collect()))) == sorted(map(repr, [(1, "clean words here"), (1, TEXTS[4]), (None, "x y")]))
