import random

import duckdb
import pytest

from tidemark.llm.mixing import mix_sources, sainte_lague, source_targets, take_mix
from tidemark.llm.url_rules import judge_urls, rules_table


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1.0) for i, t, s in rows], "doc_id long, text string, source string, key string, target double")


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_words(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "É", "z", None, "src10", "src2"][: 3 + seed]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])), names[min(int(rng.expovariate(1)), len(names) - 1)]) for i in range(300)]
    found = mix_sources(docs(spark, rows), docs_per_shard=20).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 8 * (1 + len(rows) / 20) and abs(taken[s] - target[s]) <= 8 + 0.05 * target[s]
    again = {r["doc_id"]: r["taken"] for r in mix_sources(docs(spark, rows).repartition(7), docs_per_shard=20).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}
    assert {r["doc_id"]: r["mix_taken"] for r in take_mix(docs(spark, rows), docs_per_shard=20).collect()} == {i: n for i, n in again.items() if n}


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague_is_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 3, 10, 1000, 99_999]) * rng.random() for _ in range(rng.randint(1, 30))]
    seats = rng.choice([1, 2, 7, 50, 3000])
    ranked = sorted(((-v / (2 * j + 1), k, j) for k, v in enumerate(votes) if v for j in range(seats)))[:seats]
    expected = [sum(k == i for _, k, _ in ranked) for i in range(len(votes))]
    df = spark.createDataFrame([(0, k, float(v), seats) for k, v in enumerate(votes)], "g int, k int, v double, s long")
    found = {r["k"]: r["quota"] for r in sainte_lague(df, "g", "k", "v", "s").collect()}
    assert [found.get(k, 0) for k in range(len(votes))] == expected


def test_edges_of_the_mix(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    nothing = mix_sources(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0, 0)] * 2
    one = mix_sources(docs(spark, [(1, "a b c", None), (1, "a b c", None)])).collect()
    assert 6 <= sum(r["taken"] for r in one) <= 8  # whole blocks of 8 words
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1, 1)], "source string, source_size long, n_docs long")
    assert {r["source"]: r["target"] for r in source_targets(sizes, (1, 2, 3), 3).collect()} == {"a": 8, "b": 3}


RULES = [("block", "example.org", "/a/"), ("allow", "example.org", "/a/b"), ("allow", "org", "/"), ("block", "org", ""), ("block", "www.example.org", "/a/b"), ("block", "com", "/x"), ("block", "example.com", ""), ("allow", "example.com", ""), ("block", "é.net", "/ü"), ("block", "a.b.c.d", "/"), ("block", "b", "/q")]
HOSTS = ["example.org", "www.example.org", "notexample.org", "org", "example.com", "a.example.com", "x.com", "é.net", "EXAMPLE.ORG", "example.org.", "a..b.c.d", "z.a.b.c.d", "b.c.d", "", "example.org:80", "b"]
PATHS = ["", "/", "/a", "/a/", "/a/b", "/a/bc?x=/a/b", "/x", "/ü#f", "/q/", "?q=/a/", "/A/"]


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "block", h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[5] if best else "allow"


def test_urls_against_brute_force(spark):
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in HOSTS for p in PATHS] + [None, "", "no scheme", "http:/half", "a://b://c/d", "://example.org/a/"]
    rows = [(i, u, "p", "r") for i, u in enumerate(urls)] + [(1, "http://example.org/a/", "p", "r")] * 3 + [(None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, rule_key string")
    found = judge_urls(pages, rules_table(spark, RULES))
    assert found.columns[:4] == pages.columns
    got = sorted(((r["page_id"], r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in found.collect()), key=repr)
    assert got == sorted(((r[0], *plain_verdict(r[1], RULES)) for r in rows), key=repr)
    assert judge_urls(pages.limit(0), rules_table(spark, RULES)).count() == 0
    assert {r["url_verdict"] for r in judge_urls(pages, rules_table(spark, []), default="block").collect()} == {"block"}


@pytest.mark.parametrize("name", ["op5_mix_sources", "op6_url_rules", "op8_chat_format", "op9_exact_dedup"])
def test_queries_against_sql(spark, name):
    from tidemark.llm.oracle import ORACLE
    from tidemark.llm.queries import QUERIES

    sql = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    expected = sql.execute(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(expected, key=repr)
