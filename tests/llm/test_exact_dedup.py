import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import drop_exact_duplicates, exact_dedup

SCHEMA = "doc_id long, text string, lang string, h string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 9) for i, t in rows], SCHEMA)


def expected(rows, keep):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        best = (min if keep == "min" else max)(known) if known else None
        out.append((i, best, len(ids), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "abc"), (None, "lone"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "X" * 300_000), (1, "other")]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_against_brute_force(spark, keep, weak, broadcast):
    options = {"hash_of": lambda t: F.length(t).cast("string")} if weak else {}  # a hash full of collisions
    found = exact_dedup(docs(spark, ROWS), keep=keep, broadcast_hashes=broadcast, **options)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(ROWS, keep)


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0 and drop_exact_duplicates(docs(spark, [])).count() == 0


def test_large_group(spark):
    found = exact_dedup(spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")))
    rows = found.where("group_size > 1").agg(F.count("*"), F.max("group_size"), F.count_if("kept"), F.max("keep_id")).first()
    assert tuple(rows) == (1667, 1667, 1, 0)


def test_filter_keeps_columns_and_one_of_repeated_rows(spark):
    kept = drop_exact_duplicates(docs(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "lang", "h", "n"]
    assert sorted([(r["doc_id"], len(r["text"] or "")) for r in kept.collect()], key=repr) == sorted([(1, 3), (3, 4), (4, 0), (6, 1), (7, 1), (None, 4), (8, 300_000), (1, 5)], key=repr)
