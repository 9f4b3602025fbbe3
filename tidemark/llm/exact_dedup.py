"""Exact deduplication: group by a 128-bit content hash, keep one id, compare bytes inside groups.

Plan. One pass turns each text into (id, 128-bit hash, SHA-256): no text is shuffled. Groups are counted with a
map-side combine. Only texts whose hash occurs more than once are read again; their smallest and largest
normalised text per hash are compared byte by byte (again combined map-side, so a hash shared by a third of all rows
costs one candidate per input partition). Equal extremes prove that the whole group is equal. A hash whose extremes differ is a
collision: its rows are grouped by the bytes themselves. Rows meet their group through `lookup_join`, which
spreads hot groups.

Defined results. A null text counts as empty. Ids may repeat or be null: a group's kept id ignores nulls unless
all are null; every row that carries the kept id is marked `kept` (rows that repeat id and text are the same
document; `drop_exact_duplicates` leaves one of them). An empty table gives an empty result. Other columns,
whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, lower_ascii, materialize, quoted, row_key, taken_apart, whole_rows

#: Repeated hashes are broadcast for the second read up to this many, as numbers (some 16 MB to a million); beyond it they are joined by shuffle.
BROADCAST_HASHES = 2_000_000


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text, as 32 hex digits."""
    return F.md5(text.cast("binary"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash, broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" keeps the smallest id of equal texts, "max" the largest. hash_of may be replaced (tests use a weak
    hash to exercise collisions)."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    best = F.min if keep == "min" else F.max
    normal = docs.select(F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    hashed = materialize(normal.select("id", hash_of(F.col("t")).alias("h"), F.sha2("t", 256).alias("sha")), "dedup-hashes")
    groups = materialize(hashed.groupBy("h").agg(best("id").alias("keep_id"), F.count("*").alias("n")), "dedup-groups")
    total, repeated = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    result = lookup_join(hashed, groups, "h", "n", total, ["id"], "inner")
    if repeated:
        keys = groups.where("n > 1").select(F.xxhash64("h").alias("k")).distinct()  # two hashes that share a number are both read
        keys = F.broadcast(keys) if repeated <= broadcast_hashes else keys
        texts = normal.withColumn("h", hash_of(F.col("t"))).join(keys, F.xxhash64("h") == F.col("k"), "left_semi")
        collided = materialize(texts.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h"), "dedup-collisions")
        if not collided.isEmpty():
            result = _split_collisions(normal, hash_of, result, collided, best)
    return result.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _split_collisions(normal: DataFrame, hash_of, result: DataFrame, collided: DataFrame, best) -> DataFrame:
    """Rows of the collided hashes, grouped by their bytes; the other rows as they are."""
    rows = materialize(normal.withColumn("h", hash_of(F.col("t"))).join(collided, "h", "left_semi"), "dedup-collided")
    rows = rows.withColumn("sha", F.sha2("t", 256))
    by_bytes = rows.groupBy("t").agg(best("id").alias("keep_id"), F.count("*").alias("n"))  # combined map-side
    mended = lookup_join(rows, by_bytes, "t", "n", rows.count(), ["id"], "inner").select("h", "id", "sha", "keep_id", "n")
    return result.join(collided, "h", "left_anti").select("h", "id", "sha", "keep_id", "n").unionByName(mended)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, with its own columns: of the id that exact_dedup keeps, and of rows that repeat id and text any one.

    Rows are dealt by id and text, which never gathers a group of copies under different ids; rows that repeat both meet map-side first. The same plan at any size."""
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(row_key(F.col(id_col), F.col("text_sha256")).alias("key")).distinct()
    sha = F.sha2(lower_ascii(F.coalesce(quoted(text_col), F.lit(""))), 256)
    rows = whole_rows(docs, key=row_key(quoted(id_col), sha)).join(materialize(kept, "dedup-kept").hint("shuffle_hash"), "key", "left_semi")
    return taken_apart(rows.groupBy("key").agg(F.first("row").alias("row")), docs.columns)
