"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame operations only.

Each source gets a target number of words: its weight's share of the budget, stopped at `max_repeat` times its
size, the excess shared again by weight (closed form of that loop: with sources ordered by cap per weight, the
capped ones are a prefix). The budget is cut into blocks of `block_tokens` words, which the sources get by highest
quotients target / (2 j + 1); inside a source, its shards get the source's blocks by the same rule from their
sizes. Documents of a shard lie in seeded order as one stream of words, cut into blocks; a shard takes its quota from
the start of the stream, whole rounds first. So a document is taken from 0 to max_repeat times, and at most one
document per shard is cut.

Scale. Texts are read once, to count words. A shard has about `docs_per_shard` documents, so a source that holds a third of
all rows is many shards and no window sorts more than a shard. Quotients are ranked only near the threshold: a few
per source or shard, however many blocks there are. The one window over all sources has a row per source.

Defined results. A null text has size 0; texts of any length are counted whole; other columns, whatever their names, are not read (`take_mix` returns them); a null source is a source of its own, last in order. Sources whose words are
none get target 0. Repeated rows are separate documents. Empty table: empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, materialize, quoted, row_key, taken_apart, whole_rows, word_count


def sainte_lague(parties: DataFrame, group: str, key: str, votes: str, seats: str) -> DataFrame:
    """(group, key, quota): within each group, `seats` seats by the highest quotients votes / (2 j + 1).

    Ties go to the smaller key. Dividing by votes-per-seat and rounding gives each party its seats but for a few;
    a party's true number differs from that by 2 n (a + 1) / N + 2 at most (n parties, N seats, a rounded seats), so
    only the quotients in that band are ranked."""
    voting = parties.where((F.col(votes) > 0) & (F.col(seats) > 0))
    whole = Window.partitionBy(group)
    rounded = voting.withColumn("_n", F.count("*").over(whole)).withColumn("_all", F.sum(F.col(votes).cast("double")).over(whole))
    rounded = rounded.withColumn("_a", F.floor(F.col(votes) / F.col("_all") * F.col(seats) + 0.5).cast("long"))
    band = F.least(F.ceil(2 * F.col("_n") * (F.col("_a") + 1) / F.col(seats)).cast("long") + 2, F.col(seats))
    rounded = rounded.withColumn("_from", F.greatest(F.lit(0).cast("long"), F.col("_a") - band)).withColumn("_to", F.least(F.col("_a") + band, F.col(seats)))
    rounded = rounded.withColumn("_left", F.col(seats) - F.sum("_from").over(whole))
    quotients = rounded.withColumn("_j", F.explode(F.sequence(F.col("_from"), F.col("_to")))).withColumn("_q", F.col(votes) / (2 * F.col("_j") + 1))
    ranked = quotients.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_q").desc(), F.col(key), F.col("_j"))))
    return ranked.groupBy(group, key).agg((F.max("_from") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("quota"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Adds place, weight and target to (source, source_size)."""
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sources.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    placed = placed.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    placed = placed.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("_ratio", "place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)
    placed = placed.withColumn("_rest", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    placed = placed.withColumn("_level", F.col("_rest") / F.sum("weight").over(onward))
    placed = placed.withColumn("_share", F.first(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_share"), F.col("_level")) * F.col("weight"))
    return placed.withColumn("target", target).select("source", "source_size", "n_docs", "place", "weight", "target")


def _number(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3),
    max_repeat: int = 3, block_tokens: int = 8, docs_per_shard: int = 2000, seed: int = 11, broadcast_sources: int = 100_000,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, shard, taken.

    Sources in order of code point, null last, weigh `weights`, repeating. Sources are broadcast up to
    `broadcast_sources` of them, otherwise joined by shuffle with hot sources spread."""
    base = docs.select(F.col(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), word_count(quoted(text_col)).alias("size"))
    base = materialize(base.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "mix-sizes")
    sources = base.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sources, weights, max_repeat).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    sources = sources.withColumn("all", F.lit(0)).withColumn("blocks", F.ceil(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_tokens).cast("long"))
    sources = materialize(sources, "mix-sources")
    quotas = sainte_lague(sources, "all", "place", "target", "blocks").select("place", F.col("quota").alias("source_blocks"))
    sources = materialize(sources.join(quotas, "place", "left").fillna(0, ["source_blocks"]).drop("source", "all", "blocks"), "mix-quotas")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    placed = base.join(F.broadcast(sources), "key") if n_sources <= broadcast_sources else lookup_join(base, sources, "key", "n_docs", total, ["id"], "inner")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed = placed.withColumn("order", digest).withColumn("shard", (_number(F.col("order")) % F.ceil(F.col("n_docs") / docs_per_shard)).cast("long"))
    shards = placed.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("source_blocks").alias("source_blocks"))
    shares = sainte_lague(shards, "key", "shard", "words", "source_blocks")
    shards = materialize(shards.select("key", "shard", "words").join(shares, ["key", "shard"], "left").fillna(0, ["quota"]), "mix-shards")
    before = Window.partitionBy("key", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    stream = placed.join(shards, ["key", "shard"]).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    stream = stream.withColumn("quota_words", F.least(F.col("quota") * block_tokens, F.col("words") * max_repeat))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("quota_words") / F.col("words"))).otherwise(0).cast("long")
    stream = stream.withColumn("rounds", F.least(rounds, F.lit(max_repeat).cast("long"))).withColumn("rest", F.col("quota_words") - F.col("rounds") * F.col("words"))
    part = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0).cast("long")), F.col("size"))
    return stream.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "shard", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken")
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of which the mix takes any words: their columns, mix_size, mix_target and mix_taken (which replace columns of these names).

    Rows with the same id, source and size are each taken as often as the most taken of them."""
    key = lambda id_, source, size: F.concat(row_key(source, size), F.lit(":"), row_key(id_, size))
    mixed = mix_sources(docs, id_col, text_col, source_col, **options).where("taken > 0")
    mixed = mixed.select(key(quoted(id_col), quoted(source_col), F.col("size")).alias("key"), "target", "taken").groupBy("key").agg(F.max("target").alias("target"), F.max("taken").alias("taken"))
    sized = whole_rows(docs, size=word_count(quoted(text_col)))
    sized = sized.withColumn("key", key(F.col("row").getField(id_col), F.col("row").getField(source_col).cast("string"), F.col("size")))
    joined = sized.join(materialize(mixed, "mix-taken").hint("shuffle_hash"), "key")
    return taken_apart(joined, docs.columns, mix_size=F.col("size"), mix_target=F.col("target"), mix_taken=F.col("taken"))
