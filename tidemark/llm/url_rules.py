"""URL allow and block rules by a sort-merge range join over reversed-host keys. DataFrame operations only.

A rule is (host, path): it fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's. A host turns into a canonical key, its labels reversed and each followed by a dot (`org.example.www.`), so a
rule's hosts are the interval of keys that start with its key; likewise its paths, for the same rule host, are the
interval of paths that start with its path. Prefix intervals are nested or disjoint.

The sweep. Keys and rule starts are sorted together; each rule start carries the stack of rules it is nested in
(those of its prefixes that are rules); a key takes the stack of the last rule start before it and pops what is no
prefix of the key: the rest is active, as all rules between an active rule and the key are nested in that rule. One sweep finds the active rule hosts, a
second one, only for URLs with active hosts, the path rules. The longest rule wins (characters of host and path; then
the longer host; then block before allow; then the smaller rule text).

Scale. Distinct URLs are judged, so a URL that fills a third of the table is judged once. Keys are dealt by top label (by rule
host in the second sweep) and a hash of the URL, so one host may hold most URLs; rules are repeated once for each salt.
The rule list is a table of any number of rules, which is never gathered anywhere; the salts follow the number of URLs to a rule, so
that rules, repeated for each salt, never outweigh the URLs by much.

Defined results. Columns of pages may have any names. URLs of any length are judged whole. A null URL, or one without ://, has empty host and path and meets no rule; then the default verdict
holds. Repeated rows each get their verdict. Empty table or empty rule list: no row, or the default for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, lower_ascii, materialize, quoted, taken_apart, whole_rows

def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _stacks(starts: DataFrame, by: str, key: str) -> DataFrame:
    """For each (by, key): key and the stack of keys of the same `by` that it starts with, itself on top."""
    own = starts.select(by, key).distinct()
    prefixes = own.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))))
    nested = prefixes.join(own.select(by, F.col(key).alias("_prefix")), [by, "_prefix"])
    return nested.groupBy(by, key).agg(F.sort_array(F.collect_list("_prefix")).alias("stack"))


def _sweep(keys: DataFrame, stacks: DataFrame, by: str, key: str, salts: int) -> DataFrame:
    """Each row of keys with `active`, the stacked rule keys that its key starts with. keys: by, key, url and others."""
    others = [c for c in keys.columns if c not in (by, key)]
    dealt = keys.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int")).withColumn("stack", F.lit(None).cast("array<string>")).withColumn("turn", F.lit(1))
    starts = stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("turn", F.lit(0))
    for c in others:
        starts = starts.withColumn(c, F.lit(None).cast(keys.schema[c].dataType))
    both = dealt.unionByName(starts.select(dealt.columns))
    last = F.last("stack", ignorenulls=True).over(Window.partitionBy(by, "salt").orderBy(key, "turn").rowsBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("last", last).where("turn = 1")
    return swept.withColumn("active", F.filter(F.coalesce(F.col("last"), F.expr("cast(array() as array<string>)")), lambda s: F.startswith(F.col(key), s))).drop("stack", "last", "salt", "turn")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", id_col: str = "page_id",
    salts: int | None = None,
) -> DataFrame:
    """All columns of pages with url_host, url_path, url_rule and url_verdict (which replace columns of these names). id_col only deals the rows of hot URLs."""
    spark = pages.sparkSession
    rules = materialize(rules.select("verdict", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host is not null").distinct(), "url-rules")
    keyed = rules.withColumn("rule_key", host_key(F.col("host"))).withColumn("top", F.substring_index("rule_key", ".", 1))
    urls = pages.groupBy(quoted(url_col).alias("url")).agg(F.count("*").alias("n_rows"))
    urls = materialize(urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), "url-distinct")
    if salts is None:  # about a million URLs to a salt, but no more repeated rules than URLs
        n_urls = urls.count()
        salts = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_urls // 1_000_000), n_urls // max(1, rules.count())))
    keys = urls.where("host <> ''").select(F.col("url"), F.col("path"), host_key(F.col("host")).alias("rule_key")).withColumn("top", F.substring_index("rule_key", ".", 1))
    hosts = _sweep(keys, _stacks(keyed, "top", "rule_key"), "top", "rule_key", salts)
    paths = hosts.where(F.size("active") > 0).select("url", "path", F.explode("active").alias("rule_key"))
    fitting = _sweep(paths, _stacks(keyed, "rule_key", "path"), "rule_key", "path", salts)
    fitting = fitting.where(F.size("active") > 0).select("url", "rule_key", F.element_at("active", -1).alias("path"))
    choice = F.struct((F.length("host") + F.length("path")).alias("chars"), F.length("host").alias("host_chars"), (F.col("verdict") == "block").alias("blocks"), "host", "path", "verdict")
    best_of_rule = keyed.groupBy("rule_key", "path").agg(F.max(choice).alias("c"))  # the same host and path may be allowed and blocked
    chosen = fitting.join(best_of_rule, ["rule_key", "path"]).groupBy("url").agg(F.max("c").alias("c"))
    judged = urls.join(chosen, "url", "left").select(
        F.col("url").alias("_url"), F.col("n_rows").alias("_rows"), F.col("host").alias("url_host"), F.col("path").alias("url_path"),
        F.concat("c.host", "c.path").alias("url_rule"), F.coalesce("c.verdict", F.lit(default)).alias("url_verdict"),
    )
    total = urls.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    judged = materialize(judged, "url-verdicts")
    rows = whole_rows(pages, _url=quoted(url_col), _deal=quoted(id_col))
    joined = lookup_join(rows, judged.where("_url is not null"), "_url", "_rows", total, ["_deal"], "left")
    found = {"url_host": F.coalesce("url_host", F.lit("")), "url_path": F.coalesce("url_path", F.lit("")), "url_rule": F.col("url_rule"), "url_verdict": F.coalesce("url_verdict", F.lit(default))}
    return taken_apart(joined, pages.columns, **found)
