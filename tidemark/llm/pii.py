"""Personal data: patterns for base entities, and information-theoretic sanitisation of the terms that reveal them.

Base entities are emails, IP addresses, payment cards (Luhn) and phone numbers. A term t reveals an entity e as far as
knowing t tells e: disclosure(t, e) = max(0, log2(P(e | t) / P(e))) / -log2 P(e), between 0 (independent) and 1 (t occurs
only with e), from corpus counts: P(e) = documents with e / all documents, P(e | t) = documents in which t stands
within `window` words of e / documents with t. A term near an entity, seen with it in `min_support` different surroundings
(copies of one text count once), is generalised if its disclosure reaches `generalise_from` and removed if it reaches
`remove_from`.

Scale. One pass over the texts finds base spans and, for the texts that have any, the terms around them; this table is
written once. Pair counts are combined map-side. A second pass counts the terms that reach the support over the corpus, however many they are, by a bitmap of fixed size and
counts that leave the task when there are many. A pair that stands in a third of all texts is spread when its verdict is looked up.
Texts are never shuffled.

Defined results. Null text is empty. Rows with equal ids each get their own result. Texts of any length are read whole; the window is counted in words, however long they or the gaps between them are. All offsets are code points.
Other columns, whatever their names, are not read. Empty table: empty result."""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, quoted

#: Places of the bitmap of wanted terms, and how many words or counts a task remembers.
PLACES, REMEMBERED = 1 << 20, 200_000
KINDS = ("email", "ip", "card", "phone")
#: Possessive runs and look-behinds only save time on long runs: no match begins inside a run of its first class.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TERM = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: from each @, back over its run of local characters."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all base entities, in order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = "".join(DIGIT.findall(m[0])) if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity_of(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else '.'.join(str(int(p[-3:])) for p in value.split('.')) if kind == 1 else ''.join(DIGIT.findall(value))}"


def surroundings(text: str, spans: list[tuple[int, int, int]], window: int) -> list[dict]:
    """The terms within `window` words of each base span, outside all spans: term, entity, offsets, digest of the surroundings."""
    words = [m.span() for m in TERM.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    starts = [a for a, _, _ in spans]
    reached = list(accumulate((b for _, _, b in spans), max))  # the furthest end so far
    found: dict[tuple[str, str, int], dict] = {}
    for start, kind, end in spans:
        entity = entity_of(kind, text[start:end])
        before, after = bisect_right(ends, start), bisect_left(begins, end)  # words that end before the span, and that begin behind it
        near = words[max(0, before - window) : before] + words[after : after + window]
        near = [(a, b, text[a:b].lower()) for a, b in near if not (k := bisect_left(starts, b)) or reached[k - 1] <= a]
        digest = int.from_bytes(hashlib.blake2b(" ".join(t for _, _, t in near).encode(), digest_size=8).digest(), "big", signed=True)
        for a, b, term in near:
            found.setdefault((term, entity, a), {"term": term, "entity": entity, "start": a, "end": b, "surroundings": digest})
    return list(found.values())


SPAN_TYPE = "struct<kind: string, start: int, end: int>"
NEAR_TYPE = "struct<term: string, entity: string, start: int, end: int, surroundings: long>"


def _first_pass(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    near_type = pa.struct([("term", pa.string()), ("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surroundings", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, near = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                rows.append(uuid.uuid4().bytes)  # names the row in the table written from here
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                near.append(surroundings(text, found, window) if found else [])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(0), pa.array(spans, pa.list_(span)), pa.array(near, pa.list_(near_type))], ["row", "id", "base", "near"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return plain.mapInArrow(run, f"row binary, id {plain.schema['id'].dataType.simpleString()}, base array<{SPAN_TYPE}>, near array<{NEAR_TYPE}>")


def _term_documents(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, documents) for the given terms over all texts, in one pass.

    A bitmap of fixed size over the terms' hashes says which words may be wanted; tasks count those, and the join with the terms leaves out the others.
    The more terms, the more words pass the bitmap; a task's counts go out whenever there are `REMEMBERED` of them, so memory is bounded."""
    places = terms.select(F.pmod(F.xxhash64("term"), F.lit(PLACES)).alias("p")).distinct().toArrow().column("p").to_numpy()  # PLACES rows at most
    bitmap = np.zeros(PLACES, np.uint8)
    bitmap[places] = 1
    packed = np.packbits(bitmap).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known, counts = np.unpackbits(np.frombuffer(packed, np.uint8)).tobytes(), {}, {}
        for batch in batches:
            for value in batch.column(0):
                for term in {t.lower() for t in set(TERM.findall(value.as_py() or ""))}:  # as surroundings() takes them: lower-casing a whole text may cut or alter words
                    may = known.get(term)
                    if may is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        may = known[term] = wanted[xxhash.xxh64_intdigest(term, 42) % PLACES]
                    if may:
                        counts[term] = counts.get(term, 0) + 1
                if len(counts) >= REMEMBERED:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    def out(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    partial = docs.select(quoted(text_col).alias("t")).mapInArrow(run, "term string, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("documents")).join(terms, "term", "left_semi")


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, min_support: int = 3,
    generalise_from: float = 0.8, remove_from: float = 0.95,
) -> DataFrame:
    """One row per document: id, base (spans), added (spans of revealing terms: kind generalise or remove)."""
    first = materialize(_first_pass(docs, id_col, text_col, window), "pii-base")
    n_docs = first.count()
    near = first.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    once = near.groupBy("term", "entity", "row").agg(F.min("surroundings").alias("surroundings"))
    pairs = once.groupBy("term", "entity", "surroundings").agg(F.count("*").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("together"), F.count("*").alias("support"))
    pairs = materialize(pairs.where(F.col("support") >= min_support), "pii-pairs")
    documents = materialize(_term_documents(docs, text_col, pairs.select("term").distinct()), "pii-terms")
    result = first.select("row", "id", "base")
    holders = near.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("holders"))
    counted = pairs.join(documents, "term").join(holders, "entity")
    known = F.greatest(F.lit(0.0), F.log2(F.least(F.lit(1.0), F.col("together") / F.col("documents")) * n_docs / F.col("holders"))) / F.log2(F.lit(float(n_docs)) / F.col("holders"))
    told = counted.where(F.col("holders") < n_docs).withColumn("disclosure", known).where(F.col("disclosure") >= generalise_from)
    pair = F.concat("term", F.lit("\n"), "entity")
    told = told.select(pair.alias("pair"), "together", F.when(F.col("disclosure") >= remove_from, F.lit("remove")).otherwise(F.lit("generalise")).alias("kind"))
    told = materialize(told, "pii-told")
    near = near.select(pair.alias("pair"), "row", "start", "end")
    spans = lookup_join(near, told, "pair", "together", n_docs, ["row"], "inner").groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))  # of two kinds the stronger
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    spans = spans.select("row", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("added"))
    joined = result.join(spans, "row", "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN_TYPE}>)")).alias("added"))


def sanitise(text: str | None, spans: list[tuple[str, int, int]]) -> str:
    """The text with base entities and generalised terms replaced by their kind and removed terms left out.

    spans: (kind, start, end) in code points; where spans overlap, the first by start and length counts."""
    out, at, text = [], 0, text or ""
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            continue
        out += [text[at:start], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def span_digest(spans) -> object:
    """Column: kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "generalise", "remove")])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
