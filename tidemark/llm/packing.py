"""Documents as packed tables of word hashes, which several passes read without splitting texts again.

Words are found and hashed for many texts at once in numpy: with S the running sum of byte i times P^i (mod 2^64), the word
from i to j has the polynomial hash (S[j] - S[i]) / P^i, mixed with its length. No Python object per word is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import materialize

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
#: Bytes hashed at once.
SPAN = 1 << 19
#: White space is space, tab, line feed, vertical tab, form feed and return; everything else belongs to words.
SPACED = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: ASCII letters, digits and underscore belong to words, and so does everything beyond ASCII.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def squeeze_planes(a: np.ndarray) -> bytes:
    """Compressed byte by byte place: first the lowest bytes of all numbers, then the next ones. Small numbers cost little more than their information."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze_planes(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def finish(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of the words of texts, given as bytes. Words are runs of bytes that `in_word` allows."""

    def __init__(self, in_word: np.ndarray) -> None:
        self.in_word = in_word
        self.power, self.inverse = _powers(BASE, SPAN), _powers(pow(BASE, -1, 1 << 64), SPAN)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words per text, hashes of all words in order)."""
        data, start, end, at = self._words(texts)
        return np.diff(np.searchsorted(start, at)), self._all(data, start, end)

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, where words start and end, where texts start)."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        inside = self.in_word[data]
        change = np.diff(inside.view(np.int8), prepend=np.int8(0))
        return data, np.nonzero(change == 1)[0], np.nonzero(change == -1)[0], np.cumsum([0, *(len(t) + 1 for t in texts)])

    def _all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        done = 0
        while done < len(start):  # as many whole words as fit in a span
            upto = max(done + 1, int(np.searchsorted(end, start[done] + SPAN - 1, side="right")))
            out[done:upto] = self._hash(data, start[done:upto], end[done:upto])
            done = upto
        return out

    def terms(self, texts: list[bytes], beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all words, and of the first so many bytes of the words that are longer, as terms of their own."""
        data, start, end, at = self._words(texts)
        text = np.searchsorted(at, start, side="right") - 1
        found = [(text, self._all(data, start, end))]
        for n in beginnings:
            longer = np.nonzero(end - start > n)[0]
            first = start[longer]
            found.append((text[longer], self._all(data, first, first + n) ^ np.uint64(n * 0x9FB21C651E98DF25 & (1 << 64) - 1)))
        return np.concatenate([t for t, _ in found]), np.concatenate([h for _, h in found])

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, n = int(start[0]), int(end[-1] - start[0])
        if n >= len(self.power):  # one word longer than a span
            self.power, self.inverse = _powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n] + np.uint64(1)) * self.power[:n], out=sums[1:])
        size = (end - start).astype(np.uint64)
        return finish((sums[end - low] - sums[start - low]) * self.inverse[start - low] + size * np.uint64(0xD6E8FEB86659FD93))


def ascii_lower_bytes(text: str | None) -> bytes:
    """A-Z lower-cased, nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def lower_bytes(text: str | None) -> bytes:
    """Lower-cased as Unicode has it."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


def pack_documents(
    docs: DataFrame, id_col: str, text_col: str, label: str, in_word: np.ndarray, bytes_of: Callable[[str | None], bytes], encode: Callable[[np.ndarray], dict[str, bytes]], flag: Column | None = None, group_bytes: int = 3 << 20, bucketed: bool = False,
) -> DataFrame:
    """Groups of documents of about `group_bytes` of text, as a written table: group, ids, flags, n_words, lengths and what `encode` makes of the words' hashes.

    lengths (int32, words per document) are compressed. bucketed: the table is bucketed by group. One group is in memory at a time; a document is never divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids, flags, texts, size = WordHasher(in_word), [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # few texts are Python strings at a time
                for key, text, f in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                    ids.append(key)
                    flags.append(f)
                    texts.append(bytes_of(text))
                    size += len(texts[-1])
                    if size >= group_bytes:
                        yield packed(hasher, ids, flags, texts)
                        ids, flags, texts, size = [], [], [], 0
        if ids:
            yield packed(hasher, ids, flags, texts)

    def packed(hasher: WordHasher, ids: list, flags: list, texts: list[bytes]) -> pa.RecordBatch:
        lengths, hashes = hasher(texts)
        blobs = {"lengths": squeeze(lengths.astype(np.int32)), **encode(hashes)}
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([flags], pa.list_(pa.bool_())), pa.array([len(hashes)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs.values())], ["ids", "flags", "n_words", *blobs])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.lit(False).alias("f") if flag is None else flag.alias("f"))
    id_type = plain.schema["id"].dataType
    kind = arrow_type(id_type)
    blobs = "".join(f", {name} binary" for name in encode(np.empty(0, np.uint64)))
    table = plain.mapInArrow(run, f"ids array<{id_type.simpleString()}>, flags array<boolean>, n_words long, lengths binary{blobs}")
    return materialize(table.withColumn("group", F.expr("uuid()")), label, "group" if bucketed else None)  # fixed once written


def as_hashes(hashes: np.ndarray) -> dict[str, bytes]:
    """The lower 32 bits of each word's hash."""
    return {"tokens": squeeze(hashes.astype(np.uint32))}


def as_vocabulary(hashes: np.ndarray) -> dict[str, bytes]:
    """Each word's place (int32) in the group's vocabulary, and the vocabulary's hashes, the commonest words first."""
    vocabulary, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return {"tokens": squeeze_planes(rank[place]), "vocabulary": vocabulary[order].tobytes()}


def arrow_type(spark_type: DataType) -> pa.DataType:
    return to_arrow_type(spark_type)
