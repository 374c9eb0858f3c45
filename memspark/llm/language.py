"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A gram of three letters is bound
from them: the first one's vector moved on by two places, the second one's by
one place, multiplied place by place with the third one's. A text's vector is
the bundle (sum) of its grams' vectors, a language's prototype the bundle of
all its labelled texts. A text has the language whose prototype has the largest
cosine with its own bundle.

Letters are those of Unicode, in lower case; any stretch of other characters is
one space, as are a text's two ends. Bundles are whole numbers, so they are the
same however rows are dealt out, and partial bundles merge by adding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a vector; texts taken together, by number and by characters; grams bundled at a time; gram vectors a worker keeps.
PLACES, ROWS, CHARS, GRAMS, KEPT = 1024, 256, 1 << 18, 4096, 1 << 16
#: Bits of a letter's number and of a gram's; there are some 140,000 letters.
LETTER, GRAM = 18, 54
UNKNOWN = "und"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The number of each code point (1: no letter, one number for both cases), and the code point of each number; 0 parts two texts."""
    number, points = np.ones(0x110000, np.int64), [0, 32]
    of: dict[int, int] = {}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            key = ord(low) if len(low) == 1 else point
            if key not in of:
                of[key] = len(points)
                points.append(key)
            number[point] = of[key]
    return number, np.array(points)


@cache
def letter(point: int) -> np.ndarray:
    """The random vector of a code point, the same on every machine."""
    from hashlib import shake_256

    bits = np.unpackbits(np.frombuffer(shake_256(b"letter %d" % point).digest(PLACES // 8), np.uint8))
    return bits.astype(np.int8) * 2 - 1


_gram: dict[int, np.ndarray] = {}


def gram(code: int) -> np.ndarray:
    """The bound vector of three letters' numbers."""
    if code not in _gram:
        if len(_gram) >= KEPT:
            _gram.clear()
        points, low = _letters()[1], (1 << LETTER) - 1
        a, b, c = (letter(int(points[code >> shift & low])) for shift in (2 * LETTER, LETTER, 0))
        _gram[code] = np.roll(a, 2) * np.roll(b, 1) * c
    return _gram[code]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters' numbers of all texts one after the other, and the place in the list of the text each belongs to."""
    joined = np.frombuffer("".join(f" {x} \0" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 3 for x in texts])
    ids = _letters()[0][joined]
    ids[ends - 1] = 0
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    keep = np.append(True, (ids[1:] != 1) | (ids[:-1] != 1))
    return ids[keep], owner[keep]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, count) arrays of the texts; a code is place in the list << GRAM | gram. Stretches of CHARS letters at a time, so a long text never makes long arrays of codes."""
    ids, owner = symbols(texts)
    for first in range(0, len(ids) - 2, CHARS):
        s, o = ids[first : first + CHARS + 2], owner[first : first + CHARS]
        a, b, c = s[:-2], s[1:-1], s[2:]
        whole = (a != 0) & (b != 0) & (c != 0)
        yield np.unique((o[: len(a)] << GRAM | a << 2 * LETTER | b << LETTER | c)[whole], return_counts=True)


def bundles(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The bundle of each of n owners from (owner << GRAM | gram, count) arrays, as whole numbers."""
    out = np.zeros((n, PLACES), np.int64)
    kinds, at = np.unique(codes & ((1 << GRAM) - 1), return_inverse=True)
    owners = codes >> GRAM
    for first in range(0, len(kinds), GRAMS):
        own = (at >= first) & (at < first + GRAMS)
        vectors = np.stack([gram(int(x)) for x in kinds[first : first + GRAMS]])
        # doubles hold these sums exactly, single floats up to 2^24
        kind = np.float32 if counts[own].sum() < 1 << 24 else np.float64
        table = np.zeros((n, len(vectors)), kind)
        table[owners[own], at[own] - first] = counts[own]
        out += (table @ vectors.astype(kind)).astype(np.int64)
    return out


def bundled(texts: list[str]) -> np.ndarray:
    """The bundle of each text; no letters give grams of spaces at most, which count for nothing."""
    out = np.zeros((len(texts), PLACES), np.int64)
    for codes, counts in grams(texts):
        out += bundles(codes, counts, len(texts))
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of at most ROWS texts and, but for single texts, CHARS characters."""
    first = size = 0
    for k, x in enumerate(texts):
        if k > first and (k - first >= ROWS or size + len(x) > CHARS):
            yield first, k
            first = k
            size = 0
        size += len(x)
    if texts:
        yield first, len(texts)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, place, total: the bundle of each language's texts, a row for each place.

    Rows without language or letters teach nothing. Each worker counts the grams
    of each language and bundles them when it has many; only bundles are
    shuffled, PLACES rows for each task and language. An empty table gives no
    rows. Other columns are not read. Repeated rows count each.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: dict[str, dict[int, int]] = {}
        out: dict[str, np.ndarray] = {}

        def flush(name: str) -> None:
            kept = held.pop(name)
            codes, counts = np.fromiter(kept.keys(), np.int64, len(kept)), np.fromiter(kept.values(), np.int64, len(kept))
            out[name] = out.get(name, 0) + bundles(codes, counts, 1)[0]

        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(x)
            for name, texts in by.items():
                for a, b in _groups(texts):
                    for codes, counts in grams(texts[a:b]):
                        kept = held.setdefault(name, {})
                        kinds, at = np.unique(codes & ((1 << GRAM) - 1), return_inverse=True)
                        for k, n in zip(kinds.tolist(), np.bincount(at, counts).astype(np.int64).tolist(), strict=True):
                            kept[k] = kept.get(k, 0) + n
                        if len(kept) > KEPT:
                            flush(name)
        for name in [*held]:
            flush(name)
        for name, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * PLACES, pa.string()), pa.array(np.arange(PLACES, dtype=np.int32)), pa.array(v)], ["lang", "place", "total"])

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))


def prototypes(profile: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names and their prototypes at length one: PLACES numbers for each learned language, whatever the size of the corpus."""
    rows = profile.toPandas()
    names = sorted(rows["lang"].unique().tolist())
    out = np.zeros((len(names), PLACES))
    out[[names.index(x) for x in rows["lang"]], rows["place"].to_numpy(int)] = rows["total"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.where(norms == 0, 1, norms)


def judged(texts: list[str | None], names: list[str], protos: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and the cosine, from 0 to 1, of each text; equal cosines go to the name that comes first."""
    number = _letters()[0]
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names:
        return langs, scores
    for a, b in _groups([x or "" for x in texts]):
        held = [x or "" for x in texts[a:b]]
        v = bundled(held).astype(float)
        cosines = (v @ protos.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).round(12)
        best = cosines.argmax(1)
        for k, x in enumerate(held):
            if x and (number[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)] > 1).any():
                langs[a + k], scores[a + k] = names[best[k]], min(1.0, max(0.0, cosines[k, best[k]]))
    return langs, scores


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every row, by the whole text.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every
    text if no language was learned. Repeated rows stay; an empty table gives
    no rows; columns that are not kept are not read. Rows are judged where they
    are read: nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(learned)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names, protos = held.value
        for batch in batches:
            langs, scores = judged(batch.column(batch.num_columns - 1).to_pylist(), names, protos)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def op11_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a null doc_id is held out, so nothing is learned from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    learned = prototypes(profiles(docs.where(~held_out)))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), learned, ("doc_id", "held_out"))
