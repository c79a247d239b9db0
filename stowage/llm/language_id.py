"""Language identification by rank-order profiles and the out-of-place distance.

A profile is the ranking of a language's most frequent n-grams (1 to 3 characters of words, which are runs of letters,
with a boundary mark at either end). A document is ranked in the same way over its whole text; the sum of the places by which its n-grams are
out of place in a profile, where an n-gram that the profile lacks counts as the profile's length, is its distance, and
the nearest language is predicted. The score is 1 minus the distance over the largest possible one.

Profiles are learned from a bounded sample of labelled rows: for each language, about ``sample`` documents at most,
taken by a hash of doc_id, so the same rows at every run. Ties in frequency go by the n-gram, ties in distance by the
language's name.

Cases: null text or one without a letter is ``und`` with score 0; with no labelled row everything is ``und``; repeated
rows get rows of their own; an empty table gives no rows; a null doc_id is not held out and, as its hash is null,
never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import tokens
from .common import ship

PROFILE = 400
#: Documents of each language, about, that profiles are learned from.
SAMPLE = 1500
#: Characters that are counted at a time; a longer text is cut between words.
SPAN = 1 << 20
#: Distinct n-grams, about, that a task collects before it hands them on.
COLLECTED = 1 << 18
MARK, BITS = ord("_"), 21  # a code point has 21 bits at most


def held_out() -> Column:
    """crc32 of the doc_id as text, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and how often each occurs.

    An n-gram is a number of three code points, filled with 0 behind, so numbers are ordered as the n-grams themselves.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    word = letters()[code]
    parts, at = [], 0
    while at < len(code):
        end = min(len(code), at + SPAN)
        if end < len(code):  # up to the end of the word
            rest = np.flatnonzero(~word[end:])
            end = end + int(rest[0]) if len(rest) else len(code)
        mine = word[at:end]
        keep = mine.copy()  # letters, and one mark after each word
        keep[1:] |= mine[:-1]
        marked = np.full(int(keep.sum()) + 2, MARK, np.int64)
        marked[1:-1] = np.where(mine, code[at:end], MARK)[keep]
        if len(marked) > 2 and marked[-2] == MARK:
            marked = marked[:-1]
        real = marked != MARK
        one, two, three = marked << 2 * BITS, marked << BITS, marked
        pairs, triples = one[:-1] | two[1:], one[:-2] | two[1:-1] | three[2:]
        if real.any():
            parts.append(np.unique(np.concatenate([one[real], pairs, triples[real[1:-1]]]), return_counts=True))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def gram_of(key: int) -> str:
    codes = (key >> 2 * BITS, key >> BITS & (1 << BITS) - 1, key & (1 << BITS) - 1)
    return "".join(chr(c) for c in codes if c)


def key_of(gram: str) -> int:
    return sum(ord(c) << (2 - i) * BITS for i, c in enumerate(gram))


def top(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams first, ties by the n-gram."""
    if len(counts) > most:
        keep = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")[:most]]


def learn(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, list[str]]:
    """Profiles by language, from rows of ``docs`` (doc_id, text, lang) with a lang and not held out."""
    ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {}
    every = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, -(-n // sample)))])
    some = usable.filter(F.pmod(F.xxhash64("doc_id"), every[F.col("lang")]) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in met.items():
                keys, counts = added(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])
            met.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
                keys, counts = gram_counts(text.as_py())
                met.setdefault(lang, []).append((keys, counts))
                held += len(keys)
                if held > COLLECTED:
                    yield from flush()
                    held = 0
        yield from flush()

    grams = some.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    cell = F.pmod(F.xxhash64("gram"), F.lit(64)).alias("cell")
    for part in (["lang", "cell"], ["lang"]):  # the most frequent ones of each cell first, so that no task sorts all of a language
        place = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), "gram"))
        grams = grams.select("lang", "gram", "n", *([cell] if len(part) > 1 else [])).withColumn("place", place).filter(F.col("place") <= profile)
    found: dict[str, list[str]] = {}
    for r in sorted(grams.select("lang", "place", "gram").collect()):  # ``profile`` rows a language
        found.setdefault(r["lang"], []).append(gram_of(r["gram"]))
    return found


def predict(docs: DataFrame, profiles: dict[str, list[str]], keep: Sequence[str] = (), profile: int = PROFILE, text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row; predicts from the column ``text`` only."""
    ship(docs.sparkSession)
    langs = sorted(profiles)
    keep = list(keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted({key_of(g) for grams in profiles.values() for g in grams}), np.int64)
        places = np.full((len(langs), len(known) + 1), profile, np.int64)  # the last column is of all other n-grams
        for i, lang in enumerate(langs):
            places[i, np.searchsorted(known, [key_of(g) for g in profiles[lang]])] = np.arange(len(profiles[lang]))
        for batch in batches:
            for a, b in tokens.slices(tokens.text_sizes(batch, text), 4 << 20):
                preds, scores = [], []
                for value in batch[text][a:b]:
                    keys, counts = gram_counts(value.as_py())
                    if not langs or not len(keys):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    ranked = top(keys, counts, profile)
                    at = np.searchsorted(known, ranked)
                    at[known[np.minimum(at, len(known) - 1)] != ranked] = len(known)
                    own = places[:, at]
                    distance = np.where(own == profile, profile, np.abs(own - np.arange(len(ranked)))).sum(axis=1)
                    i = int(distance.argmin())
                    preds.append(langs[i])
                    scores.append(1 - float(distance[i]) / (profile * len(ranked)))
                own = [batch[c][a:b] for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    given = docs.select(*keep, *([text] if text not in keep else []))
    return given.mapInArrow(judge, StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return predict(rows, learn(docs), ["doc_id", "held_out"])


def identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least_score`` at least."""
    own = [f"own{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)])
    kept = predict(named, learn(docs), own, text=own[docs.columns.index("text")]).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return kept.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])
