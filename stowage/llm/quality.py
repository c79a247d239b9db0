"""Quality rules as a ledger of failure bits, with versioned policies and ablations on top of it.

Every rule is evaluated once for every document. The ledger keeps its measurements and one bit per failed rule; a
policy is a mask of the rules that count, so policies of any version, and what each of their rules alone would reject,
come from the ledger by bitwise operations and never touch the text again.

Words are runs of bytes other than space and the controls 9 to 13. Cases: null and empty text have no words, measure 0
and fail the base; repeated rows get rows of their own; an empty table gives no rows; a null doc_id stays null; other
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .common import materialize, ship

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_upper", "n_chars_alpha", "n_digits")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(windows) < len(words) - 2:
        covered_to = 0
        for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[w] > 1:
                repeated += i + 3 - max(covered_to, i)
                covered_to = i + 3
    upper = len(_UPPER.findall(text))
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        upper + len(re.findall(r"[a-zß-öø-ÿ]", text)),
        len(raw) - len(raw.translate(None, b"0123456789")),
    )


def rules() -> list[tuple[str, Column]]:
    """Rules in the order of their bits: a name, and when it fails. Never reorder: the bits are stored."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("duplicate_lines", (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 25 * c("n_words")),
        ("capitals", (c("n_chars_alpha") >= 100) & (2 * c("n_chars_upper") > c("n_chars_alpha"))),
        ("digits", 2 * c("n_digits") > c("word_chars")),
    ]


#: Policies by version: the rules that count. A version once used is never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals", "digits"),
}


def mask_of(policy: str) -> int:
    names = [n for n, _ in rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, the measurements (of the column ``text``) and failed_bits of every row."""
    ship(docs.sparkSession)
    keep = list(keep)

    def measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(tokens.text_sizes(batch, text), 4 << 20):
                rows = [measure(t.as_py()) for t in batch[text][a:b]]
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch[c][a:b] for c in keep], *columns], names=[*keep, *MEASURES])

    given = docs.select(*keep, *([text] if text not in keep else []))
    measured = given.mapInArrow(measure_all, StructType([*docs.select(*keep).schema.fields, *[StructField(m, LongType()) for m in MEASURES]]))
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of all rows, measured once and written; policies and ablations are read from it."""
    return materialize(ledger(docs.select(F.col("doc_id").cast("long"), "text")), "ledger")


def passes(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For every rule of a policy: how many documents fail it, and how many only it (they would pass without the rule)."""
    names, mask = [n for n, _ in rules()], mask_of(policy)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    by_bits = entries.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most one row a combination of bits
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]]))
    each = by_bits.select("bits", "n", one.alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone")
    )


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the measurements, failed_bits, base_failed and kept of every row, by policies over the stored ledger."""
    return stored_ledger(docs).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    own = [f"own{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)])
    entries = ledger(named, own, own[docs.columns.index("text")])
    return entries.filter(passes("base") & passes(policy)).select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


#: The rows of op5 in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM v WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_chars_upper,
             CAST(length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þa-zß-öø-ÿ]', '', 'g')) AS BIGINT) AS n_chars_alpha,
             CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT
             + 64 * (n_chars_alpha >= 100 AND 2 * n_chars_upper > n_chars_alpha)::INT + 128 * (2 * n_digits > word_chars)::INT AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

#: The rows of the ablations of policy v1 in DuckDB's SQL.
ABLATION_SQL = f"""
SELECT rule, CAST(sum(((failed_bits & bit) <> 0)::INT) AS BIGINT) AS failing, CAST(sum((failed_bits = bit)::INT) AS BIGINT) AS failing_alone
FROM ({SQL}) q, (VALUES {", ".join(f"('{name}', {1 << i})" for i, name in enumerate(POLICIES["v1"]))}) r(rule, bit) GROUP BY rule
"""
