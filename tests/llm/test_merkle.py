"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(doc_id, text, lang, source, n_chars) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
        i //= 8
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        members = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, digest(*r)))
        trees[lang] = members, tree([digest(*r) for r in members])
    top = tree([trees[lang][1][-1][0] for lang in order]) if order else []
    out = []
    for k, lang in enumerate(order):
        members, levels = trees[lang]
        for i, r in enumerate(members):
            path = way(levels, i) + way(top, k)
            claim = digest(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = r[1] if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                claim = digest(r[0], low, *r[2:])
            for left, right in path:
                claim = h(left, claim, right)
            out.append((r[0], digest(*r), levels[-1][0], top[-1][0], h(*(s for p in path for s in p)), claim, claim == top[-1][0]))
    return out


def many(n: int, langs: list) -> list[tuple]:
    return [(i * 7 % 1009, f"Text É {i} {'ab' * (i % 5)}" if i % 11 else None, langs[i % len(langs)], f"s{i % 4}" if i % 5 else None, i if i % 3 else None) for i in range(n)]


CASES = {
    "several levels": many(700, ["en", "en", "en", "de", "é", None, "", "z"]),
    "runs that end just at a run's end": many(64, ["en"]) + many(8, ["de"]) + many(9, ["fr"]),
    "one document": many(1, ["en"]),
    "one language": many(20, ["en"]),
    "a document a language": [(i, "A", f"l{i}", "s", 1) for i in range(75)],
    "odd rows": [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (None, "X", "en", "s", 1), (None, None, None, None, None), (4, "", "en", "", 0), (-5, "Q" * 100_000, "en", "s", 5), (12, "Zwölf", "en", "s", 5)],
    "no rows": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_a_plain_tree(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "digest": F.lit("x"), "claim": F.lit("y"), "place": F.lit(3)}).repartition(5)
    got = [tuple(r) for r in merkle.audited(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_a_parent_wants_all_its_children():
    with pytest.raises(ValueError, match="has heard from"):
        merkle.complete((("en", 0), [(0, 3, "a", None, None), (2, 3, "b", None, None)]))


def test_sql_gives_the_same_rows(spark):
    import duckdb
    import pyarrow as pa

    rows = CASES["several levels"]
    documents = pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])  # noqa: F841
    assert sorted(duckdb.sql(merkle.sql(5)).fetchall(), key=repr) == sorted(plain(rows), key=repr)
