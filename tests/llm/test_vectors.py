"""Operators on embeddings against plain versions of them."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import cross_polytope as cp
from stowage.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("scale", [1, 10**40])
def test_tree_finds_the_nearest_entry_and_the_lower_on_ties(scale):
    random = np.random.default_rng(3)
    for _ in range(60):
        n, d = random.integers(1, 17), random.integers(1, 9)
        kind = object if scale > 1 else np.int64
        book, parts = random.integers(-4, 5, (n, d)).astype(kind) * scale, random.integers(-5, 6, (150, d)).astype(kind) * scale
        index, square = vc.nearest(parts, book, vc.tree(book, list(range(n))))
        for q, i, s in zip(parts, index, square, strict=True):
            every = [sum(int(a - b) ** 2 for a, b in zip(q, e, strict=True)) for e in book]
            assert (int(s), i) == min((v, k) for k, v in enumerate(every))


def plain_codes(rows: list[tuple]) -> list[tuple]:
    """The contract of op11, one part at a time in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // 8)
    parts = [[(v + [0] * 8)[p * width : (p + 1) * width] for p in range(8)] if len(v) == 8 * width else [(v + [0] * (8 * width - len(v)))[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[parts[r][p] for r in range(min(16, len(kept)))] for p in range(8)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((square(v, e), i) for i, e in enumerate(books[p]))
    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            met: dict[int, list] = {}
            for v in parts:
                met.setdefault(near(p, v[p])[1], []).append(v[p])
            for e, members in met.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, totals = [], {}
    for (i, _, label), v in zip(kept, parts, strict=True):
        found = [near(p, v[p]) for p in range(8)]
        error = sum(s for s, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append([i, "".join(f"{e:02x}" for _, e in found), min(error, vc.LARGEST), label])
    return [(i, code, error, min(totals[label], vc.LARGEST), sha) for i, code, error, label in out]


def vectors(seed: int, n: int, d: int) -> list[tuple]:
    random = np.random.default_rng(seed)
    return [(i, [float(x) for x in random.normal(size=d).astype(np.float32)], int(random.integers(0, 3))) for i in range(n)]


CASES = {
    "plain": vectors(1, 90, 16),
    "few rows, a length that 8 doesn't divide": vectors(2, 5, 11),
    "ties": [(i, [float((i * 7 + k) % 3) for k in range(8)], None if i % 4 == 0 else 1) for i in range(60)],
    "odd rows": [*vectors(3, 40, 8), (None, [1.0] * 8, 1), (None, [0.5] * 8, None), (3, [2.0] * 8, 2), (3, [2.0] * 8, 2), (50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [math.nan] * 8, 1), (53, [math.inf] * 8, 1), (54, [], 1), (55, [1.0] * 9, 1)],
    "large": [*vectors(4, 30, 8), (90, [1e38] * 8, 1), (91, [-1e300, 1e300] * 4, 2), (92, [1e9, -1e9] * 4, None)],
    "no rows": [],
    "none kept": [(1, None, 1), (2, [], None)],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_against_a_plain_version(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"packed": F.lit(1), "code": F.lit("x")}).repartition(3)
    got = vc.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_codes(rows), key=repr)


def plain_links(rows: list[tuple], threshold: float = 0.9) -> list[tuple]:
    """The contract of op12 by all pairs, in rational numbers near the threshold."""
    good = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = ([Fraction(c) for c in rows[i][1]] for i in (a, b))
                dot = sum(p * q for p, q in zip(x, y, strict=True))
                if dot > 0 and dot * dot >= Fraction(str(threshold)) ** 2 * sum(p * p for p in x) * sum(q * q for q in y):
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, least == vec_id))
    return out


def crowd(n: int, d: int, spread: float, seed: int) -> list[list[float]]:
    random = np.random.default_rng(seed)
    centre = random.normal(size=d)
    return [[float(x) for x in (centre / np.linalg.norm(centre) + random.normal(size=d) * spread / math.sqrt(d)).astype(np.float32)] for _ in range(n)]


def numbered(*groups: list[list[float]]) -> list[tuple]:
    every = [v for g in groups for v in g]
    return [(3 * i + 1, v, i % 2) for i, v in enumerate(every)]


LINKS = {
    "odd rows": [(1, [1.0, 0.0, 0.0, 1.0], 1), (2, [2.0, 0.0, 0.0, 2.0], 1), (2, [1.0, 0.0, 0.0, 1.0], 1), (9, [-0.0, 0.0, 1.0, 0.0], 1), (8, [0.0, -0.0, 1.0, 0.0], 2), (None, [0.0, 0.0, 3.0, 0.1], 2), (None, [0.0, 5.0, 0.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1), (7, [0.0, None, 0.0, 1.0], 1), (10, [math.nan, 1.0, 0.0, 0.0], 1), (11, [1.0], 1), (12, [2.0], 1), (13, [-2.0], 1), (14, [1e300, 0.0, 0.0, 1e300], 1), (15, [1e-300, 0.0, 0.0, 1e-300], 1)],
    "at the threshold": [(1, [10.0, 0.0], 1), (2, [9.0, math.sqrt(19.0)], 1), (3, [3.0, 4.0], 1), (4, [9.0, 0.0], 1), (5, [4.0, 3.0], 1)],
    "no rows": [],
}


@pytest.mark.parametrize("name", LINKS)
def test_links_of_odd_rows(spark, name):
    df = spark.createDataFrame(LINKS[name], SCHEMA).withColumns({"rep": F.lit(1), "entity": F.lit("x")}).repartition(3)
    got = [tuple(r) for r in cp.linked(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(plain_links(LINKS[name]), key=repr)


def by_matrix(rows: list[tuple]) -> list[tuple]:
    m = np.array([v for _, v, _ in rows], np.float64)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label, np.array([label[n].min() if n.any() else len(rows) for n in near]))
        if (least == label).all():
            break
        label = least
    ids = [r[0] for r in rows]
    return [(ids[i], int(near[i].sum()), ids[label[i]], label[i] == i) for i in range(len(rows))]


def test_links_in_crowds(spark, monkeypatch):
    """A dense group becomes a ball, a wide one stays a crowd in blocks, and a fringe is linked with part of a ball."""
    monkeypatch.setattr(cp, "CROWD", 24)
    monkeypatch.setattr(cp, "BLOCK", 16)
    random = np.random.default_rng(0)
    dense = crowd(150, 32, 0.12, 1)
    fringe = [[float(x) for x in np.array(dense[i]) + random.normal(size=32) * 0.45 / math.sqrt(32)] for i in range(40)]
    rows = numbered(dense, crowd(120, 32, 0.36, 2), fringe, crowd(5, 32, 0.3, 3) * 2, [list(map(float, random.normal(size=32))) for _ in range(200)])
    got = {r[0]: tuple(r) for r in cp.linked(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = by_matrix(rows)
    links = sum(w[1] for w in want)
    assert links > 25_000 and len({w[2] for w in want}) > 200
    assert all(got[w[0]][1] <= w[1] for w in want)  # none below the threshold
    assert sum(got[w[0]][1] for w in want) >= 0.999 * links
    assert sum(got[w[0]][2:] == w[2:] for w in want) >= 0.99 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.9 to 0.93 in 64 dimensions, each on its own."""
    random = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        x, z = random.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        c = random.uniform(0.9001, 0.93)
        rows += [(2 * i, [float(v) for v in x], 1), (2 * i + 1, [float(v) for v in c * x + math.sqrt(1 - c * c) * z / np.linalg.norm(z)], 1)]
    got = cp.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["n_links"] for r in got) >= 0.995 * 2 * 1500


def test_hadamard_keeps_lengths_and_buckets_are_of_full_use():
    m = np.random.default_rng(1).normal(size=(50, 16))
    assert np.allclose(np.linalg.norm(cp.hadamard(m), axis=1), np.linalg.norm(m, axis=1))
    assert np.allclose(cp.hadamard(cp.hadamard(m)), m)
    ids = cp.bucket_ids(cp.units(m), 1000)
    assert ids.shape == (50, cp.TABLES, 4) and all(len(set(row.ravel().tolist())) == row.size for row in ids)
    assert cp.hash_length(10**4, 64) == 2 < cp.hash_length(10**8, 64) <= 4
