"""Vector code compression: eight codebooks of sixteen integer entries, learned by rounds of assignment and averaging.

A component x becomes floor(4096 * x); a vector is cut into PARTS equal parts. Each round, tasks look up the nearest entry
of every part in a vantage-point tree over the entries of that part position and send one sum an entry used, which are
added up; only the codebooks (PARTS * ENTRIES entries, of fixed size) come to the driver and go out again.

The search is a branch and bound over many parts at a time. Distances from a vantage point are rounded to whole numbers,
away from what they bound, so that no rounding can shut out the nearest entry; a subtree whose bound equals the best
distance is visited too, as it may hold an entry of a lower index; and what decides is the squared distance in whole
numbers. Values too large for 64-bit squares go through Python's own integers, by the same code.

Cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another length
than the kept vector of the smallest vec_id; a length that PARTS doesn't divide is filled up with zeros. Of rows with equal
vec_ids the one of the smaller values goes first into the codebook (of values beyond NARROW, of the smaller text), null vec_ids last; with fewer than ENTRIES rows the
codebooks are as small. An error beyond a long is the largest long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .vectors import matrices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Values below this have squared distances (of up to 16 components) that 64 bits hold.
NARROW = 1 << 28
#: Entries that a node of the tree compares one by one.
LEAF = 2
LARGEST = (1 << 63) - 1

_exact_floor = np.frompyfunc(lambda x: math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE, 1, 1)
_exact_root = np.frompyfunc(math.isqrt, 1, 1)


def scaled(m: np.ndarray) -> np.ndarray:
    """floor(4096 * x), as 64-bit integers where that is safe, else as Python's."""
    with np.errstate(over="ignore"):
        out = np.floor(m * SCALE)
    if not m.size or np.abs(out).max() < NARROW:
        return out.astype(np.int64)
    return _exact_floor(m.astype(object))


def widest(m: np.ndarray) -> int:
    return int(np.abs(m).max()) if m.size else 0


def packed(row: np.ndarray) -> bytes:
    """Four bytes a component, in the order of the values, or decimal numbers behind a comma (which no narrow one begins with)."""
    return (row.astype(np.int64) + (1 << 31)).astype(">u4").tobytes() if widest(row) < NARROW else b"," + ",".join(map(str, row)).encode()


def unpacked(column: pa.Array, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integers of shape rows x parts x components) of packed vectors, the narrow ones and then the wide ones."""
    cells = column.to_pylist()
    wide = np.fromiter((c.startswith(b",") for c in cells), bool, len(cells))
    narrow = np.flatnonzero(~wide)
    if len(narrow):
        flat = np.frombuffer(b"".join(cells[i] for i in narrow), ">u4").astype(np.int64) - (1 << 31)
        yield narrow, flat.reshape(len(narrow), parts, -1)
    for i in np.flatnonzero(wide):
        yield np.array([i]), np.array([int(v) for v in cells[i].decode()[1:].split(",")], object).reshape(1, parts, -1)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers not above and not below the square roots."""
    if squares.dtype == object:
        low = _exact_root(squares)
        return low, low + 1
    low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return np.maximum(low - 1, 0), low + 2


@dataclass
class Node:
    """A vantage point and two subtrees, each with bounds of its entries' distances from the point; or a few ``entries``."""

    entries: list[int]
    near: Node | None = None
    far: Node | None = None
    near_bounds: tuple[int, int] = (0, 0)
    far_bounds: tuple[int, int] = (0, 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def tree(codebook: np.ndarray, among: list[int]) -> Node:
    if len(among) <= LEAF + 1:
        return Node(among)
    point, rest = among[0], among[1:]
    square = squares(codebook[rest], codebook[point])
    order = sorted(range(len(rest)), key=lambda i: (square[i], rest[i]))
    half = len(order) // 2
    sides = order[:half], order[half:]
    bounds = [(int(roots(square[s].min(keepdims=True))[0][0]), int(roots(square[s].max(keepdims=True))[1][0])) for s in map(list, sides)]
    near, far = (tree(codebook, sorted(rest[i] for i in s)) for s in sides)
    return Node([point], near, far, *bounds)


def nearest(parts: np.ndarray, codebook: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, the lower index on ties."""
    if codebook.dtype == object:
        parts = parts.astype(object)
    index = np.full(len(parts), root.entries[0], np.int64)
    best = squares(parts, codebook[root.entries[0]])

    def look(e: int, who: np.ndarray) -> np.ndarray:
        square = squares(parts[who], codebook[e])
        better = ((square < best[who]) | ((square == best[who]) & (e < index[who]))).astype(bool)
        best[who[better]] = square[better]
        index[who[better]] = e
        return square

    def visit(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        for e in node.entries[1:] if node.near is None else ():
            look(e, who)
        low, high = roots(look(node.entries[0], who))
        if node.near is None:
            return
        first = (low <= node.near_bounds[1]).astype(bool)
        sides = (node.near, node.near_bounds), (node.far, node.far_bounds)
        for group, order in ((first, sides), (~first, sides[::-1])):
            mine, l, h = who[group], low[group], high[group]
            for child, (least, most) in order:
                bound = np.maximum(l - most, least - h)
                may = (bound <= roots(best[mine])[1]).astype(bool)
                visit(child, mine[may])

    visit(root, np.arange(len(parts)))
    return index, best


def assigned(column: pa.Array, codebooks: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, integers, indexes by part, squared distances by part) of packed vectors."""
    for rows, values in unpacked(column, len(codebooks)):
        found = [nearest(values[:, p], codebooks[p], trees[p]) for p in range(len(codebooks))]
        yield rows, values, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def kept_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, dims and packed of the rows that are kept."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in matrices(batch["v"]):
                whole = scaled(m)
                if m.shape[1] % PARTS:
                    whole = np.concatenate([whole, np.zeros((len(m), -m.shape[1] % PARTS), whole.dtype)], 1)
                cells, at = [packed(r) for r in whole], pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["label"].take(at), pa.array(np.full(len(rows), m.shape[1], np.int32)), pa.array(cells, pa.binary())], names=["vec_id", "label", "dims", "packed"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col(column).cast("array<double>").alias("v"))
    return given.mapInArrow(pack, "vec_id long, label string, dims int, packed binary")


def entry_sums(kept: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, sums): the parts that are nearest to each entry, one row a task and entry, added up; sums are decimal numbers of any length."""
    trees = [tree(c, list(range(len(c)))) for c in codebooks]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for _, values, index, _ in assigned(batch["packed"], codebooks, trees):
                for p in range(len(codebooks)):
                    total = np.zeros((len(codebooks[p]), values.shape[2]), values.dtype)
                    np.add.at(total, index[:, p], values[:, p])
                    for e, n in enumerate(np.bincount(index[:, p], minlength=len(codebooks[p])).tolist()):
                        if n:
                            counts[p, e] = counts.get((p, e), 0) + n
                            sums[p, e] = [a + int(b) for a, b in zip(sums.get((p, e), [0] * values.shape[2]), total[e], strict=True)]
        yield as_batch(counts, sums)

    def add(table: pa.Table) -> pa.Table:
        p, e = table["part"][0].as_py(), table["entry"][0].as_py()
        total = [sum(map(int, column)) for column in zip(*table["sums"].to_pylist(), strict=True)]
        return pa.Table.from_batches([as_batch({(p, e): sum(table["n"].to_pylist())}, {(p, e): total})])

    def as_batch(counts: dict, sums: dict) -> pa.RecordBatch:
        at = sorted(counts)
        columns = [pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([counts[k] for k in at], pa.int64()), pa.array([[str(v) for v in sums[k]] for k in at], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    shape = "part int, entry int, n long, sums array<string>"
    return kept.select("packed").mapInArrow(partial, shape).groupBy("part", "entry").applyInArrow(add, shape)


def as_codebook(entries: list[list[int]]) -> np.ndarray:
    widest_ = max((abs(v) for e in entries for v in e), default=0)
    return np.array(entries, np.int64 if widest_ < NARROW else object)


def learned(kept: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of all part positions after ``rounds`` rounds."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "packed").limit(ENTRIES).collect()
    rows = [values[0] for r in first for _, values in unpacked(pa.array([bytes(r["packed"])], pa.binary()), PARTS)]
    codebooks = [as_codebook([[int(v) for v in r[p]] for r in rows]) for p in range(PARTS)] if rows else []
    for _ in range(rounds if rows else 0):
        entries = [[list(map(int, e)) for e in c] for c in codebooks]
        for r in entry_sums(kept, codebooks).collect():  # PARTS * ENTRIES rows at most
            entries[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["sums"]]
        codebooks = [as_codebook(e) for e in entries]
    return codebooks


def coded(kept: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (decimal) of every kept vector."""
    trees = [tree(c, list(range(len(c)))) for c in codebooks]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, index, square in assigned(batch["packed"], codebooks, trees):
                at = pa.array(rows)
                codes = [bytes(r).hex() for r in index.astype(np.uint8)]
                errors = [str(min(sum(map(int, r)), LARGEST)) for r in square]
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["label"].take(at), pa.array(codes, pa.string()), pa.array(errors, pa.string())], names=["vec_id", "label", "code", "error"])

    out = kept.select("vec_id", "label", "packed").mapInArrow(code, "vec_id long, label string, code string, error string")
    return out.withColumn("error", F.col("error").cast("decimal(20,0)"))


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for c in codebooks for e in c for v in e).encode()).hexdigest()


def compressed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256 of every kept vector."""
    ship(vectors.sparkSession)
    kept = materialize(kept_vectors(vectors, column), "kept_vectors")
    dims = kept.orderBy(F.col("vec_id").asc_nulls_last(), "packed").select("dims").limit(1).collect()
    kept = kept.filter(F.col("dims") == (dims[0][0] if dims else 0))
    codebooks = learned(kept)
    rows = materialize(coded(kept, codebooks), "codes") if codebooks else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("decimal(20,0)").alias("error"))
    most = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    totals = rows.groupBy(F.col("label").alias("of")).agg(most(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", F.col("error").cast("long").alias("error"), "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The rows of op11 in DuckDB's SQL, for values that 64 bits hold."""
    steps = [
        f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"""
    ]
    near = "SELECT vec_id, label, part, v, min(struct_pack(d := d, e := entry)) AS m FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} USING (part)) GROUP BY ALL"
    for r in range(rounds):
        steps.append(f"a{r} AS ({near.format(r=r)})")
        steps.append(
            f"s{r} AS (SELECT part, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT part, m.e AS entry, i, sum(v[i]) AS t, count(*) AS n FROM a{r}, range(1, (SELECT max(len(v)) + 1 FROM p)) g(i) GROUP BY ALL) GROUP BY ALL)"
        )
        steps.append(f"c{r + 1} AS (SELECT part, entry, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} s USING (part, entry))")
    steps.append(f"f AS ({near.format(r=rounds)})")
    steps.append("e AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM f GROUP BY ALL)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h"
