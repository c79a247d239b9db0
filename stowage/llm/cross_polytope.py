"""Near duplicates among embeddings: cross-polytope hashing, multiprobe buckets, verified pairs.

Equal vectors fall together at once and go on as one representative with a count. A hash rotates a vector by three
fast Hadamard transforms with random signs and takes the axis, with its sign, that it lies nearest to; a bucket is the
joint value of ``hash_length`` hashes, of TABLES tables. A vector has its own bucket in each table and those of its
next-best values (4 ** (length - 1) buckets); two vectors meet where one's own bucket is among the other's. At a cosine of
just 0.9 in 64 dimensions they do with a probability of some 0.999 (measured on 4,000 random pairs; a test holds 1,500 pairs at 0.90 to 0.93).

Dense groups never meet in pairs. While a bucket holds more than CROWD vectors of their own, one of them is a pivot, and those so
near to it that any two of them are linked for certain (half the angle) become one ball. Balls and single vectors are
the entities that go on: a bucket sees an entity once, as its centre, in one byte a component, with a radius. Entities that
may hold a linked pair, by bounds that count in rounding, are candidates. Candidates are verified in double precision on all
members of both, in blocks of BLOCK members, which give counts of links and not pairs; within a ball all are linked, which is counted by its size.
Components are made of entities. A bucket that stays crowded without being dense is compared in blocks, whole.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; those of different lengths aren't linked. Repeated rows are vectors of their own (equal vec_ids too, of which
each counts its links). With a null vec_id, a row is linked like any other, its own component is null, and it is kept where
that is. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .minhash import MIX, components, scramble
from .vectors import matrices

TABLES, RANKS, SEED = 8, 4, 5
#: Vectors that share a bucket by chance, about, and what a bucket holds before pivots are taken; rows of a block.
LOAD, CROWD, BLOCK = 200, 256, 256
#: What a pivot must gather of a crowd to go on with it.
DENSE = 1 / 16
#: Rounding that bounds allow for.
SLACK = 1e-5


def hadamard(m: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, of unit scale; the width is a power of two."""
    n, h = m.shape[-1], 1
    while h < n:
        pairs = m.reshape(len(m), -1, 2, h)
        m = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(m), n)
        h *= 2
    return m / math.sqrt(n)


def hash_length(n: int, width: int) -> int:
    """Hashes a bucket, so that some LOAD of n unrelated vectors share one."""
    return max(2, math.ceil(math.log(max(n, 2) / LOAD) / math.log(2 * width) - 1e-9))


def bucket_ids(unit: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers of unit vectors, of shape rows x tables x buckets; the first of each table is a vector's own."""
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    length, ranks, random = hash_length(n, width), min(RANKS, width), np.random.default_rng([SEED, width])
    combos = np.array(list(itertools.product(range(ranks), repeat=length)))
    probes, out = max(1, len(combos) // RANKS), []
    for table in range(TABLES):
        cost, code = np.zeros((len(unit), len(combos))), np.zeros((len(unit), len(combos)), np.uint64)
        for k in range(length):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            order = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            top = np.take_along_axis(size, order, 1)
            values = (2 * order + (np.take_along_axis(turned, order, 1) < 0)).astype(np.uint64)
            cost += ((top[:, :1] - top) ** 2)[:, combos[:, k]]
            code = code * np.uint64(2 * width) + values[:, combos[:, k]]
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]  # the first has no cost
        tag = np.uint64((table + 1) * MIX[0] + unit.shape[1] * MIX[2] & (1 << 64) - 1)
        out.append(scramble(scramble(np.take_along_axis(code, best, 1)) ^ tag))
    return np.stack(out, 1)


def levelled(m: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay as they are, squares can't overflow."""
    _, exponent = np.frexp(np.abs(m).max(1))
    return np.ldexp(m, -exponent[:, None])


def representatives(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, digest (null for vectors that link with nothing) and vector (doubles) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[bytes | None] = [None] * len(batch)
            for rows, m in matrices(batch["v"]):
                some = np.abs(m).max(1) > 0
                for i, v in zip(rows[some], levelled(m[some] + 0.0), strict=True):
                    cells[i] = v.tobytes()
            digests = [c and hashlib.blake2b(c, digest_size=16).digest() for c in cells]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(digests, pa.binary()), pa.array(cells, pa.binary())], names=["vec_id", "digest", "vector"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("v"))
    return given.mapInArrow(read, "vec_id long, digest binary, vector binary")


def stacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of vectors by length."""
    cells = column.to_pylist()
    sizes = np.fromiter(map(len, cells), np.int64, len(cells))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(cells[i] for i in rows), np.float64).reshape(len(rows), -1)


def units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def entries_of(reps: DataFrame, n: int) -> DataFrame:
    """(bucket, rep, own) of every representative."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps_ = np.asarray(batch["rep"])
            for rows, m in stacked(batch["vector"]):
                for a in range(0, len(rows), 4096):
                    ids = bucket_ids(units(m[a : a + 4096]), n)
                    own = np.zeros(ids.shape, bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(ids.reshape(-1).view(np.int64)), pa.array(np.repeat(reps_[rows[a : a + 4096]], ids[0].size)), pa.array(own.reshape(-1))], names=["bucket", "rep", "own"])

    return reps.select("rep", "vector").mapInArrow(hashed, "bucket long, rep long, own boolean")


def cosines_to(pairs: DataFrame) -> DataFrame:
    """Add cosine to rows with vector and centre (of one length)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(len(batch))
            for rows, m in stacked(batch["vector"]):
                at = batch["centre"].take(pa.array(rows))
                for some, c in stacked(at):
                    found[rows[some]] = (units(m[some]) * units(c)).sum(1)
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["pivot"], pa.array(found)], names=["rep", "pivot", "cosine"])

    return pairs.select("rep", "pivot", "vector", "centre").mapInArrow(measure, "rep long, pivot long, cosine double")


def balls(reps: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(rep, entity, cosine): the balls of crowded buckets, each representative in one at most; cosine is that to the pivot."""
    inner = math.sqrt((1 + threshold) / 2) + 1e-9  # within half the angle
    found = materialize(reps.select("rep", F.col("rep").alias("entity"), F.lit(1.0).alias("cosine")).limit(0), "no_balls")
    # Which pivot a bucket takes, and a vector with several, goes by this; it is the same one in all tables more often than not.
    turn = F.xxhash64("rep", F.lit(SEED))
    done = entries.select("bucket").limit(0)
    while True:
        loose = entries.join(found.select("rep"), "rep", "left_anti")
        crowds = loose.groupBy("bucket").agg(F.count_if("own").alias("n"), F.min(F.struct(turn.alias("turn"), "rep")).alias("pivot")).filter(F.col("n") > CROWD)
        crowds = materialize(crowds.join(done, "bucket", "left_anti").select("bucket", "n", F.col("pivot.rep").alias("pivot")), "crowds")
        if crowds.isEmpty():
            return found
        met = loose.join(crowds, "bucket").select("rep", "pivot").distinct()
        pivots = met.select("pivot").distinct().join(reps.select(F.col("rep").alias("pivot"), F.col("vector").alias("centre"), F.col("size").alias("width")), "pivot")
        offered = met.join(reps.select("rep", "vector", "size"), "rep").join(pivots, "pivot").filter("size = width")
        near = cosines_to(offered).filter(F.col("cosine") >= inner)
        taken = near.groupBy("rep").agg(F.min(F.struct(F.xxhash64("pivot", F.lit(SEED)).alias("turn"), F.col("pivot").alias("entity"), "cosine")).alias("b")).select("rep", "b.entity", "b.cosine")
        taken = materialize(taken, "balls")
        gone = loose.filter("own").join(taken.select("rep"), "rep", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("gone"))
        settled = crowds.join(gone, "bucket", "left").filter(F.coalesce("gone", F.lit(0)) < F.col("n") * DENSE).select("bucket")
        done = materialize(done.unionByName(settled), "settled")
        found = found.unionByName(taken)


def coarse(centres: DataFrame) -> DataFrame:
    """entity, code (a signed byte a component), step, error (distance from the unit vector at most) and radius (an angle)."""

    def quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, radius = np.asarray(batch["entity"]), np.asarray(batch["radius"])
            for rows, m in stacked(batch["vector"]):
                u = units(m)
                step = np.abs(u).max(1) / 127
                code = np.rint(u / step[:, None]).astype(np.int8)
                error = np.sqrt(((u - code * step[:, None]) ** 2).sum(1)) + 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error), pa.array(radius[rows])], names=["entity", "code", "step", "error", "radius"])

    return centres.select("entity", "vector", "radius").mapInArrow(quantize, "entity long, code binary, step double, error double, radius double")


def candidates(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of entities that share a bucket, one of them by its own, and may hold a pair of the threshold.

    ``met`` has bucket, i, j (a pair of blocks of the bucket), side and an entity's columns; a partition has each such group whole.
    """
    angle = math.acos(threshold)

    def compare(g: dict[str, np.ndarray], codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32) * g["step"][:, None].astype(np.float32)
        error, radius, own, entity, side = g["error"], g["radius"], g["own"], g["entity"], g["side"]
        inside = side == 0
        left = np.flatnonzero(inside)
        right = left if g["i"][0] == g["j"][0] else np.flatnonzero(~inside)
        if not len(left) or not len(right):
            return entity[:0], entity[:0]
        product = code[left] @ code[right].T
        least = np.cos(np.minimum(angle + radius[left][:, None] + radius[right], math.pi))
        slack = error[left][:, None] + error[right] + error[left][:, None] * error[right] + SLACK
        hit = (product >= least - slack) & (own[left][:, None] | own[right])
        x, y = np.nonzero(hit)
        a, b = entity[left[x]], entity[right[y]]
        apart = a < b if right is left else a != b
        return np.minimum(a, b)[apart], np.maximum(a, b)[apart]

    names = ("bucket", "i", "j", "side", "entity", "own", "step", "error", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group of a batch, which may go on in the next
        for batch in itertools.chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not len(table):
                continue
            g = {c: table[c].to_numpy() for c in names}
            codes = table["code"].to_pylist()
            sizes = np.fromiter(map(len, codes), np.int64, len(codes))
            change = np.flatnonzero((np.diff(g["bucket"]) != 0) | (np.diff(g["i"]) != 0) | (np.diff(g["j"]) != 0)) + 1
            ends = [*change.tolist(), *([len(table)] if batch is None else [])]
            begin, found = 0, []
            for end in ends:
                if end - begin > 1:
                    for size in np.unique(sizes[begin:end]):
                        at = begin + np.flatnonzero(sizes[begin:end] == size)
                        found.append(compare({c: v[at] for c, v in g.items()}, [codes[i] for i in at]))
                begin = end
            held = table.slice(begin) if batch is not None else None
            if found:
                pairs = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    parts = met.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = met.select(*names, "code").repartition(int(parts), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket and an entity's columns) with i, j and side: a bucket of more than BLOCK is cut into blocks by a hash, each pair of which is a group."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("entity", F.lit(SEED)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("*", other)
    return met.select(*rows.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))


def blocks_of(members: DataFrame) -> DataFrame:
    """(entity, block, reps, counts, vectors): members of an entity, about BLOCK a block, as arrays of bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["entity"],
                    pa.array([np.array([m["rep"] for m in ms], np.int64).tobytes() for ms in rows["m"]], pa.binary()),
                    pa.array([np.array([m["count"] for m in ms], np.int64).tobytes() for ms in rows["m"]], pa.binary()),
                    pa.array([b"".join(m["vector"] for m in ms) for ms in rows["m"]], pa.binary()),
                ],
                names=["entity", "reps", "counts", "vectors"],
            )

    # Only entities of more than a block are looked up, and these are few; the others have one.
    sizes = members.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = members.join(sizes, "entity", "left").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.coalesce("blocks", F.lit(1))))
    grouped = dealt.repartition("entity", "block").groupBy("entity", "block").agg(F.collect_list(F.struct("rep", "count", "vector")).alias("m"))  # about BLOCK members
    return grouped.select("entity", "m").mapInArrow(pack, "entity long, reps binary, counts binary, vectors binary")


def reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the cosine of two vectors reaches the threshold, in rational numbers."""
    exact = lambda a, b: sum((Fraction(p) * Fraction(q) for p, q in zip(a.tolist(), b.tolist(), strict=True)), Fraction(0))
    dot = exact(x, y)
    return dot >= 0 and dot * dot >= Fraction(str(threshold)) ** 2 * exact(x, x) * exact(y, y)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of the threshold or more. Cosines that rounding might move across it are decided exactly."""
    cosine = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))
    hit = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
        hit[i, j] = reaches(x[i], y[j], threshold)
    return hit


def verified(pairs: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(kind, x, y): for kind 0, y vectors more are linked with representative x; for kind 1, entities x and y are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: Counter = Counter()
            edges = set()
            cells = {c: batch[c].to_pylist() for c in ("a", "b", "reps_a", "reps_b", "counts_a", "counts_b", "vectors_a", "vectors_b")}
            for a, b, ra, rb, ca, cb, va, vb in zip(*cells.values(), strict=True):
                ra, rb, ca, cb = (np.frombuffer(v, np.int64) for v in (ra, rb, ca, cb))
                x, y = np.frombuffer(va, np.float64).reshape(len(ra), -1), np.frombuffer(vb, np.float64).reshape(len(rb), -1)
                hit = linked_pairs(x, y, threshold)
                if hit.any():
                    edges.add((a, b))
                    for reps, more in ((ra, hit @ cb), (rb, hit.T @ ca)):
                        for r, n in zip(reps[more > 0].tolist(), more[more > 0].tolist(), strict=True):
                            links[r] += n
            rows = [(0, r, n) for r, n in links.items()] + [(1, a, b) for a, b in edges]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["kind", "x", "y"])

    side = lambda c: blocks.select(F.col("entity").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("reps", "counts", "vectors")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{k}_{c}" for k in ("reps", "counts", "vectors") for c in "ab"])
    return met.mapInArrow(verify, "kind int, x long, y long")


def linked(vectors: DataFrame, threshold: float = 0.9, column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable, itself included) and kept of every row."""
    ship(vectors.sparkSession)
    rows = materialize(representatives(vectors, column), "vectors")
    reps = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("count"), F.min("vec_id").alias("least"))
    reps = materialize(reps.select("*", F.monotonically_increasing_id().alias("rep"), F.octet_length("vector").alias("size")), "representatives")
    entries = materialize(entries_of(reps, reps.count()), "entries")
    of_ball = materialize(balls(reps, entries, threshold), "ball_members")

    members = reps.join(of_ball, "rep", "left").select("rep", "count", "least", "vector", F.coalesce("entity", "rep").alias("entity"), F.coalesce("cosine", F.lit(1.0)).alias("cosine"), F.col("entity").isNotNull().alias("balled"))
    # A pivot that another ball has taken still is the centre of its own; a number of its own keeps the two apart.
    members = materialize(members.withColumn("entity", F.col("entity") * 2 + F.col("balled").cast("long")), "members")
    radius = F.when(F.col("cosine") < 1, F.acos("cosine") + 1e-6).otherwise(F.when(F.col("balled"), 1e-6).otherwise(0.0))
    sized = members.groupBy("entity").agg(F.max(radius).alias("radius"), F.sum("count").alias("total"), F.min("least").alias("least"))
    sized = materialize(sized, "entities")
    centres = sized.withColumn("rep", F.shiftright("entity", 1)).join(reps.select("rep", "vector"), "rep")
    codes = coarse(centres)
    own = entries.join(members.select("rep", "entity"), "rep").groupBy("bucket", "entity").agg(F.bool_or("own").alias("own"))
    met = in_blocks(materialize(own, "entity_entries")).join(materialize(codes, "codes"), "entity")
    pairs = materialize(candidates(met, threshold), "candidates")

    checked = materialize(verified(pairs, materialize(blocks_of(members), "blocks"), threshold), "verified")
    labels = components(checked.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    classes = materialize(sized.join(labels, sized["entity"] == labels["node"], "left").select("entity", "total", "least", F.coalesce("label", "entity").alias("label")), "classes")
    component = materialize(classes.groupBy("label").agg(F.min("least").alias("component")), "components")
    found = classes.join(component, "label").select("entity", "total", "component")
    more = checked.filter("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("more"))
    of_rep = members.select("rep", "entity").join(found, "entity").join(more, "rep", "left").select("rep", (F.col("total") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component")
    of_digest = materialize(of_rep.join(reps.select("rep", "digest"), "rep").select("digest", "n_links", "component"), "links_of_vector")
    out = rows.select("vec_id", "digest").join(of_digest, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


#: The rows of op12 in DuckDB's SQL, all pairs compared.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT vec_id, least(vec_id, coalesce(min(y), vec_id)) AS component_id FROM v LEFT JOIN reach ON x = vec_id GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
"""
