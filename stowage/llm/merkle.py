"""A Merkle manifest of a dataset: a tree of digests for each language, a tree over the languages, and proofs for every document.

Leaves are digests of whole rows, taken in the JVM. Within a language they stand in the order of doc_id; their numbers come
from a range partitioning, so no task sees a language. The trees are folded in supersteps over RDDs: the nodes of one level
send (place, digest) to their parents, a parent that has heard from all its children (FANOUT at most) hashes them and sends on; a
tree down to one node has its root. Every level is written to the shared folder before the next begins. The supersteps
then go back: a node that knows its way to the root, as pairs of what stands left and right of it in each run, sends each
child its own; the last message goes to runs of leaves, not to the leaves, so a way is sent once for FANOUT documents. A
leaf's proof is checked where its run is.

Digests are lower-case hex sha256 and are concatenated as such text. Cases: a null field counts as "-", so null and empty
texts differ; a null doc_id comes first within its language, equal doc_ids follow their leaf digests, and repeated rows
are leaves of their own; a null language is a language of its own and comes first; an empty table has no rows and no
root; columns that aren't named in the manifest are ignored. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship

FANOUT = 8
#: Nodes of a level for each partition of a superstep.
NODES_A_PARTITION = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands left and right of a node in its run, by level, and the root of its tree.
Way = list[list[str]]


def H(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def row_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field's byte count, a colon and its text, or "-"."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``place``, gapless from 0 in each group by ``order``, and ``of``, the group's number of rows. ``rows`` is a written table.

    Rows are range-partitioned by group and order; a partition's rows of a group are numbered by where they stand, and
    the counts of earlier partitions are added. No window sees more than a row a partition of a group.
    """
    at = "at"
    sort = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright(at, 33)), "ordered")
    counts = dealt.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(each.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "p", "first", before.alias("before"), F.sum("n").over(each).alias("of"))
    met = dealt.join(offsets, dealt[group].eqNullSafe(offsets["g"]) & (dealt["part"] == offsets["p"]))
    return met.select(*[dealt[c] for c in rows.columns], (F.col(at) - F.col("first") + F.col("before")).alias("place"), F.col("of").cast("long").alias("of"))


#: A run: its tree, the number of its parent, how many nodes the tree has on the level of the children, the parent's digest, and the children; leaves carry doc_id and claim.
RUN = "tree string, node long, of long, digest string, children array<struct<digest: string, doc_id: long, claim: string>>"


def climb(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(runs by level, roots of the trees) of ``nodes``: tree, place, of, digest, doc_id, claim. ``most`` is the size of the largest tree."""
    spark, levels, tops = nodes.sparkSession, [], []
    level, height, total = nodes, 0, nodes.count()
    while True:
        tops.append(level.filter("of = 1").select("tree", "digest", F.lit(height).alias("height")))
        if most <= 1:
            return levels, _union(tops)
        messages = level.filter("of > 1").select("tree", "place", "of", "digest", "doc_id", "claim").rdd.map(to_parent)
        parts = max(1, math.ceil(total / NODES_A_PARTITION))
        runs = spark.createDataFrame(messages.groupByKey(parts).map(complete), RUN)  # FANOUT messages a parent at most
        runs = materialize(runs, f"{name}_{height + 1}")
        levels.append(runs)
        above = F.ceil(F.col("of") / FANOUT).cast("long")
        level = runs.select("tree", F.col("node").alias("place"), above.alias("of"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claim"))
        height, total, most = height + 1, math.ceil(total / FANOUT), math.ceil(most / FANOUT)


def to_parent(row) -> tuple:
    return (row["tree"], row["place"] // FANOUT), (row["place"] % FANOUT, row["of"], row["digest"], row["doc_id"], row["claim"])


def complete(met: tuple) -> tuple:
    """A parent that has heard from all its children: its run and its digest."""
    (tree, node), messages = met
    heard = sorted(messages, key=lambda m: m[0])
    of = heard[0][1]
    if [m[0] for m in heard] != list(range(min(FANOUT, of - FANOUT * node))):
        raise ValueError(f"node {node} of {tree!r} has heard from {[m[0] for m in heard]} of {of}")
    return tree, node, of, H(*(m[2] for m in heard)), [(m[2], m[3], m[4]) for m in heard]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def beside(run, i: int) -> list[str]:
    """What stands left and right of a child."""
    digests = [c["digest"] for c in run["children"]]
    return ["".join(digests[:i]), "".join(digests[i + 1 :])]


def to_children(met: tuple) -> Iterator[tuple]:
    """The way of every child of a node, by the child's (tree, number)."""
    (tree, node), (way, run) = met
    for i in range(len(run["children"])):
        yield (tree, FANOUT * node + i), (way[0], [beside(run, i), *way[1]])


def descend(levels: list[DataFrame], ways: RDD, sizes: list[int]) -> RDD:
    """((tree, number), (way, run)) of the runs of the lowest level, when ``ways`` has ((tree, height), (root of the tree, way)) of each tree's root."""
    at = None
    for height in range(len(levels), 0, -1):
        parts = max(1, math.ceil(sizes[height - 1] * FANOUT / NODES_A_PARTITION))  # a run has its children with it
        begun = ways.filter(lambda w, h=height: w[0][1] == h).map(lambda w: ((w[0][0], 0), w[1]))
        at = begun if at is None else at.union(begun)
        runs = levels[height - 1].rdd.map(lambda r: ((r["tree"], r["node"]), r))
        at = at.join(runs, parts)
        if height > 1:
            at = at.flatMap(to_children)
    return at


def folded(digest: str, way: Way) -> str:
    for left, right in way:
        digest = H(left, digest, right)
    return digest


def proof(way: Way) -> str:
    return H(*(side for pair in way for side in pair))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass
class Manifest:
    """``leaves``: tree, place, of, digest, doc_id, claim; ``levels``: the runs over them; ``subroots``: tree, digest, height, place, of; ``top``: runs over the subroots; ``root``."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    count: int

    def verified(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed digest along the proof) and verified of every leaf."""
        spark, root = self.leaves.sparkSession, self.root
        if root is None:
            return spark.createDataFrame([], RESULT)
        total, sizes = self.count, []
        for _ in self.levels:
            total = math.ceil(total / FANOUT)
            sizes.append(total)
        subroots = self.subroots.select("tree", "digest", "height", "place")
        if self.top:  # the top tree's leaves are the languages' roots, its last runs know them by place
            start = spark.sparkContext.parallelize([(("", len(self.top)), (root, []))], 1)
            met = descend(self.top, start, [NODES_A_PARTITION] * len(self.top)).flatMap(to_children)
            above = met.map(lambda m: (m[0][1], m[1][1]))
            ways = subroots.rdd.map(lambda r: (r["place"], ((r["tree"], r["height"]), r["digest"]))).join(above).map(lambda m: (m[1][0][0], (m[1][0][1], m[1][1])))
        else:
            ways = subroots.rdd.map(lambda r: ((r["tree"], r["height"]), (r["digest"], [])))
        kept = spark.createDataFrame(ways.map(lambda w: (w[0][0], w[0][1], w[1][0], w[1][1])), "tree string, height int, subroot string, way array<array<string>>")
        ways = materialize(kept, "ways").rdd.map(lambda r: ((r["tree"], r["height"]), (r["subroot"], [list(x) for x in r["way"]])))

        def judged(doc_id: int | None, leaf: str, claim: str | None, subroot: str, way: Way) -> tuple:
            end = folded(claim or leaf, way)
            return doc_id, leaf, subroot, root, proof(way), end, end == root

        def of_run(met: tuple) -> Iterator[tuple]:
            _, ((subroot, way), run) = met
            for i, c in enumerate(run["children"]):
                yield judged(c["doc_id"], c["digest"], c["claim"], subroot, [beside(run, i), *way])

        lone = self.leaves.filter("of = 1").rdd.map(lambda r: (r["tree"], r)).join(ways.filter(lambda w: w[0][1] == 0).map(lambda w: (w[0][0], w[1])))
        out = lone.map(lambda m: judged(m[1][0]["doc_id"], m[1][0]["digest"], m[1][0]["claim"], *m[1][1]))
        if self.levels:
            out = out.union(descend(self.levels, ways, sizes).flatMap(of_run))
        return spark.createDataFrame(out, RESULT)


def manifest(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``claim`` is the digest of what another copy of a row has, where it differs or not (null: as here)."""
    ship(docs.sparkSession)
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long"), row_digest([F.col(c) for c in FIELDS]).alias("digest"), claim.alias("claim"))
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = materialize(numbered(leaves, "tree", ["doc_id", "digest", "row"]).drop("row"), "numbered_leaves")
    count, most = leaves.agg(F.count(F.lit(1)), F.coalesce(F.max("of"), F.lit(0))).first()
    levels, tops = climb(leaves, most, "level")
    subroots = materialize(tops.withColumn("all", F.lit("")), "subroots")
    subroots = materialize(numbered(subroots, "all", ["tree"]), "numbered_subroots")
    n = subroots.count()
    nodes = subroots.select(F.lit("").alias("tree"), "place", "of", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claim"))
    top, roots = climb(nodes, n, "top")
    found = roots.select("digest").collect()  # one, or none for an empty table
    return Manifest(leaves, levels, subroots, top, found[0][0] if found else None, count)


def tampered(docs: DataFrame) -> Column:
    """The digest of a row whose text's A-Z are lower-cased, for those whose doc_id's crc32 3 divides."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lower if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, row_digest(fields))


def audited(docs: DataFrame) -> DataFrame:
    """What verification finds when every third document or so has been tampered with."""
    return manifest(docs, tampered(docs)).verified()


def sql(levels: int = 8) -> str:
    """The rows of op13 in DuckDB's SQL, for languages of up to FANOUT ** levels documents and as many languages."""
    enc = lambda e: f"coalesce(octet_length(encode({e}))::VARCHAR || ':' || {e}, '-')"
    row = lambda t: f"sha256({' || '.join(enc(e) for e in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', t))})"
    crc = "xor(list_reduce(list_prepend(4294967295, range(8 * len(doc_id::VARCHAR))::BIGINT[]), lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END) >> 1, CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"l AS (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(low)} ELSE {row('text')} END AS claim FROM documents)"]
    out.append("u0 AS (SELECT coalesce('l' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, doc_id, claim FROM l)")

    def climbing(nodes: str, up: str) -> str:
        for k in range(levels):
            out.append(f"{up}n{k} AS (SELECT tree, count(*) AS n FROM {nodes} GROUP BY tree)")
            out.append(f"{up}{k + 1} AS (SELECT tree, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {nodes} JOIN {up}n{k} USING (tree) GROUP BY tree, i // {FANOUT})")
            nodes = f"{up}{k + 1}"
        return nodes

    top = climbing("u0", "u")
    out.append(f"v0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, tree AS of, d FROM {top})")
    end = climbing("v0", "v")
    out.append("w0 AS (SELECT doc_id, tree, i, d AS leaf, '' AS proof, claim AS f FROM u0)")
    for up, at in (("u", "w"), ("v", "x")):
        for k in range(levels):
            left, right = (f"coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i {c} w.i), '')" for c in "<>")
            key = "w.tree" if up == "u" else "''"
            out.append(
                f"{at}{k + 1} AS (SELECT w.doc_id, w.tree, w.i // {FANOUT} AS i, any_value(leaf) AS leaf, any_value(w.proof) || {left} || {right} AS proof, CASE WHEN any_value(n) = 1 THEN any_value(f) ELSE sha256({left} || any_value(f) || {right}) END AS f, row"
                f" FROM (SELECT *{', row_number() OVER () AS row' if up == 'u' and k == 0 else ''} FROM {at}{k}) w JOIN {up}n{k} c ON c.tree = {key} JOIN {up}{k} s ON s.tree = c.tree AND s.i // {FANOUT} = w.i // {FANOUT} GROUP BY ALL)"
            )
        if up == "u":
            out.append(f"x0 AS (SELECT doc_id, w.tree, v0.i, leaf, proof, f, row FROM {at}{levels} w JOIN v0 ON v0.of = w.tree)")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, v0.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM x{levels} x JOIN v0 ON v0.of = x.tree, {end} r"
