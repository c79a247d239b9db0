"""Near-duplicate detection by bottom-k sketches of one hash function.

A document's set is its distinct w-word shingles, held as 64-bit hashes. Its sketch is the k least hashes.

1. Documents with equal sets fall together at once, by a 128-bit digest of the set (pre-aggregated), and go on as one
   numbered representative each, so copies never meet in pairs.
2. Inverted lists of retained values give overlaps. A pair above the threshold shares at least ``least_shared`` of its
   retained values (20 of 40 at 85 %, 17 of 40 at 80 %), but for a chance, by the binomial for a pair just at the
   threshold, of 3.5e-8 at 85 % and of 3.5e-8 at 80 %; two sketches that share m values must meet in the lists of all but
   m - 1 of their values, the rarest first, so only those lists are made, and a passage that many documents share makes
   no long list.
3. Lists with no more pairs than one of ``SHORT_LIST`` members compare them all. In a longer one every member is compared with its pivot, the one with
   the most widely shared values. Members of the pivot's component are done with each other. For the rest, new lists are
   made of what sets a member apart from the pivot: the symmetric difference of two linked sets is small, so the
   differences of both from the pivot overlap in a number of shingles that follows from their sizes (``overlaps``), and
   the pair meets in the lists of the rarest of these, early enough to share as much. What all copies have in common is no longer in any list. Members
   far from the pivot meet in lists of their own shingles, the rarest within the group first. These lists go through the
   same step, without pairs that are in one component by now, until none is left; the limit grows with each time, up to
   MOST_COST pairs.
4. The union sketch of a pair estimates its similarity; a pair that shares less than that goes, the rest is verified on
   the full sets.
5. Links are closed to components by smallest labels with pointer jumping, each round written to the shared folder.

Cases: words are runs of bytes other than space and the controls 9 to 13, A-Z lower-cased; with fewer words than w the
whole sequence is the one shingle; null and empty texts have an empty set, link with nothing and are kept; repeated rows
(equal doc_ids too) are members of one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, ship

SKETCH = 40
#: Members of a list that compares all pairs at first, and pairs of such a list in later rounds at most.
SHORT_LIST, MOST_COST = 24, 1 << 20
#: The chance that a pair just at the threshold is lost in one of the two steps that look at sketches.
LOSS = 1e-7
#: From this similarity to the pivot on, members meet by their differences from it.
NEAR = 0.35
#: Odd constants of the 64-bit mixing (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words' hashes and shingles of sets that a worker keeps at most.
KEPT_WORDS, KEPT_SHINGLES = 100_000, 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes() -> _Hashes:
    return _hashes


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, w: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text in UTF-8."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(w, len(words))
    out = np.full(len(words) - width + 1, len(words) if len(words) < w else w, np.uint64)
    for i in range(width):
        out = scramble(out * np.uint64(MIX[0]) + h[i : len(words) - width + 1 + i])
    return np.unique(out)


def least_shared(per_cent: int, k: int) -> int:
    """The most values m for which a pair at the threshold agrees in fewer than m of k with a chance of LOSS at most."""
    t, below = per_cent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if below > LOSS:
            return m
    return k


def sketches(docs: DataFrame, w: int, k: int) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, set_digest (null for an empty set), sketch (up to k hashes) and packed (the compressed text) of every row."""
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for a, b in tokens.slices(tokens.text_sizes(batch), 4 << 20):
                raw = [(t.as_py() or "").encode() for t in batch["text"][a:b]]
                sets = [shingle_set(x, w) for x in raw]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"][a:b],
                        "row_hash": batch["row_hash"][a:b],
                        "n_shingles": pa.array(map(len, sets), pa.int64()),
                        "set_digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "sketch": pa.array([s[:k].tobytes() for s in sets], pa.binary()),
                        "packed": pa.array([squeeze(x) if len(s) else None for x, s in zip(raw, sets, strict=True)], pa.binary()),
                    }
                )

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    return given.mapInArrow(sketch, "doc_id long, row_hash long, n_shingles long, set_digest binary, sketch binary, packed binary")


def rarest(entries: DataFrame, members: DataFrame, per: list[str]) -> DataFrame:
    """Lists by key of ``entries`` (key, ``per``) with the columns of ``members`` (``per`` and more; among these need, how many keys it shares at least
    with any that it can be linked with): a member stands in those of its keys that others have too, but for the ``need`` - 1 most frequent.

    left is the number of the member's keys from this one on, in the order of frequency. The first key that two members share leaves both of
    them what they can share at most.
    """
    sizes = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "list_sizes")
    own = entries.join(sizes, "key").groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"), F.sum("size").alias("weight"))  # one set's keys
    first = (F.size("keys") - F.greatest("need", F.lit(1)) + 1).cast("int")
    met = own.join(members, per).filter(first > 0).select(*members.columns, "weight", F.size("keys").alias("shared"), F.posexplode(F.slice("keys", 1, first)).alias("place", "k"))
    return met.select(F.col("k.key").alias("key"), *members.columns, "weight", (F.col("shared") - F.col("place")).alias("left"))


def inverted(reps: DataFrame, share: float) -> DataFrame:
    """(key, rep, n, weight, left, half): the lists that representatives meet in which have at least ``share`` of their retained values in common.

    weight, the sum of list sizes over a sketch, is large for members in the middle of a group; the halves of two members add up to what
    they share at least if they are linked.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(s.as_buffer(), np.int64) for s in batch["sketch"]]
            counts = np.fromiter(map(len, values), np.int64, len(values))
            at = pa.array(np.repeat(np.arange(len(values)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*values, np.empty(0, np.int64)])), batch["rep"].take(at)], names=["key", "rep"])

    entries = materialize(reps.select("rep", "sketch").mapInArrow(explode, "key long, rep long"), "retained_values")
    members = reps.select("rep", "n", F.ceil(F.octet_length("sketch") / 8 * share - 1e-9).alias("need"))
    return rarest(entries, members, ["rep"]).select("key", "rep", "n", "weight", "left", (F.col("need") / 2).alias("half"))


def in_play(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``lists`` whose members are not of one component already, with label, cost (pairs of different components), middle (the pivot) and
    main (the component with most members)."""
    labelled = lists.withColumn("label", F.col("rep"))
    if labels is not None:
        labelled = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    classes_of = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("weight", "rep")).alias("middle"))
    counted = classes_of.groupBy("key").agg(
        ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("cost"), F.max("middle").alias("middle"), F.max(F.struct("m", "label"))["label"].alias("main")
    )
    return labelled.join(counted.filter("cost > 0"), "key")


def pairs_of(short: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different components that meet in a list, fit in size and can share enough from there on.

    Members of the component with most members are compared with the rest alone, and stay rows. Of the rest, there are the square root
    of twice the list's cost at most: all pairs of different components together are no fewer than half the square of their number.
    """
    rest = short.filter("label <> main").groupBy("key").agg(F.collect_list(F.struct("rep", "n", "label", "left", "half")).alias("rest"))
    each = short.select("key", F.struct("rep", "n", "label", "left", "half").alias("x"), (F.col("label") == F.col("main")).alias("in_main")).join(rest, "key")

    def fits(y: Column) -> Column:
        x = F.col("x")
        apart = (F.col("in_main") | (x["rep"] < y["rep"])) & (x["label"] != y["label"])
        return apart & (F.least(x["n"], y["n"]) >= F.lit(threshold - 1e-9) * F.greatest(x["n"], y["n"])) & (F.least(x["left"], y["left"]) >= x["half"] + y["half"] - F.lit(1e-6))

    met = each.select("x.rep", F.explode(F.transform(F.filter("rest", fits), lambda y: y["rep"])).alias("other"))
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def estimated(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Add the union sketch's estimate of the similarity."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch["sketch_a"], batch["sketch_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:] == both[:-1]
                least = np.flatnonzero(np.concatenate([[True], ~twice]))  # where distinct values begin
                n = min(k, len(least))
                end = least[n] if n < len(least) else len(both)
                found.append(int(twice[: max(0, end - 1)].sum()) / max(1, n))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.float64())], names=["a", "b", "estimate"])

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(estimate, "a long, b long, estimate double")


def bodies(ids: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, packed) of the representatives in ``ids``: the compressed text of one row of each."""
    wanted = ids.select("rep").distinct().join(reps.select("rep", "set_digest", "of"), "rep")
    met = rows.select("set_digest", "doc_id", "row_hash", "packed").join(wanted, "set_digest").filter(F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("row_hash") == F.col("of.row_hash")))
    return met.groupBy("rep").agg(F.first("packed").alias("packed"))


def with_bodies(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("packed").alias(f"packed_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


class Sets:
    """Sets of packed texts; some are kept, as pivots come again and again."""

    def __init__(self, w: int) -> None:
        self.w, self.kept, self.held, self.expand = w, {}, 0, zstandard.ZstdDecompressor().decompress

    def __call__(self, rep: int, packed: pa.Scalar) -> np.ndarray:
        found = self.kept.get(rep)
        if found is None:
            if self.held > KEPT_SHINGLES:
                self.kept.clear()
                self.held = 0
            self.kept[rep] = found = shingle_set(self.expand(packed.as_buffer()), self.w)
            self.held += len(found)
        return found


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verified(pairs: DataFrame, texts: DataFrame, w: int, per_cent: int) -> DataFrame:
    """``pairs`` (a, b, star) with the similarity of the full sets, and linked: 100 * intersection >= per_cent * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = Sets(w)
        for batch in batches:
            similarity, linked = [], []
            for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["packed_a"], batch["packed_b"], strict=True):
                one, other = set_of(a, x), set_of(b, y)
                both = in_common(one, other)
                union = len(one) + len(other) - both
                similarity.append(both / union)
                linked.append(100 * both >= per_cent * union)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["star"], pa.array(similarity, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "star", "similarity", "linked"])

    return with_bodies(pairs, texts).select("a", "b", "star", "packed_a", "packed_b").mapInArrow(verify, "a long, b long, star boolean, similarity double, linked boolean")


def overlaps(d: int, n: int, n_pivot: int, is_open: bool, t: float) -> int:
    """How many elements the difference of a set from the pivot shares at least with that of any linked set that it must be compared with.

    ``d`` is the size of the difference, ``n`` that of the set. Linked sets x and y differ in at most r * (n_x + n_y)
    shingles, r = (1 - t) / (1 + t), and t * n_x <= n_y <= n_x / t; their differences from the pivot share half of
    d_x + d_y less those. A set that isn't linked with the pivot has d > r * (n + n_pivot), and n_y <= n_pivot + d_y. Of
    two members of the pivot's component none is compared, so for one of these the other isn't linked with the pivot.
    """
    r, most = (1 - t) / (1 + t), n * (1 - t) / t
    other = max(0.0, d - most)
    if not is_open:
        other = max(other, r * (t * n + n_pivot))
    least = d + other - most
    if is_open:
        least = max(least, d - r * (n + n_pivot) + (1 - r) * other, 1e-3)
    return max(0, math.ceil(least / 2 - 1e-6))


def difference_lists(stars: DataFrame, texts: DataFrame, w: int, threshold: float) -> DataFrame:
    """(key, rep, n, weight, left, half): lists that members of a pivot's group meet in, for those pairs of which one is not in the pivot's component.

    ``stars`` has a (the pivot), b (a member), similarity and open. Members with a similarity from NEAR on meet by their
    differences from the pivot, those up to NEAR + 1 - threshold by their own shingles; of a linked pair both are in one of the two.
    """

    r = (1 - threshold) / (1 + threshold)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = Sets(w)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for a, b, x, y, s, o in zip(*(batch[c].to_pylist() for c in ("a", "b")), batch["packed_a"], batch["packed_b"], *(batch[c].to_pylist() for c in ("similarity", "open")), strict=True):
                pivot, own = set_of(a, x), set_of(b, y)
                zones = []
                if s >= NEAR:
                    apart = np.setxor1d(pivot, own, assume_unique=True)
                    zones.append((0, apart, overlaps(len(apart), len(own), len(pivot), o, threshold)))
                if s <= NEAR + 1 - threshold + 1e-6:
                    zones.append((1, own, math.ceil(threshold * len(own) - 1e-6)))
                for zone, elements, need in zones:
                    keys = scramble(elements + np.uint64((2 * a + zone) * MIX[0] & (1 << 64) - 1))
                    out.append((a, b, zone, len(own), need, (len(elements) - r * len(own)) / 2, keys.view(np.int64)))
                    held += len(keys)
                if held > 1 << 18:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        names = ("a", "rep", "zone", "n", "need", "half")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        ends = np.cumsum([0, *(len(r[-1]) for r in out)])
        keys = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([r[-1] for r in out]))).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*columns, keys], names=[*names, "keys"])

    given = with_bodies(stars, texts).select("a", "b", "packed_a", "packed_b", "similarity", "open")
    entries = materialize(given.mapInArrow(explode, "a long, rep long, zone int, n long, need long, half double, keys array<long>"), "differences")
    per = ["a", "rep", "zone"]
    return rarest(entries.select(*per, F.explode("keys").alias("key")), entries.drop("keys"), per).select("key", "rep", "n", "weight", "left", "half")


def linked_components(rows: DataFrame, reps: DataFrame, w: int, per_cent: int, k: int = SKETCH) -> DataFrame:
    """(node, label) of linked representatives. Links are verified on full sets; links within one component are not looked for."""
    threshold, share, turn = per_cent / 100, least_shared(per_cent, k) / k, 0
    lists = materialize(inverted(reps, share), "lists")
    texts = materialize(bodies(lists, rows, reps), "texts")
    known = materialize(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), "known")
    labels: DataFrame | None = None
    while True:
        sized = materialize(in_play(lists, labels), "lists_in_play")
        if sized.isEmpty():
            return labels if labels is not None else components(known)
        is_short = F.col("cost") <= min(SHORT_LIST**2 // 2 << 6 * turn, MOST_COST)
        pairs = pairs_of(sized.filter(is_short), threshold).join(known, ["a", "b"], "left_anti")
        guessed = materialize(estimated(materialize(pairs, "pairs"), reps, k), "estimates")
        likely = guessed.filter(F.col("estimate") >= share - 1e-9).select("a", "b", F.lit(False).alias("star"))
        stars = sized.filter(~is_short & (F.col("rep") != F.col("middle.rep"))).select(F.col("middle.rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("star")).distinct()
        found = materialize(verified(likely.unionByName(stars), texts, w, per_cent), "verified")
        known = known.unionByName(guessed.select("a", "b")).unionByName(found.filter("star").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        labels = components(found.filter("linked").select("a", "b"), labels)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        around = found.filter("star").join(of("a"), "a", "left").join(of("b"), "b", "left")
        around = around.withColumn("open", F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "similarity", "open")
        around = materialize(around, "around_pivots")
        unsettled = around.filter("open").select("a").distinct()
        lists = materialize(difference_lists(around.join(unsettled, "a", "left_semi"), texts, w, threshold), "lists")
        turn += 1


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge; ``before`` has the labels of earlier edges, which then stand for their nodes."""
    if before is not None:
        of = lambda c: before.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        met = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        joined = components(met.filter("a <> b"))
        later = joined.select(F.col("node").alias("label"), F.col("label").alias("joined"))
        moved = before.join(later, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
        return materialize(moved.unionByName(joined.join(before, "node", "left_anti")), "labels")
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = materialize(ways.unionByName(ways.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        heard = ways.join(labels, ways.b == labels.node)
        nearer = heard.groupBy("a").agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("before"))
        jump = labels.select(F.col("node").alias("root"), F.col("label").alias("far"))
        jumped = materialize(nearer.join(jump, nearer.label == jump.root).select(F.col("a").alias("node"), F.least("label", "far").alias("label"), "before"), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> before").isEmpty():
            return labels


def classified(docs: DataFrame, w: int, per_cent: int, k: int = SKETCH) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, set_digest, label (of the component; null for an empty set) and component of every row."""
    rows = materialize(sketches(docs, w, k), "sketches")
    shared = rows.filter(F.col("set_digest").isNotNull())
    reps = shared.groupBy("set_digest").agg(
        F.min(F.struct("doc_id", "row_hash")).alias("of"), F.min("doc_id").alias("min_doc"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")
    )
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")  # numbers that no two share
    labels = linked_components(rows, reps, w, per_cent, k)
    merged = reps.join(labels, reps.rep == labels.node, "left").select("set_digest", "min_doc", F.coalesce("label", "rep").alias("label"))
    merged = materialize(merged, "merged")
    least = materialize(merged.groupBy("label").agg(F.min("min_doc").alias("component")), "components")
    of_digest = materialize(merged.join(least, "label").select("set_digest", "label", "component"), "class_of_set")
    return rows.select("doc_id", "row_hash", "n_shingles", "set_digest").join(of_digest, "set_digest", "left")


def classes(docs: DataFrame, w: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    component = F.when(F.col("set_digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return classified(docs, w, per_cent).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, w: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id, and of repeated rows only one. Rows with an empty set stay."""
    found = classified(docs, w, per_cent)
    chosen = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "row_hash")).alias("of"))
    key = lambda d, h: (F.xxhash64(d, h), F.xxhash64(h, d, F.lit(1)))
    first, second = key(F.col("of.doc_id"), F.col("of.row_hash"))
    chosen = materialize(chosen.select(first.alias("k1"), second.alias("k2")), "chosen")
    own = [f"own{i}" for i in range(len(docs.columns))]
    one, two = key(F.col("doc_id").cast("long"), F.xxhash64("text"))
    keyed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], one.alias("k1"), two.alias("k2"), F.coalesce(~F.col("text").rlike("[^ \\t-\\r]"), F.lit(True)).alias("bare"))
    kept = keyed.filter(~F.col("bare")).join(chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.unionByName(keyed.filter("bare")).select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


#: The rows of op6 (three words, 85) in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT doc_id, least(doc_id, coalesce(min(y), doc_id)) AS component_id FROM w LEFT JOIN reach ON x = doc_id GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
