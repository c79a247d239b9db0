"""The bundle relation: which contents belong together, and what follows for deleting and restoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ancestors, container, file_name, is_projector, is_weights, ollama_base, parent, split_part
from ..sources.scratch import materialize
from .ranks import numbered


@dataclass
class Bundles:
    """The bundle relation in factors: a content (``keys``: key) has itself and, for each group that it heads (``heads``: key, grp), the
    members of that group (``members``: grp, member). Both tables grow with the locations, the pairs that they stand for may grow with their square."""

    keys: DataFrame
    heads: DataFrame
    members: DataFrame

    def written(self) -> Bundles:
        return Bundles(materialize(self.keys, "keys"), materialize(self.heads, "heads"), materialize(self.members, "members"))

    def pairs(self, selected: DataFrame | None = None) -> DataFrame:
        """(key, member) of all contents, or of the selected ones (column key)."""
        keys, heads = self.keys, self.heads
        if selected is not None:
            keys, heads = (t.join(selected.select("key"), "key", "left_semi") for t in (keys, heads))
        return keys.select("key", F.col("key").alias("member")).unionByName(heads.join(self.members, "grp").select("key", "member")).distinct()


def bundles(mods: DataFrame, locs: DataFrame) -> Bundles:
    """Which contents belong together, one step and not closed: models of one store name; all under the container of a
    weights file, for that file; parts of one split set and projectors beside it, unless it is a projector itself.

    "Under the container" is an equality with one of the ancestors of the other path, so every branch is an equi-join. Groups
    that nothing heads, or that have no members, aren't kept.
    """
    group = lambda tag, *parts: F.concat_ws("\0", F.lit(tag), *parts)
    named = locs.filter("kind = 'ollama'").join(mods.select("key", ollama_base(F.col("display_name")).alias("base")), "key").select("key", group("name", "root_id", "base").alias("grp")).distinct()
    file = file_name(F.col("rel_path"))
    placed = locs.filter("kind <> 'ollama'").select(
        "key", "root_id", "rel_path", container(F.col("kind"), F.col("rel_path")).alias("box"), is_weights(file).alias("weights"), is_projector(file).alias("projector"), split_part(file).alias("split")
    )
    heavy = F.col("weights") & (F.col("box") != "")
    inside, beside, parts = group("under", "root_id", "box"), group("beside", "root_id", "box"), group("split", "root_id", "box", "split.prefix", F.col("split.count").cast("string"))
    heads_under = placed.filter(heavy).select("key", inside.alias("grp")).distinct()
    under = placed.select("key", "root_id", F.explode(ancestors(F.col("rel_path"))).alias("box")).select(F.col("key").alias("member"), inside.alias("grp")).distinct()
    projectors = placed.filter("projector").select(F.col("key").alias("member"), beside.alias("grp")).distinct()
    heads_beside = placed.filter(~heavy & ~F.col("projector")).select("key", beside.alias("grp")).distinct()
    in_split = placed.filter("split IS NOT NULL")
    heads_split = in_split.filter(~heavy).select("key", parts.alias("grp")).distinct()
    heads = named.unionByName(heads_under).unionByName(heads_beside.join(projectors, "grp", "left_semi").select("key", "grp")).unionByName(heads_split)
    members = (
        named.select("grp", F.col("key").alias("member"))
        .unionByName(under.join(heads_under, "grp", "left_semi").select("grp", "member"))
        .unionByName(projectors.select("grp", "member"))
        .unionByName(in_split.select(parts.alias("grp"), F.col("key").alias("member")).distinct())
    )
    return Bundles(mods.select("key"), heads, members)


def bundle(mods: DataFrame, locs: DataFrame) -> DataFrame:
    """(key, member): every pair of the bundle relation."""
    return bundles(mods, locs).pairs()


def dependence(b: Bundles) -> tuple[DataFrame, DataFrame]:
    """(has, needs): ``has`` (companion, grp, profile) and ``needs`` (grp, profile, required_by) meet in the companions and those who need them.

    A member of a bundle is a companion of its key unless it has that key in its own. What it has follows from the groups that it heads, its
    profile; most head none, and all of these have one list of those who need them for each group. Others don't need the heads
    that are members of a group in their profile, so their lists are made for each profile and group, not for each member.
    """
    profiles = b.heads.groupBy("key").agg(F.md5(F.array_join(F.sort_array(F.collect_set("grp")), "\1")).alias("profile"))
    has = b.members.join(profiles.withColumnRenamed("key", "member"), "member", "left").select(F.col("member").alias("companion"), "grp", F.coalesce("profile", F.lit("")).alias("profile"))
    has = materialize(has.join(b.heads, "grp", "left_semi"), "has")
    free = b.heads.join(has.filter("profile = ''").select("grp").distinct(), "grp", "left_semi").select("grp", F.lit("").alias("profile"), F.col("key").alias("required_by"))
    tied = has.filter("profile <> ''").select("grp", "profile").distinct().join(b.heads, "grp").select("grp", "profile", F.col("key").alias("required_by"))
    held_by = b.members.join(b.heads.select(F.col("key").alias("member")).distinct(), "member", "left_semi").withColumnRenamed("member", "required_by")
    groups_of = profiles.join(b.heads, "key").select("profile", "grp").distinct()
    mutual = groups_of.join(held_by, "grp").select("profile", "required_by").distinct()
    return has, free.unionByName(tied.join(mutual, ["profile", "required_by"], "left_anti").select("grp", "profile", "required_by"))


def companions(b: Bundles) -> DataFrame:
    """(companion, required_by): members of a bundle that don't have its key in their own."""
    has, needs = dependence(b)
    return has.join(needs, ["grp", "profile"]).select("companion", "required_by").distinct()


def required_by(b: Bundles) -> DataFrame:
    """(companion, ordinal, required_by): who needs each companion, in the order of their keys; a row each, as a common file may have millions."""
    return numbered(materialize(companions(b), "companions"), "companion", ["required_by"], "ordinal").select("companion", F.col("ordinal").cast("int").alias("ordinal"), "required_by")


def first_file(locs: DataFrame) -> DataFrame:
    """(key, file): the name of a content's first file."""
    return locs.groupBy("key").agg(file_name(F.min_by("rel_path", F.struct("root_id", "ord"))).alias("file"))


def split_primary(b: Bundles, locs: DataFrame) -> DataFrame:
    """(part, primary): parts other than the first, with the first bundle member that is a first part."""
    names = first_file(locs).select("key", split_part(F.col("file"))["index"].alias("part_index")).filter(F.col("part_index").isNotNull())
    ones = names.filter("part_index = 1").select(F.col("key").alias("member"))
    first = b.members.join(ones, "member", "left_semi").groupBy("grp").agg(F.min("member").alias("member"))
    return b.heads.join(names.filter("part_index <> 1").select("key"), "key", "left_semi").join(first, "grp").groupBy(F.col("key").alias("part")).agg(F.min("member").alias("primary"))


def bundle_union(b: Bundles, selected: DataFrame) -> DataFrame:
    """Distinct members of the bundles of the selected keys (column key)."""
    chosen = selected.select("key")
    groups = b.heads.join(chosen, "key", "left_semi").select("grp").distinct()
    return b.keys.join(chosen, "key", "left_semi").unionByName(b.members.join(groups, "grp", "left_semi").select(F.col("member").alias("key"))).distinct()


def deletable(b: Bundles, selected: DataFrame, mods: DataFrame) -> DataFrame:
    """(key, action, kept_for): what deleting the selection would delete, and what stays as something outside needs it."""
    union = materialize(bundle_union(b, selected), "bundle_union")
    outside = b.heads.join(union, "key", "left_anti").groupBy("grp").agg(F.min("key").alias("needer"))
    needed = b.members.join(union.withColumnRenamed("key", "member"), "member", "left_semi").join(outside, "grp").groupBy(F.col("member").alias("key")).agg(F.min("needer").alias("needer"))
    kept = needed.join(mods.select(F.col("key").alias("needer"), "display_name"), "needer", "left").select("key", F.col("display_name").alias("kept_for"), F.lit("keep").alias("held"))
    return union.join(kept, "key", "left").select("key", F.coalesce("held", F.lit("delete")).alias("action"), "kept_for")


def children(b: Bundles, locs: DataFrame) -> DataFrame:
    """(child, parent): a companion under its first parent, else a split part under its first part."""
    has, needs = dependence(b)
    least = needs.groupBy("grp", "profile").agg(F.min("required_by").alias("least"))
    first = has.join(least, ["grp", "profile"]).groupBy(F.col("companion").alias("child")).agg(F.min("least").alias("of"))
    parts = split_primary(b, locs).select(F.col("part").alias("child"), F.col("primary").alias("whole"))
    return first.join(parts, "child", "full").select("child", F.coalesce("of", "whole").alias("parent"))


def restore_set(trash: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root_id, asked, rel_path): what comes back with each wanted file (root_id, rel_path) of a trash.

    A projector comes alone; a file of a directory with weights anywhere under it brings that directory; any other
    brings its split set and the projectors beside it.
    """
    w = wanted.select("root_id", F.col("rel_path").alias("asked")).withColumns({"file": file_name(F.col("asked")), "dir": parent(F.col("asked"))}).withColumn("split", split_part(F.col("file")))
    all_files = trash.select("root_id", "rel_path").withColumns({"f": file_name(F.col("rel_path")), "d": parent(F.col("rel_path"))})
    under = all_files.select("root_id", "rel_path", "f", F.explode(ancestors(F.col("rel_path"))).alias("dir"))
    heavy = under.filter(is_weights(F.col("f"))).select("root_id", "dir").distinct().withColumn("heavy", F.lit(True))
    w = w.join(heavy, ["root_id", "dir"], "left").withColumn("whole", ~is_projector(F.col("file")) & (F.col("dir") != "") & (F.coalesce("heavy", F.lit(False)) | is_weights(F.col("file"))))
    trees = w.filter("whole").select("root_id", "asked", "dir").join(under, ["root_id", "dir"]).select("root_id", "asked", "rel_path")
    single = w.filter("NOT whole")
    own = single.select("root_id", "asked", F.col("asked").alias("rel_path"))
    beside = single.filter(~is_projector(F.col("file"))).join(all_files.withColumnRenamed("d", "dir"), ["root_id", "dir"])
    same = split_part(F.col("f"))
    follows = (same["prefix"] == F.col("split.prefix")) & (same["count"] == F.col("split.count"))
    mates = beside.filter(F.coalesce(follows, F.lit(False)) | is_projector(F.col("f"))).select("root_id", "asked", "rel_path")
    return trees.unionByName(own).unionByName(mates).distinct()


def listing_groups(remote: DataFrame) -> DataFrame:
    """(display, first, parts, total, ord) of a hub listing (ord, filename, size): parts of a split set are one row."""
    s = split_part(F.col("filename"))
    group = F.coalesce(F.concat(s["prefix"], F.lit("-of-"), s["count"].cast("string")), F.concat(F.lit("\0"), F.col("ord").cast("string")))
    rows = remote.withColumns({"split": s, "group": group})
    out = rows.groupBy("group").agg(
        F.min("ord").alias("ord"),
        F.min_by("filename", "ord").alias("first"),
        F.count(F.lit(1)).alias("parts"),
        F.when(F.count("size") == F.count(F.lit(1)), F.sum("size")).alias("total"),
        F.first("split").alias("split"),
    )
    shown = F.when(F.col("split").isNotNull(), F.concat("split.prefix", F.lit(".gguf ("), F.col("split.count").cast("string"), F.lit(" parts)"))).otherwise(F.col("first"))
    return out.select(shown.alias("display"), "first", "parts", "total", "ord")


def split_set(remote: DataFrame, chosen: DataFrame) -> DataFrame:
    """(chosen, filename, listed): the files that each chosen one needs; a file that isn't listed makes its set incomplete."""
    s = split_part(F.col("chosen"))
    c = chosen.select(F.col("filename").alias("chosen")).withColumn("split", s)
    name = F.concat("split.prefix", F.lit("-"), F.lpad(F.col("i").cast("string"), 5, "0"), F.lit("-of-"), F.lpad(F.col("split.count").cast("string"), 5, "0"), F.lit(".gguf"))
    parts = c.filter("split IS NOT NULL").select("chosen", "split", F.explode(F.sequence(F.lit(1), "split.count")).alias("i")).select("chosen", name.alias("filename"))
    wanted = c.filter("split IS NULL").select("chosen", F.col("chosen").alias("filename")).unionByName(parts)
    listed = remote.select("filename").distinct().withColumn("listed", F.lit(True))
    return wanted.join(listed, "filename", "left").select("chosen", "filename", F.coalesce("listed", F.lit(False)).alias("listed"))


def projector_pick(remote: DataFrame, chosen: DataFrame) -> DataFrame:
    """The one projector that rides along with a download: plain f16 first, then bf16, then by listing; none for projectors alone."""
    low, base = F.lower("filename"), file_name(F.col("filename"))
    rank = F.when(low.contains("f16") & ~low.contains("bf16"), 0).when(low.contains("bf16"), 1).otherwise(2)
    some = chosen.filter(~is_projector(file_name(F.col("filename")))).select(F.lit(1).alias("one")).limit(1)
    free = remote.filter(is_projector(base)).join(chosen, "filename", "left_anti").withColumns({"rank": rank, "one": F.lit(1)})
    return free.join(some, "one", "left_semi").orderBy("rank", "ord").limit(1).select("filename")
