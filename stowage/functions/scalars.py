"""Formatting, identifiers and small arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import file_name, parent, repo_of_dirname, sanitized
from .names import ollama_base as base_of

#: Names of weight types by number (fixed values of the header format).
FILE_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L",
    14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K", 19: "IQ2_XXS", 20: "IQ2_XS", 24: "IQ4_NL", 25: "IQ4_XS", 30: "BF16",
}


def human_size(size: Column) -> Column:
    """Exact bytes below 1 KiB; else one decimal of the largest unit up to TiB, ties to even, by whole-number arithmetic."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        whole = F.lit(1024**i)
        wide = size.cast("decimal(30,0)") * 10
        tenths, rest = F.floor(wide / whole), 2 * (wide % whole)
        up = (rest > whole) | ((rest == whole) & (tenths % 2 == 1))
        rounded = (tenths + up.cast("int")).cast("long")
        shown = F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= whole, shown).otherwise(out)
    return out


def ago(then: Column, now: Column) -> Column:
    s = F.greatest(now - then, F.lit(0)).cast("long")
    whole = lambda n: F.floor(s / n).cast("string")
    return (
        F.when(s <= 90, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s <= 5400, F.concat(whole(60), F.lit(" min ago")))
        .when(s <= 172800, F.concat(whole(3600), F.lit(" hours ago")))
        .otherwise(F.concat(whole(86400), F.lit(" days ago")))
    )


def short_hash(s: Column) -> Column:
    return F.substring(s, 1, 12)


def hex_of(b: Column) -> Column:
    return F.lower(F.hex(b))


def utc_datetime(unix: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd HH:mm:ss")


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def url_path(s: Column) -> Column:
    """Percent-encoded bytes; letters, digits and -._~/ stay."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_query(s: Column) -> Column:
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def valid_repo(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\z")


def etag_sha256(s: Column) -> Column:
    plain = F.regexp_replace(F.trim(s), r'^"+|"+\z', "")
    return F.when(~F.trim(s).startswith("W/") & plain.rlike(r"^[0-9A-Fa-f]{64}\z"), F.lower(plain))


def check_download(got: Column, want: Column) -> Column:
    return F.coalesce(got == want, F.lit(True))


def dest_for(shelf: Column, repo: Column, filename: Column) -> Column:
    """<shelf>/<last part of repo>/<file>; null for a file that would leave it."""
    return F.when(sanitized(filename).isNotNull(), F.concat_ws("/", shelf, file_name(repo), filename))


def dest_layout(kind: Column, display_name: Column, path: Column) -> Column:
    safe = F.translate(display_name, ":/", "--")
    parts = F.split(path, "/")
    sub = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 4, F.size(parts)), "/")).otherwise(F.lit("model.gguf"))
    return F.when(kind == "ollama", F.concat(safe, F.lit("/"), safe, F.lit(".gguf"))).when(kind == "hf_hub", F.concat_ws("/", file_name(display_name), sub)).otherwise(path)


def owner_removal_command(kind: Column, display_name: Column, path: Column) -> Column:
    repo = repo_of_dirname(F.element_at(F.split(path, "/"), 1))
    return F.when(kind == "ollama", F.concat(F.lit("ollama rm "), base_of(display_name))).when((kind == "hf_hub") & repo.isNotNull(), F.concat(F.lit("hf cache rm model/"), repo, F.lit(" -y")))


def kind_label(kind: Column) -> Column:
    return F.when(kind == "hf_hub", "hf-hub").when(kind == "removable", "drive").otherwise(kind)


def root_id(kind: Column, path: Column) -> Column:
    return F.concat(kind_label(kind), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def temp_sibling(path: Column, suffix: str) -> Column:
    return F.concat(path, F.lit(f".{suffix}"))


def file_type_name(n: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, n.cast("int")), F.concat(F.lit("type "), n.cast("string")))


def head_dim(key_length: Column, embedding: Column, heads: Column) -> Column:
    return F.coalesce(key_length, F.when((heads > 0) & (embedding % heads == 0), F.call_function("div", embedding, heads)))


def percent(done: Column, total: Column) -> Column:
    return F.call_function("div", done * 100, F.greatest(total, F.lit(1)))


def trash_name(path: Column, n: Column) -> Column:
    """The n-th file of one name to arrive: the number goes before the extension; the first keeps its name."""
    name, folder = file_name(path), parent(path)
    numbered = F.when(name.contains("."), F.concat(F.regexp_extract(name, r"(?s)^(.*)\.[^.]*\z", 1), F.lit("."), n.cast("string"), F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1))).otherwise(F.concat(name, F.lit("."), n.cast("string")))
    new = F.when(n == 0, name).otherwise(numbered)
    return F.when(folder == "", new).otherwise(F.concat(folder, F.lit("/"), new))


def family(architecture: Column, size_label: Column, display_name: Column) -> Column:
    first = F.element_at(F.split(display_name, "[ :/]"), 1)
    return F.when(architecture.isNotNull() & size_label.isNotNull(), F.concat(architecture, F.lit(" "), size_label)).when(architecture.isNotNull(), architecture).otherwise(first)


