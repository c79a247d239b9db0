"""Predicates and parts of file names and paths, as column expressions. Paths are compared by component, never by text prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """All components but the last; empty for a bare name."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def is_weights(name: Column) -> Column:
    return name.rlike(r"(?i)\.(safetensors|bin|pt|pth|onnx)\z")


def is_gguf(name: Column) -> Column:
    return name.rlike(r"(?is)^.+\.gguf\z")


def is_dot_entry(name: Column) -> Column:
    return name.startswith(".")


def is_projector(name: Column) -> Column:
    return F.lower(name).contains("mmproj")


SPLIT = r"(?s)^(.*)-(\d{5}|\+\d{4})-of-(\d{5}|\+\d{4})\.gguf\z"


def split_part(name: Column) -> Column:
    """struct(prefix, index, count) of a split part; null for any other name."""
    number = lambda g: F.regexp_replace(F.regexp_extract(name, SPLIT, g), r"^\+", "").cast("int")
    return F.when(name.rlike(SPLIT), F.struct(F.regexp_extract(name, SPLIT, 1).alias("prefix"), number(2).alias("index"), number(3).alias("count")))


def repo_of_dirname(name: Column) -> Column:
    return F.when(name.startswith("models--"), F.replace(F.substr(name, F.lit(9)), F.lit("--"), F.lit("/")))


def stem(path: Column) -> Column:
    """The file name without its last extension; a name that only starts with a dot stays whole."""
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]*\z", "$1")


def ollama_base(display_name: Column) -> Column:
    return F.regexp_replace(display_name, r"\+projector\z", "")


def container(kind: Column, path: Column) -> Column:
    """What a file belongs to: the snapshot (three components) in a hub store, else its directory."""
    return F.when(kind == "hf_hub", F.array_join(F.slice(F.split(path, "/"), 1, 3), "/")).otherwise(parent(path))


def ancestors(path: Column) -> Column:
    """Every directory above a path, outermost first, so that "is under" becomes an equality."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(above, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def sanitized(path: Column) -> Column:
    """A relative path without empty and "." components; null for one that is absolute, empty or has ".."."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    bad = path.startswith("/") | F.exists(parts, lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def has_dot_component(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def scan_display_name(kind: Column, name: Column, path: Column) -> Column:
    return F.when(kind == "ollama", name).when(kind == "hf_hub", F.concat(name, F.lit(" — "), stem(path))).otherwise(stem(path))
