"""A Spark data source that lists the files of a store: ``spark.read.format("stowage_scan")``.

Options: path, kind (shelf, removable, ollama, hf_hub, trash or links) and depth. A shelf is divided by the folders of
its first two levels, a hub by its repositories, an ollama store by the models of its manifests, so that tasks walk apart
from each other. Sizes and fingerprints are those of what a link points to; a file that can't be reached is listed with
size 0 and accessible false. A trash is walked with its dot entries, but not
through links to folders, and a link in it is listed with its own size and times.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEPTH = 16
WEIGHTS = (".safetensors", ".bin", ".pt", ".pth", ".onnx")
FINGERPRINT = "struct<size: long, mtime_s: long, mtime_nsec: long, dev: decimal(20,0), ino: decimal(20,0)>"
SCHEMA = f"rel_path string, size long, fingerprint {FINGERPRINT}, name string, accessible boolean, extra string"


def stat_row(root: str, rel: str, name: str | None = None, extra: str | None = None, follow: bool = True) -> tuple:
    try:
        s = os.stat(os.path.join(root, rel), follow_symlinks=follow)
        fp = (s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, Decimal(s.st_dev), Decimal(s.st_ino))
        return rel, s.st_size, fp, name, True, extra
    except OSError:
        return rel, 0, None, name, False, extra


def listed(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as it:
            return sorted(it, key=lambda e: e.name)
    except OSError:
        return []


def is_weights(name: str) -> bool:
    return name.lower().endswith(WEIGHTS)


def is_gguf(name: str) -> bool:
    return name.lower().endswith(".gguf") and len(name) > 5


def join(rel: str, name: str) -> str:
    return os.path.join(rel, name) if rel else name


def subtree(root: str, rel: str, depth: int, dots: bool = False) -> Iterator[str]:
    """Every file below, without dot entries unless ``dots``; links to nowhere count as files."""
    for e in listed(os.path.join(root, rel)):
        if e.name.startswith(".") and not dots:
            continue
        if e.is_dir():
            if depth:
                yield from subtree(root, join(rel, e.name), depth - 1, dots)
        else:
            yield join(rel, e.name)


def trashed(root: str, rel: str, depth: int) -> Iterator[str]:
    """Every file of a trash. A link to a folder is neither walked nor a file."""
    for e in listed(os.path.join(root, rel)):
        if e.is_dir(follow_symlinks=False):
            if depth:
                yield from trashed(root, join(rel, e.name), depth - 1)
        elif not e.is_dir():
            yield join(rel, e.name)


def holds_weights(entries: list[os.DirEntry]) -> bool:
    return any(is_weights(e.name) and e.is_file() for e in entries)


def walk_shelf(root: str, rel: str, depth: int) -> Iterator[str]:
    """GGUF files anywhere; a folder that holds a weights file, be it the shelf itself, comes whole, DEPTH levels deep."""
    entries = listed(os.path.join(root, rel))
    if holds_weights(entries):
        yield from subtree(root, rel, DEPTH)
        return
    for e in entries:
        if e.name.startswith("."):
            continue
        if e.is_dir():
            if depth:
                yield from walk_shelf(root, join(rel, e.name), depth - 1)
        elif is_gguf(e.name):
            yield join(rel, e.name)


def walk_repo(root: str, repo: str, depth: int) -> Iterator[tuple]:
    """Files of every snapshot of a hub repository: GGUF always, all others where the snapshot has weights."""
    name = repo[len("models--") :].replace("--", "/")
    for rev in listed(os.path.join(root, repo, "snapshots")):
        if not rev.is_dir():
            continue
        files = list(subtree(root, f"{repo}/snapshots/{rev.name}", depth))
        heavy = any(is_weights(f) for f in files)
        for f in files:
            if heavy or is_gguf(os.path.basename(f)):
                yield stat_row(root, f, name)


def repo_parts(root: str, repo: str, depth: int) -> Iterator[tuple]:
    """What the health checks of a hub read: refs, snapshots, blobs and links, told apart by ``extra``."""
    for ref in listed(os.path.join(root, repo, "refs")):
        if ref.is_file():
            with open(ref.path, encoding="utf-8", errors="replace") as f:
                yield (*stat_row(root, f"{repo}/refs/{ref.name}")[:3], f.read().strip(), True, "ref")
    for blob in listed(os.path.join(root, repo, "blobs")):
        yield stat_row(root, f"{repo}/blobs/{blob.name}", blob.name, "blob")
    for rev in listed(os.path.join(root, repo, "snapshots")):
        if rev.is_dir():
            yield (f"{repo}/snapshots/{rev.name}", 0, None, rev.name, True, "snapshot")
            for f in subtree(root, f"{repo}/snapshots/{rev.name}", depth, dots=True):
                full = os.path.join(root, f)
                # What an entry leads to keeps that content in use, whether it is a link or the file itself.
                yield stat_row(root, f, os.path.basename(os.path.realpath(full)) if os.path.exists(full) else None, "link")


def store_manifests(root: str, below: str = "") -> Iterator[tuple[str, dict]]:
    """(name, manifest) of every manifest of an ollama store (or of a folder of them); broken ones are left out."""
    top = os.path.join(root, "manifests")
    for f in subtree(top, below, DEPTH):
        parts = f.split("/")
        if len(parts) != 4:
            continue
        try:
            with open(os.path.join(top, f), encoding="utf-8") as h:
                data = json.load(h)
        except (OSError, ValueError):
            continue
        space, model, tag = parts[1:]
        if isinstance(data, dict) and isinstance(data.get("layers"), list):
            yield f"{model}:{tag}" if space == "library" else f"{space}/{model}:{tag}", data


def store_rows(root: str, below: str = "") -> Iterator[tuple]:
    for name, manifest in store_manifests(root, below):
        for ending, suffix in (("image.model", ""), ("image.projector", "+projector")):
            digests = [x["digest"] for x in manifest["layers"] if isinstance(x, dict) and str(x.get("mediaType", "")).endswith(ending) and isinstance(x.get("digest"), str)]
            if digests:
                yield stat_row(root, "blobs/" + digests[0].replace(":", "-"), name + suffix)


class Part(InputPartition):
    """A folder to walk, or with ``flat`` only the files in it."""

    def __init__(self, folder: str, flat: bool = False) -> None:
        self.folder, self.flat = folder, flat


def folders(path: str, dots: bool = False, links: bool = True) -> list[str]:
    return [e.name for e in listed(path) if e.is_dir(follow_symlinks=links) and (dots or not e.name.startswith("."))]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kind, self.depth = options["path"], options.get("kind", "shelf"), int(options.get("depth", DEPTH))

    def partitions(self) -> list[Part]:
        if self.kind in ("hf_hub", "links"):
            return [Part(d) for d in folders(self.root) if d.startswith("models--")]
        if self.kind == "ollama":
            top = os.path.join(self.root, "manifests")
            spaces = [join(host, space) for host in folders(top) for space in folders(os.path.join(top, host))]
            return [Part(join(s, model)) for s in spaces for model in folders(os.path.join(top, s))]
        return self.split("", min(2, self.depth))

    def split(self, rel: str, levels: int) -> list[Part]:
        """Parts that together walk a folder: its own files, and each folder in it. One that comes whole isn't divided."""
        path = os.path.join(self.root, rel)
        is_trash = self.kind == "trash"
        if not levels or not is_trash and holds_weights(listed(path)):
            return [Part(rel)]
        return [Part(rel, flat=True), *(p for d in folders(path, is_trash, not is_trash) for p in self.split(join(rel, d), levels - 1))]

    def read(self, partition: Part) -> Iterator[tuple]:
        root, rel = self.root, partition.folder
        if self.kind == "ollama":
            yield from store_rows(root, rel)
        elif self.kind == "hf_hub":
            yield from walk_repo(root, rel, self.depth)
        elif self.kind == "links":
            yield from repo_parts(root, rel, self.depth)
        else:
            left = 0 if partition.flat else self.depth - (rel.count("/") + 1 if rel else 0)
            is_trash = self.kind == "trash"
            for f in (trashed if is_trash else walk_shelf)(root, rel, left):
                yield stat_row(root, f, follow=not is_trash)


class StoreScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))


def scan(spark, path: str, kind: str = "shelf", depth: int = DEPTH):
    """The rows of one store. Its folder must be reachable from the executors under the same path."""
    spark.dataSource.register(StoreScan)
    return spark.read.format("stowage_scan").options(path=path, kind=kind, depth=str(depth)).load()
