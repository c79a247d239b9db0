"""State of one machine, on the driver: configuration, roots and their identity, the writer's lock, saved documents."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import subprocess
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

#: What this engine keeps on a root: its identity, a catalog of it, and its trash.
FOLDER, MARKER, CARRIED, TRASH = ".stowage", ".stowage/root-id", ".stowage/manifest.json", ".stowage/trash"
LABELS = {"hf_hub": "hf-hub", "removable": "drive"}


class Locked(RuntimeError):
    """Another process writes the state."""


@dataclass
class Config:
    """Shelf folders, registered roots (id, path, label, volume), and whether stores are looked for."""

    shelves: list[str] = field(default_factory=lambda: [os.path.expanduser("~/models")])
    roots: list[dict] = field(default_factory=list)
    discover: bool = True


def read_config(path: str) -> Config:
    """A missing file means the defaults; one that can't be read is an error."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return Config(**{k: v for k, v in data.items() if k in Config.__dataclass_fields__})
    except FileNotFoundError:
        return Config()
    except (OSError, ValueError, AttributeError, TypeError) as e:
        raise ValueError(f"{path} can't be read: {e}") from e


def config_or_defaults(path: str) -> Config:
    """For reading only: a broken file counts as none."""
    try:
        return read_config(path)
    except ValueError:
        return Config()


def save_config(config: Config, path: str) -> None:
    """Never over a file that can't be read: it may know roots that this process doesn't."""
    read_config(path)
    save_text(path, json.dumps(asdict(config), indent=1))


def save_text(path: str, text: str, keep: bool = False) -> None:
    """Whole or not at all, for the owner's eyes only; with ``keep`` the document before stays beside it as .bak."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, mode=0o700, exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if keep and os.path.exists(path):
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{path}.bak")
        os.link(path, f"{path}.bak")
    os.replace(part, path)


@contextlib.contextmanager
def writer(folder: str) -> Iterator[None]:
    """One writer at a time: the lock goes with the process that holds it."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    with open(os.path.join(folder, "writer.lock"), "a+", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            f.seek(0)
            holder = f.read().strip()
            raise Locked("the state is being written" + (f" by process {holder}" if holder.isdigit() else "")) from None
        f.seek(0)
        f.truncate()
        f.write(str(os.getpid()))
        f.flush()
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def path_id(kind: str, path: str) -> str:
    """The identity of a root that has none of its own: its kind and a hash of its path."""
    return f"{LABELS.get(kind, kind)}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"


def ollama_stores(env: Mapping[str, str]) -> list[str]:
    places = [env.get("OLLAMA_MODELS"), os.path.join(env["HOME"], ".ollama/models") if env.get("HOME") else None, "/usr/share/ollama/.ollama/models"]
    return [p for p in dict.fromkeys(places) if p and os.path.isdir(os.path.join(p, "manifests"))]


def hub_cache(env: Mapping[str, str]) -> str | None:
    home = env.get("HF_HOME") or os.path.join(env.get("HOME", "."), ".cache/huggingface")
    return found if os.path.isdir(found := os.path.join(home, "hub")) else None


def discover_roots(config: Config, env: Mapping[str, str] | None = None) -> list[dict]:
    """All roots this machine knows: shelves, stores that are there, and registered drives, also those that are not plugged in."""
    env = os.environ if env is None else env
    found = [("shelf", p) for p in config.shelves]
    if config.discover:
        found += [("ollama", p) for p in ollama_stores(env)] + [("hf_hub", p) for p in [hub_cache(env)] if p]
    known = [{"root_id": path_id(kind, p), "kind": kind, "path": p, "label": None} for kind, p in found]
    return known + [{"root_id": r["id"], "kind": "removable", "path": r["path"], "label": r.get("label")} for r in config.roots]


def volume_of(path: str, by_uuid: str = "/dev/disk/by-uuid") -> str | None:
    """The UUID of the file system that holds ``path``, where the kernel shows one."""
    try:
        device = os.stat(path).st_dev
        for e in sorted(os.listdir(by_uuid)):
            with contextlib.suppress(OSError):
                if os.stat(os.path.join(by_uuid, e)).st_rdev == device:
                    return e
    except OSError:
        pass
    return None


def marker(path: str) -> str | None:
    try:
        with open(os.path.join(path, MARKER), encoding="utf-8") as f:
            return f.read().strip() or None
    except OSError:
        return None


def register_root(config: Config, path: str, label: str | None = None) -> dict:
    """Add a drive or share to ``config``. Its identity is what it carries, else that of its file system, else a new one; it carries it from then on."""
    path = os.path.realpath(path)
    if not os.path.isdir(path):
        raise ValueError(f"{path} is no folder")
    volume, known = volume_of(path), marker(path)
    own = known or (f"ext-{volume.replace('-', '').lower()[:8]}" if volume else f"ext-{uuid.uuid4().hex[:8]}")
    if any(r["id"] == own or r["path"] == path for r in config.roots):
        raise ValueError(f"{path} is registered already (as {own})")
    if known is None:
        save_text(os.path.join(path, MARKER), own + "\n")
    root = {"id": own, "path": path, "label": label, "volume": volume}
    config.roots.append(root)
    return root


def owner_tools(names: Sequence[str] = ("ollama", "hf", "huggingface-cli"), path: str | None = None) -> dict[str, bool]:
    """Which programs of stores' owners can be called here; commands for the others are of no use."""
    return {n: shutil.which(n, path=path) is not None for n in names}


def timer_state(timer: str, unit_folder: str, ask: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> str:
    """The state of a scheduler's timer as ``health.scrub_finding`` takes it: active, not enabled, not installed, or no scheduler."""
    try:
        told = ask(["systemctl", "--user", "is-enabled", timer], capture_output=True, text=True, check=False)
    except OSError:
        return "no scheduler"
    if (told.stdout or "").strip().startswith("enabled"):
        return "active"
    return "not enabled" if os.path.isfile(os.path.join(unit_folder, timer)) else "not installed"
