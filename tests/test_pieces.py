"""Large JSON documents in pieces against whole ones."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from stowage.sources import documents, pieces

from .conftest import rows


def odd(r: random.Random, n: int) -> str:
    return "".join(r.choices(['"', "\\", "{", "}", "[", "]", ":", ",", "a", "é", "\n", "files", '"files": [{', "\U0001f600"], k=r.randrange(n)))


def test_structure_in_blocks_is_that_of_the_whole():
    r = random.Random(2)
    for _ in range(60):
        text = json.dumps({odd(r, 5): [odd(r, 9), {odd(r, 4): [1, {}]}] for _ in range(6)}, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode()
        data = np.frombuffer(text, np.uint8)
        places, steps, *end = pieces.structure(data, False, False)
        assert end == [False, False] and steps.sum() == 0
        size, state, got = r.randrange(1, 12), (False, False), []
        for a in range(0, len(data), size):
            p, _, *state = pieces.structure(data[a : a + size], *state)
            got += (p + a).tolist()
        assert got == places.tolist()


def manifest(r: random.Random, root: str, n: int) -> dict:
    files = [{"rel_path": f"{odd(r, 12)}{i}", "size": i, "accessible": bool(i % 2), "sha256": None if i % 3 else odd(r, 6), "meta": {"architecture": odd(r, 5), "name": None} if i % 4 == 0 else None, "extra": {"files": [{"rel_path": "not one"}]}} for i in range(n)]
    out = {"schema_version": 1, "other": [{"rel_path": "no"}, {"files": [{"rel_path": "neither"}]}], "root": {"id": root, "kind": "shelf", "path": f"/{odd(r, 9)}", "label": None}, "generated_unix": 7, "files": files, "after": [{"rel_path": "no"}]}
    if r.random() < 0.5:
        out = dict(reversed(out.items()))
    return out


@pytest.mark.parametrize("block", [37, 400, 1 << 20])
def test_manifests_in_pieces(spark, tmp_path, block):
    r = random.Random(block)
    for i, n in enumerate((0, 1, 60)):
        (tmp_path / f"{i}.json").write_text(json.dumps(manifest(r, f"r{i}", n), ensure_ascii=i == 1, indent=2 if i == 2 else None), encoding="utf-8")
    (tmp_path / "broken.json").write_text('{"root": {"id": "x"}, "files": [{"rel_path": "a"}', encoding="utf-8")
    want = documents.manifests(spark, str(tmp_path))
    got = pieces.manifests(spark, [str(p) for p in sorted(tmp_path.glob("*.json"))], block)
    assert want.count() == 61 and rows(got.select(*want.columns)) == rows(want)


def test_an_inventory_in_pieces(spark, tmp_path):
    r = random.Random(5)
    model = lambda i: {"size": i, "display_name": odd(r, 8), "meta": None, "locations": [{"root_id": f"r{k}", "kind": "shelf", "rel_path": odd(r, 8), "accessible": True, "dev": 1, "ino": 2**63 + k} for k in range(i % 3)]}
    data = {"schema_version": 1, "generated_unix": 2, "roots": [{"id": "r0", "kind": "shelf", "path": "/", "label": None}], "models": {f"unknown:r:{odd(r, 6)}{i}": model(i) for i in range(40)}}
    (tmp_path / "i.json").write_text(json.dumps(data), encoding="utf-8")
    want, got = documents.inventory(spark, str(tmp_path / "i.json")), pieces.inventory(spark, str(tmp_path / "i.json"), 301)
    for w, g in zip(want, got, strict=True):
        assert rows(g.select(*w.columns)) == rows(w)
    assert want[0].count() == 40


def test_many_tasks_read_one_document(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(manifest(random.Random(1), "r", 400)), encoding="utf-8")
    size = (tmp_path / "m.json").stat().st_size
    found = pieces.elements(spark, [str(tmp_path / "m.json")], "files", (), size // 7)[0]
    assert found.count() == 400 and [r["ord"] for r in found.orderBy("ord").collect()] == list(range(400))
