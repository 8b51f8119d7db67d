"""Members of large JSON texts, cut at any place, and first bytes of files, against plain reading."""

import json
import random

import pytest

from biblio_spark.sources import files, json_members, landed


def made(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 3:
        return rng.choice([None, True, 12.5, "", 'a "quoted" text', "[{", "}]", "\\", "\\\\\"", "é 日本", "x\ny", '"data": [', "]}," * 3])
    if kind == 3:
        return {}
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "data", "b]", '"']): made(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def members(spark, path, field, size):
    rows = json_members.read_members(spark, path, field, size).collect()
    return [json.loads(r["text"]) for r in sorted(rows, key=lambda r: (r["path"], r["at"]))]


@pytest.mark.parametrize("size", [3, 17, 8_000_000])
def test_members_of_any_range(spark, tmp_path, size):
    rng = random.Random(size)
    folder = tmp_path / "docs"
    folder.mkdir()
    want = []
    for n in range(3):
        rows = [{"k": n, "v": made(rng)} for _ in range(rng.randint(0, 5))]
        other = [{"other": made(rng)}]
        texts = [{"first": other, "x": {"data": [{"no": 1}]}, "data": rows, "last": other}, rows, {"data": rows}]
        (folder / f"{n}.json").write_text(json.dumps(texts[n], indent=rng.choice([None, 1]), ensure_ascii=n == 0), encoding="utf-8")
        want += rows
    assert members(spark, f"file://{folder}", "data", size) == want


def test_without_members(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [], "hits": [{"x": 1}]}')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text('{"other": [{"x": 1}]}')
    assert members(spark, f"file://{tmp_path}", "data", 5) == []


def test_one_large_file_has_many_tasks(spark, tmp_path):
    """A file of ranges in order, with running numbers for its records."""
    rows = [{"uid": f"U{k}", "title": f"Title [{k}] {{"} for k in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps({"hits": rows}))
    found = json_members.read_members(spark, f"file://{tmp_path}", "hits", 4096)
    assert found.count() == 3000
    read = landed.read_wos(spark, f"file://{tmp_path}").orderBy("ord").collect()
    assert [r["uid"] for r in read] == [r["uid"] for r in rows] and [r["ord"] for r in read] == list(range(3000))


def test_first_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    made = {"a.pdf": b"%PDF-" + b"x" * 2000, "b.pdf": b"<html>" + b"x" * 2000, "in/c.PDF": b"%PDF-1", "in/d.txt": b"y" * 3000, "in/e.bin": b""}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    heads = {r["path"].rsplit("/", 1)[1]: (r["size"], bytes(r["head"])) for r in json_members.read_heads(spark, f"file://{tmp_path}").collect()}
    assert heads == {n.rsplit("/", 1)[-1]: (len(c), c[:5]) for n, c in made.items()}
    found = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in files.check_pdf_files(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.pdf": True, "b.pdf": False, "c.PDF": False, "d.txt": True, "e.bin": False}
    assert {r["path"].rsplit("/", 1)[1] for r in files.check_pdf_files(spark, f"file://{tmp_path}", "*.pdf").collect()} == {"a.pdf", "b.pdf"}
    assert not json_members.readable("viewfs://store/in")
