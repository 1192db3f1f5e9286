import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import uploads

SPEC = "# Spec\n- **R1** one\n- **R2** two\n"
PASTED = "upload string, name string, spec string, files array<struct<path:string,source:string>>"


def pasted(spark, rows):
    return uploads.checked(uploads.pasted(spark.createDataFrame(rows, PASTED)))


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


GOOD = [("src/a.py", "x = 1\ny = 2"), ("b/c.py", "def f():\n    pass\n"), ("bad.py", "def (")]


def test_pasted_and_zipped_uploads_come_back(spark, tmp_path):
    root = str(tmp_path / "u")
    named = pasted(spark, [("p", "My Project!", SPEC, GOOD), ("q", None, SPEC, [("a.py", "")])])
    files = {"proj/spec.md": SPEC, "proj/src/a.py": "z = 3\n", "proj/other.py": "q", "proj/tests/t.py": "t"}
    zips = uploads.checked(uploads.zipped(spark.createDataFrame([("z", "zip", archive(files))], "upload string, name string, content binary")))
    done = uploads.materialised(spark, named.unionByName(zips), root)
    ids = {r["upload"]: r["id"] for r in done.collect()}
    assert all(r["error"] is None for r in done.collect()) and len(set(ids.values())) == 3
    manifest, rows = uploads.reread(spark, root, ids["p"])
    m = manifest.first()
    assert (m["name"], m["rules"], m["files"], m["spec"]) == ("my-project", 2, 3, SPEC) and len(m["warnings"]) == 1 and "bad.py" in m["warnings"][0]
    got = {r["path"]: (r["source"], r["lines"]) for r in rows.collect()}
    assert got == {"src/a.py": ("x = 1\ny = 2", 2), "src/b/c.py": ("def f():\n    pass\n", 3), "src/bad.py": ("def (", 1)}
    manifest, rows = uploads.reread(spark, root, ids["z"])
    assert manifest.first()["spec_path"] == "spec.md" and [r["path"] for r in rows.collect()] == ["src/a.py"]
    assert uploads.reread(spark, root, ids["q"])[0].first()["name"] == "project"


REFUSED = [
    ("the specification is empty", " ", GOOD), ("no numbered rules", "# nothing", GOOD), ("too many rules", "".join(f"- **R{k}** x\n" for k in range(81)), GOOD),
    ("no Python files", SPEC, []), ("no Python files", SPEC, None), ("too many files", SPEC, [(f"f{k}.py", "x") for k in range(31)]), ("a file is too large", SPEC, [("a.py", "x" * 150_001)]),
    ("the files are too large", SPEC, [(f"f{k}.py", "x" * 149_000) for k in range(11)]), (uploads.NOTHING_PARSES, SPEC, [("a.py", "def ("), ("b.py", "x = (")]), ("unsafe path ../a.py", SPEC, [("../a.py", "x")]),
]


def test_each_refusal(spark, tmp_path):
    rows = [(str(n), "n", spec, files) for n, (_, spec, files) in enumerate(REFUSED)]
    done = uploads.materialised(spark, pasted(spark, rows), str(tmp_path / "u"))
    assert {r["upload"]: (r["id"], r["error"]) for r in done.collect()} == {str(n): (None, e) for n, (e, _, _) in enumerate(REFUSED)}
    assert uploads.stored_ids(spark, str(tmp_path / "u")).count() == 0
    zips = [("empty", bytearray(b"")), ("none", archive({"a.py": "x"})), ("junk", bytearray(b"no")), ("twins", archive({"p/spec.md": SPEC, "q/spec.md": SPEC, "a.py": "x"}))]
    got = uploads.checked(uploads.zipped(spark.createDataFrame([(u, "n", c) for u, c in zips], "upload string, name string, content binary"))).collect()
    assert {r["upload"]: r["error"] for r in got} == {"empty": "the archive is empty", "none": "the specification is empty", "junk": "not a zip archive", "twins": "more than one spec.md"}


def test_ids_that_are_taken_are_drawn_again(spark, tmp_path):
    root, seen = str(tmp_path / "u"), []

    def make_id():
        seen.append(1)
        return F.lit("a" * 16) if len(seen) <= 2 else F.concat(F.lit("b" * 15), F.col("upload"))

    rows = [(str(k), "n", SPEC, [("a.py", "x")]) for k in range(3)]
    done = {r["upload"]: r["id"] for r in uploads.materialised(spark, pasted(spark, rows), root, make_id).collect()}
    assert sorted(done.values())[0] == "a" * 16 and len(set(done.values())) == 3 and len(seen) == 3
    with pytest.raises(AttributeError):
        uploads.reread(spark, root, "a" * 16)[0].missing  # noqa: B018
    for other in ("A" * 16, "a" * 15, "../x", "", None, "c" * 16):
        assert uploads.reread(spark, root, other) is None


def test_retention_lets_old_uploads_go(spark, tmp_path):
    root = tmp_path / "u"
    rows = [(str(k), "n", SPEC, [("a.py", "x")]) for k in range(2)]
    ids = [r["id"] for r in uploads.materialised(spark, pasted(spark, rows), str(root)).orderBy("upload").collect()]
    half = {"old": "0" * 16, "new": "1" * 16}
    for name in half.values():
        (root / "files" / f"id={name}").mkdir()
    reader = uploads.reread(spark, str(root), ids[1])[1]
    before = 1_000_000_000
    for folder in (root / "manifests" / f"id={ids[0]}", root / "files" / f"id={half['old']}"):
        os.utime(folder, (before, before))
    assert uploads.pruned(spark, str(root), 0) == []
    assert sorted(uploads.pruned(spark, str(root), 3600)) == sorted([ids[0], half["old"]])
    assert uploads.reread(spark, str(root), ids[0]) is None and not (root / "files" / f"id={ids[0]}").exists()
    assert reader.count() == 1 and (root / "files" / f"id={half['new']}").exists() and uploads.reread(spark, str(root), half["new"]) is None
