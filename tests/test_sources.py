"""Trees, rule files, the report and the stream."""

import json

import pytest

from clausewright.operators import rules
from clausewright.plans import report
from clausewright.sources import rulefiles, trees
from clausewright.streaming import watch


@pytest.fixture()
def tree(tmp_path):
    files = {
        "LICENSE": b"Released under the MIT License.\n", "src/a.py": b"# Licensed under the Apache License, Version 2.0\nx = 1\n",
        "src/b.py": b"# nothing\n", "src/bin.dat": b"ab\0cd MIT License", "vendor/c.py": b"MIT License", ".git/config": b"MIT License", ".hidden": b"MIT License",
        "wide.txt": b"\xff\xfe" + "é MIT License".encode("utf-16-le"), "old.txt": "é MIT License".encode("latin-1"), "mark.txt": b"\xef\xbb\xbfMIT License",
        "big.txt": b"x" * 3000, "package.json": json.dumps({"license": "MIT"}).encode(), "sub/package.json": b"{broken", "split.py": b"# MIT\n\n# License\n",
        "tag.c": b"/* SPDX-License-Identifier: MIT OR Apache-2.0 */\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link").symlink_to(tmp_path / "LICENSE")
    return tmp_path


def test_discover(tree):
    found = trees.discover(str(tree), trees.ScanOptions(max_file_size=2000))
    assert [t[2] for t in found.tasks] == [".hidden", "LICENSE", "mark.txt", "old.txt", "package.json", "split.py", "src/a.py", "src/b.py", "src/bin.dat", "sub/package.json", "tag.c", "wide.txt"]
    assert sorted(found.skipped) == [(".git", "version-control"), ("big.txt", "size"), ("link", "symlink"), ("vendor", "project-scope")]
    assert trees.discover(str(tree), trees.ScanOptions(max_files=3)).truncated
    assert ("src", "depth") not in trees.discover(str(tree), trees.ScanOptions(max_depth=1)).skipped
    with pytest.raises(ValueError):
        trees.ScanOptions(max_depth=-1)


@pytest.mark.parametrize("data, encoding, text", [(b"abc", "utf-8", "abc"), (b"\xef\xbb\xbfa", "utf-8-bom", "a"), ("aé".encode("utf-16"), "utf-16le", "aé"), (b"\xe9", "iso-8859-1", "é"), (b"\xff\xfexyz", "iso-8859-1", "ÿþxyz"), (b"", "utf-8", "")])
def test_decode(data, encoding, text):
    assert trees.decode(data) == (encoding, text)


def test_offsets_point_into_the_file():
    for encoding, data in (("utf-8-bom", b"\xef\xbb\xbf" + "é 🎉 MIT".encode()), ("utf-16le", "é 🎉 MIT".encode("utf-16")), ("iso-8859-1", "é ä MIT".encode("latin-1"))):
        name, text = trees.decode(data)
        at = trees.raw_offset(text, name, text.encode().index(b"MIT"))
        assert name == encoding and data[at:].startswith("MIT".encode("utf-16-le" if "16" in encoding else "ascii"))


def test_report(spark, tree):
    found = report.scan_repository(spark, str(tree), options=trees.ScanOptions(max_file_size=2000), matched_text=True)
    files = {f["path"]: f for f in found["files"]}
    assert {"LICENSE", "src/a.py", "wide.txt", "old.txt", "mark.txt", ".hidden", "tag.c"} <= files.keys() and "src/b.py" not in files
    assert files["LICENSE"]["roles"] == ["license"]
    for name, data in (("wide.txt", "MIT License".encode("utf-16-le")), ("old.txt", b"MIT License"), ("mark.txt", b"MIT License")):
        m = files[name]["detections"][0]["matches"][0]
        assert (tree / name).read_bytes()[m["start"] : m["end"]] == data
    assert not files["split.py"]["detections"] and files["split.py"]["clues"]
    assert found["declared"] == [{"path": "package.json", "raw": ["MIT"], "license_file": "", "normalized_expression": "MIT"}]
    assert [e["path"] for e in found["errors"]] == ["sub/package.json"]
    s = found["summary"]
    assert (s["files_visited"], s["files_scanned"], s["files_skipped_binary"], s["files_skipped_size"], s["files_skipped_other"], s["directories_skipped"]) == (14, 11, 1, 1, 1, 2)
    assert report.exit_code(found) == 2 and "LICENSE" in report.human(found)
    assert any(e["root"] for e in found["expressions"])
    json.dumps(found)


def test_empty_tree(spark, tmp_path):
    found = report.scan_repository(spark, str(tmp_path))
    assert found["files"] == [] and report.exit_code(found) == 3


def test_rule_files(spark, tmp_path):
    (tmp_path / "x.RULE").write_text("\n---\nlicense_expression: mit\nis_license_notice: yes\nrelevance: 90\n---\n\nunder the terms of X\n")
    (tmp_path / "y.LICENSE").write_text("---\nkey: isc\n---\nthe text\n")
    (tmp_path / "notes.txt").write_text("no rule")
    raw = rulefiles.load_directory(spark, str(tmp_path))
    assert sorted(tuple(r) for r in raw.collect()) == [("x.RULE", "mit", "under the terms of X", 4, 90), ("y.LICENSE", "isc", "the text", 2, 100)]
    prepared = rules.prepare(raw)
    assert rules.violations(prepared).isEmpty()
    rulefiles.write_table(prepared, f"{tmp_path}/out")
    assert sorted(rulefiles.read_table(spark, f"{tmp_path}/out").collect()) == sorted(prepared.collect())
    for bad in ("no front", "---\nkey: x\n", "---\nrelevance: 101\nlicense_expression: mit\n---\nx", "---\na: b\n---\nx"):
        with pytest.raises(ValueError):
            rulefiles.parse_rule("z.RULE", bad)


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Released under the MIT License"), (2, "no")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    q = watch.start(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), rules.builtin(spark), f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    q.awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1}


@pytest.mark.parametrize("data", [b"plain\x01text", b"plain\0text", b"x" * trees.PROBE + b"\0", b"%PDF-1.7\n%%EOF\n"])
def test_binary(data):
    assert trees.decode(data) is None


def test_limit_counts_visited_files(tmp_path):
    for name, n in (("a", 3000), ("b", 3000), ("c", 1), ("d", 1)):
        (tmp_path / name).write_bytes(b"x" * n)
    found = trees.discover(str(tmp_path), trees.ScanOptions(max_files=2, max_file_size=100))
    assert found.truncated and found.visited == 2 and found.tasks == [] and len(found.skipped) == 2


def test_explicit_file_keeps_the_role_of_its_folder(spark, tmp_path):
    (tmp_path / "LICENSES").mkdir()
    (tmp_path / "LICENSES" / "component.txt").write_text("Released under the MIT License.")
    found = report.scan_repository(spark, f"{tmp_path}/LICENSES/component.txt")
    assert [(f["path"], f["roles"]) for f in found["files"]] == [("component.txt", ["license"])]
    assert found["expressions"] and all(e["root"] for e in found["expressions"]) and found["summary"]["files_visited"] == 1


def test_too_many_candidates_are_an_error(spark, tmp_path):
    (tmp_path / "many.txt").write_text("MIT License " * 6)
    (tmp_path / "few.txt").write_text("MIT License " * 5)
    found = report.scan_repository(spark, str(tmp_path), limit=5)
    assert [e["path"] for e in found["errors"]] == ["many.txt"] and [f["path"] for f in found["files"]] == ["few.txt"]
    assert found["summary"]["files_scanned"] == 2 and report.exit_code(found) == 2


def test_mappings(spark, tmp_path):
    """A licence's own key goes first, then primary SPDX keys, then others; the first file among equals."""
    for name, text in (("a", "key: apache\nspdx_license_key: Apache-2.0\nother_spdx_license_keys:\n  - MIT\n  - Old-Apache\n"), ("b", "key: mit\nspdx_license_key: MIT\n"), ("c", "key: other\nother_spdx_license_keys:\n- Old-Apache\n- Apache\n")):
        (tmp_path / f"{name}.LICENSE").write_text(f"---\n{text}---\ntext\n")
    keys, reporting = rulefiles.load_mappings(str(tmp_path))
    assert keys == {"apache": "apache", "mit": "mit", "other": "other", "apache-2.0": "apache", "licenseref-scancode-other": "other", "old-apache": "apache"}
    assert reporting == {"apache": "Apache-2.0", "mit": "MIT", "other": "LicenseRef-scancode-other"}
    a, b = rulefiles.mappings(spark.createDataFrame(rulefiles.metadata(str(tmp_path)), "file string, key string, spdx_key string, others array<string>"))
    assert dict(map(tuple, a.collect())) == keys and dict(map(tuple, b.collect())) == reporting
    (tmp_path / "d.LICENSE").write_text("---\nname: x\n---\n")
    with pytest.raises(ValueError):
        rulefiles.load_mappings(str(tmp_path))


def test_version_file(tmp_path):
    good = tmp_path / "v"
    good.write_text(f"# pinned\nversion = 1.2\n\ncommit={'ab' * 20}\n")
    assert rulefiles.read_version(str(good)) == ("1.2", "ab" * 20)
    for text in ("version=1", f"version=1\ncommit={'zz' * 20}", "version=1\nversion=2", "name=x", "version", f"commit={'ab' * 20}"):
        good.write_text(text)
        with pytest.raises(ValueError):
            rulefiles.read_version(str(good))


def test_read_table_rejects(spark, tmp_path):
    prepared = rules.builtin(spark)
    rulefiles.write_table(prepared.withColumn("rule_index", prepared["rule_index"] + 1), f"{tmp_path}/order")
    rulefiles.write_table(prepared.unionByName(prepared), f"{tmp_path}/twice")
    for name in ("order", "twice"):
        with pytest.raises(ValueError):
            rulefiles.read_table(spark, f"{tmp_path}/{name}")


def test_command_line(spark, tree, tmp_path, capsys):
    from clausewright.__main__ import main

    assert main([str(tree / "LICENSE"), "--json", "--workers", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["expressions"][0]["expression"] == "MIT"
    assert main([str(tree / "LICENSE"), "--deny", "mit"]) == 1
    said = capsys.readouterr()
    assert "::error file=LICENSE::MIT" in said.err and "| MIT | 1 |" in said.err and "1 of 1 files scanned (32 B)" in said.out
    assert main([f"{tree}/no-such"]) == 1 and main([str(tree), "--workers", "0"]) == 1
    assert main(["--version"]) == 0 and "18 built-in rules" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([str(tree), "--scope", "all"])
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "x.LICENSE").write_text("---\nkey: x-key\nspdx_license_key: X-1.0\n---\nreleased under the\n")
    main([str(tree / "LICENSE"), "--json", "--rules", f"{tmp_path}/own"])
    assert [e["expression"] for e in json.loads(capsys.readouterr().out)["expressions"]] == ["X-1.0"]
