"""Entry points, versions, archetypes, order, and the command line."""

import json
import os

from tessera import __main__ as cli
from tessera.operators import manifests


def test_entry_points(spark):
    files = [("pyproject.toml", '[project.scripts]\nrun = "pkg.cli:main"\n'), ("web/package.json", '{"bin": {"w": "./bin/w.js"}}'), ("x/package.json", '{"bin": 3}'), ("y/pyproject.toml", "["), ("src/pkg/cli.py", ""), ("web/bin/w.js", "")]
    corpus = spark.createDataFrame(files, "path string, content string")
    entries = manifests.entry_points(corpus)
    assert {(r["path"], r["command"], r["target"]) for r in entries.filter("target is not null").collect()} == {("pyproject.toml", "run", "pkg.cli:main"), ("web/package.json", "w", "./bin/w.js")}
    assert {r["path"] for r in entries.filter("unreadable is not null").collect()} == {"x/package.json", "y/pyproject.toml"}
    assert {r["path"] for r in manifests.roots(entries, corpus).collect()} == {"src/pkg/cli.py", "web/bin/w.js"}


def test_git(tmp_path):
    assert manifests.git_identity(str(tmp_path)) == ("directory", None)
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    assert manifests.git_identity(str(tmp_path)) == ("git", None)
    (tmp_path / ".git" / "packed-refs").write_text("# x\n" + "a" * 40 + " refs/heads/main\n")
    assert manifests.git_identity(str(tmp_path)) == ("git", "a" * 40)
    (tmp_path / ".git" / "HEAD").write_text("ref: ../../etc/passwd\n")
    assert manifests.version_of(str(tmp_path)) == "unversioned"


def test_archetypes_and_order(spark):
    hits = spark.createDataFrame([("surface.mcp_tool",), ("surface.mcp_tool",), ("surface.cli_command",)], "rule_id string")
    assert {(r[0], r[1]) for r in manifests.archetypes(hits).collect()} == {("core", 0), ("mcp-server", 2)}
    rows = [("a", "high", 1), ("b", "medium", 3), ("c", "critical", 3), ("d", "medium", 1)]
    got = manifests.report_order(spark.createDataFrame(rows, "id string, severity string, cost int")).orderBy("place").collect()
    assert [r["id"] for r in got] == ["a", "d", "c", "b"]


def test_command_line(spark, tmp_path):
    target = tmp_path / "Tärget"
    target.mkdir()
    (target / "SKILL.md").write_text("description: any task\nsee run.py and gone.py\n")
    (target / "run.py").write_text("def f(p):\n    eval(p)\n    return open(p)\n")
    run = lambda *a: cli.main([*a, str(target), "--workspace", str(tmp_path / "w")])
    assert [run(c) for c in ("sweep", "surfaces", "structure", "closure", "recon")] == [0] * 5
    folder = tmp_path / "w" / "target" / "unversioned"
    rows = [json.loads(x) for x in (folder / "hits.jsonl").read_text().splitlines()]
    assert [s for s in dict.fromkeys(r["source"] for r in rows)] == ["pattern", "surface", "structure", "closure"]
    before = (folder / "hits.jsonl").read_bytes()
    assert run("surfaces") == 0 and (folder / "hits.jsonl").read_bytes() == before
    assert set(json.loads((folder / "run.json").read_text())) == {"sweep", "surfaces", "structure", "closure", "recon"}
    assert oct(os.stat(folder).st_mode)[-3:] == "700"
    assert cli.main(["sweep", str(target), "--workspace", str(target)]) == 2


def test_partial_reviews_and_entries(spark, tmp_path, capsys):
    target = tmp_path / "t"
    target.mkdir()
    (target / "SKILL.md").write_text("see run.py\n")
    (target / "run.py").write_text("import os\nopen('gone.cfg')\n")
    (target / "tool.rb").write_text("puts 1\n")
    run = lambda *a: cli.main([a[0], str(target), "--workspace", str(tmp_path / "w"), *a[1:]])
    folder = tmp_path / "w" / "t" / "unversioned"
    assert run("closure") == 0
    said = json.loads((folder / "closure.json").read_text())
    assert {m["path"]: (m["kind"], m["lines"]) for m in said["members"]} == {"SKILL.md": ("data", 1), "run.py": ("source", 2)}
    assert said["unreachable"] == ["tool.rb"] and any("tool.rb" in g for g in said["coverage_gaps"])
    out = capsys.readouterr().out
    assert "closure.missing_reference: 1" in out and "gap: " in out
    row = json.loads((folder / "hits.jsonl").read_text())
    assert (row["layer"], row["file"], row["line"], row["match_excerpt"]) == ("code", "run.py", 2, "open('gone.cfg')")
    # an entry that is absent is a candidate, one outside is the caller's fault
    assert run("closure", "--entry", "nowhere.md", "--entry", "tool.rb") == 0
    row = json.loads((folder / "hits.jsonl").read_text())
    assert (row["file"], row["line"], row["match_excerpt"], row["rule_id"]) == ("nowhere.md", 0, "nowhere.md", "closure.missing_reference")
    assert run("closure", "--entry", "../x") == 2 and run("closure", "--entry", "/etc/passwd") == 2
    # what was fixed leaves the ledger
    (target / "run.py").write_text("import os\n")
    assert run("closure") == 0 and (folder / "hits.jsonl").read_text() == ""
    # a manifest that can't be understood, and a binary of no known kind, make a review partial; a database doesn't
    (target / "data.sqlite").write_bytes(bytes(100))
    assert run("recon") == 0
    (target / "package.json").write_text("{")
    assert run("recon") == 2 and json.loads((folder / "recon.json").read_text())["manifests_unreadable"][0]["path"] == "package.json"
    assert "package.json" in capsys.readouterr().err


def test_capped_and_followed(spark):
    from tessera.operators import review

    rows = [("a", "critical", "network", None, False, True), ("b", "critical", "mcp-tool", "instruction", True, False), ("c", "high", "cli-only", "poc", False, False), ("d", "high", "cli-only", "poc", False, True), ("e", "high", "unreachable", "poc", False, True), ("f", "low", "remote", "poc", False, True)]
    found = review.severity(spark.createDataFrame(rows, "id string, impact string, reachability string, evidence_type string, dangerous boolean, crosses_boundary boolean"))
    assert {r["id"]: (r["severity"], r["capped_by"]) for r in found.collect()} == {"a": ("observation", "no proof"), "b": ("critical", ""), "c": ("medium", "cli-only"), "d": ("high", ""), "e": ("informational", "unreachable"), "f": (None, "")}
    gone = spark.createDataFrame([("a", "still-vulnerable", True, 1), ("b", "inconclusive", True, 1), ("c", None, False, 2), ("d", None, False, 0)], "id string, poc string, anchor boolean, widened int")
    assert {r["id"]: r["step"] for r in review.follow_up(gone).collect()} == {"a": "poc", "b": "anchor", "c": "sweep", "d": "manual"}
