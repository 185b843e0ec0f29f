"""python -m tessera COMMAND TARGET: sweep, surfaces, structure, closure or recon of a tree, into a workspace folder.

Exit codes: 0 done, 2 usage or a partial review, 3 a fault of ours.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import slug
from .operators import closure, manifests, recon, review, structure, sweep
from .plans import rules as R
from .session import ship
from .sources import filesystem


def workspace(base: str, root: str, name: str) -> str:
    """base/name/version, for its owner only; never inside the target."""
    folder = os.path.join(os.path.abspath(base), name, manifests.version_of(root))
    if os.path.commonpath([os.path.realpath(root), os.path.realpath(folder)]) == os.path.realpath(root):
        raise filesystem.Refused("the workspace may not be inside the target")
    os.makedirs(folder, mode=0o700, exist_ok=True)
    return folder


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("command", choices=["sweep", "surfaces", "structure", "closure", "recon"])
    p.add_argument("target")
    p.add_argument("--workspace", default="review")
    p.add_argument("--exclude", help="folders not to walk, comma-separated; replaces the default")
    p.add_argument("--max-file-bytes", type=int, default=filesystem.MAX_BYTES)
    p.add_argument("--rules", nargs="*", help="packs to use instead of the built-in ones")
    p.add_argument("--entry", action="append", default=[], help="a root of the closure")
    a = p.parse_args(argv)
    if not os.path.isdir(a.target) or a.max_file_bytes < 1:
        print("the target must be a folder, the bound a positive number", file=sys.stderr)
        return 2
    spark = ship(SparkSession.builder.getOrCreate())
    try:
        name = spark.createDataFrame([(os.path.basename(os.path.realpath(a.target)),)], "n string").select(slug("n")).first()[0]
        folder = workspace(a.workspace, a.target, name)
        options = {"maxBytes": str(a.max_file_bytes)} | ({"exclude": a.exclude} if a.exclude is not None else {})
        inventory = filesystem.walk(spark, os.path.realpath(a.target), **options).cache()
        files = sweep.readable(inventory)
        report = recon.recon(inventory, files.select("path", "content")).cache()
        entries = manifests.entry_points(files).cache()
        unparsed = entries.filter("unreadable is not null").select("path", "unreadable").distinct()
        partial = recon.verdict(report, unparsed).first()[0] != 0
        version, said = None, []
        if a.command == "recon":
            with open(os.path.join(folder, "recon.json"), "w", encoding="utf-8") as f:
                json.dump(report.first().asDict(recursive=True) | {"coverage_gaps": recon.coverage_gaps(report).first()[0], "entry_points": [r.asDict() for r in entries.filter("unreadable is null").orderBy("path", "command").drop("unreadable").collect()], "manifests_unreadable": [r.asDict() for r in unparsed.orderBy("path", "unreadable").collect()], "version": manifests.version_of(a.target), "excluded": filesystem.present(a.target)}, f, indent=2, ensure_ascii=False)
        else:
            if a.command == "sweep":
                rules = R.load(a.rules) if a.rules else R.agentic()
                block, source = sweep.pattern_hits(files, rules), "pattern"
            elif a.command == "surfaces":
                rules = R.load(a.rules, "kinds") if a.rules else R.kinds()
                block, source = sweep.surface_hits(files, rules), "surface"
            elif a.command == "structure":
                rules = R.load(a.rules, "rules") if a.rules else R.structural()
                block, source = structure.structure_hits(files, rules), "structure"
                partial |= not structure.unparsed(files).isEmpty()
            else:
                rules = []
                resolved = closure.resolve(closure.references(files), inventory)
                roots = closure.default_roots(inventory).unionByName(manifests.roots(entries, inventory).select("path"))
                if a.entry:
                    roots = closure.given(spark, a.entry)
                    resolved = resolved.unionByName(closure.absent(roots, inventory))
                if roots.isEmpty():
                    print("no root: name one with --entry", file=sys.stderr)
                    return 2
                reached = closure.reach(resolved.filter("dst is not null").select(F.col("from_path").alias("src"), "dst"), roots)
                block, source = closure.records(resolved, files, reached, roots), "closure"
                members = closure.described(closure.members(resolved, reached.join(inventory.select("path"), "path", "left_semi")), inventory, files).cache()
                said = [r[0] for r in closure.gaps(members, inventory, reached).collect()]
                listed = lambda df, *by: [r.asDict(recursive=True) for r in df.orderBy(*by).toLocalIterator()]
                with open(os.path.join(folder, "closure.json"), "w", encoding="utf-8") as f:
                    json.dump({"roots": listed(roots.distinct(), "path"), "members": listed(members, "path"), "unresolved": listed(closure.unresolved(resolved, reached), "reference", "rule_id", "load"), "unreachable": [r["path"] for r in listed(closure.unreachable(inventory, reached), "path")], "coverage_gaps": said}, f, indent=2, ensure_ascii=False)
            version = sorted({r.version for r in rules})
            table = os.path.join(folder, "ledger")
            if os.path.isdir(table) and not review.foreign(spark.read.schema(review.SCHEMA).parquet(table)).isEmpty():
                print("the ledger holds rows that are not ours", file=sys.stderr)
                return 2
            block = block.cache()
            mine = block.groupBy("rule_id").count().orderBy("rule_id").collect()
            review.write_ledger(block, table, source)
            n = review.to_jsonl(spark.read.schema(review.SCHEMA).parquet(table), os.path.join(folder, "hits.jsonl"))
            print(f"{source}: {sum(r['count'] for r in mine)} candidates")
            for r in mine:
                print(f"  {r['rule_id']}: {r['count']}")
            print(f"ledger: {n} candidates in {os.path.join(folder, 'hits.jsonl')}")
            for gap in said:
                print(f"gap: {gap}")
        manifests.record_run(folder, a.command, {"rules": version, "partial": bool(partial)})
        if partial:
            for gap in recon.coverage_gaps(report).first()[0] + [f"{r['path']}: {r['unreadable']}" for r in unparsed.orderBy("path", "unreadable").collect()]:
                print(f"partial: {gap}", file=sys.stderr)
        return 2 if partial else 0
    except (R.RuleError, filesystem.Refused, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
