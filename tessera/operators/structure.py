"""Structural candidates: source parsed into nested vocabulary, then judged by expressions over arrays."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import Rule
from .sweep import identify

ARG = "struct<kind:string,name:string,literal_type:string,names:array<string>,calls:array<string>>"
CALL = f"struct<callee:string,line:int,col:int,args:array<{ARG}>,keywords:array<struct<name:string,value:{ARG}>>>"
UNIT = f"name string, line int, end_line int, parameters array<string>, calls array<{CALL}>, assignments array<struct<targets:array<string>,value:{ARG},line:int>>, tests array<struct<line:int,size:int,negated:boolean>>, returns array<struct<line:int,value:{ARG}>>"
FIELDS = ["name", "line", "end_line", "parameters", "calls", "assignments", "tests", "returns"]
MODULE = "<module>"
_TYPES = {bool: "bool", str: "string", int: "number", float: "number", complex: "number", bytes: "bytes", type(None): "none"}
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def _name(node: ast.AST) -> str:
    """a.b.c of an attribute chain on a name; empty for all else."""
    tail = ""
    while isinstance(node, ast.Attribute):
        tail, node = f".{node.attr}{tail}", node.value
    return node.id + tail if isinstance(node, ast.Name) else ""


def _inside(node: ast.AST, wanted: tuple, name) -> list[str]:
    found = sorted((x.lineno, x.col_offset, label) for x in ast.walk(node) if isinstance(x, wanted) and (label := name(x)))
    return list(dict.fromkeys(label for *_, label in found))


def _texty(node: ast.AST) -> bool:
    if isinstance(node, ast.BinOp):
        return _texty(node.left) or _texty(node.right)
    return isinstance(node, ast.JoinedStr) or (isinstance(node, ast.Constant) and isinstance(node.value, str))


def _argument(node: ast.AST) -> dict:
    built = isinstance(node, ast.JoinedStr) or (isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add)) and _texty(node)) or (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("format", "format_map"))
    if built:
        kind = "interpolated"
    elif isinstance(node, ast.Constant):
        kind = "literal"
    elif isinstance(node, (ast.Name, ast.Attribute)):
        kind = "name"
    else:
        kind = "call" if isinstance(node, ast.Call) else "other"
    label = _name(node.func if isinstance(node, ast.Call) else node)
    return {"kind": kind, "name": label, "literal_type": _TYPES.get(type(node.value), "other") if isinstance(node, ast.Constant) else "", "names": _inside(node, (ast.Name, ast.Attribute), _name), "calls": _inside(node, (ast.Call,), lambda x: _name(x.func))}


def _body(statements: list[ast.AST]) -> dict:
    """What a body holds, without the bodies of functions, lambdas and classes in it."""
    calls, assignments, tests, returns = [], [], [], []
    todo = list(reversed(statements))
    while todo:
        node = todo.pop()
        if isinstance(node, _SCOPES):
            continue
        if isinstance(node, ast.Call) and (callee := _name(node.func)):
            named = sorted(((k.arg, _argument(k.value)) for k in node.keywords if k.arg is not None), key=lambda x: x[0])
            calls.append({"callee": callee, "line": node.lineno, "col": node.col_offset, "args": [_argument(a) for a in node.args], "keywords": [{"name": k, "value": v} for k, v in named]})
        elif isinstance(node, ast.Assign) and (targets := [t for t in map(_name, node.targets) if t]):
            assignments.append({"targets": targets, "value": _argument(node.value), "line": node.lineno})
        elif isinstance(node, ast.Compare):
            for op, right in zip(node.ops, node.comparators, strict=True):
                items = right.keys if isinstance(right, ast.Dict) else getattr(right, "elts", None) if isinstance(right, (ast.List, ast.Tuple, ast.Set)) else None
                if isinstance(op, (ast.In, ast.NotIn)) and items is not None and all(isinstance(x, ast.Constant) for x in items):
                    tests.append({"line": node.lineno, "size": len(items), "negated": isinstance(op, ast.NotIn)})
        elif isinstance(node, ast.Return):
            returns.append({"line": node.lineno, "value": _argument(node.value) if node.value else None})
        todo += reversed(list(ast.iter_child_nodes(node)))
    calls.sort(key=lambda c: (c["line"], c["col"]))
    return {"calls": calls, "assignments": assignments, "tests": tests, "returns": returns}


def parse(source: str) -> tuple[list[dict], str | None]:
    """Bodies of a Python source, the module's own first; or why it can't be read. Nothing of it is run."""
    try:
        tree = ast.parse(source)
        out = [{"name": MODULE, "line": 1, "end_line": max([n.end_lineno or n.lineno for n in tree.body], default=1), "parameters": []} | _body(tree.body)]
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                given = [*a.posonlyargs, *a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)]
                out.append({"name": node.name, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "parameters": [x.arg for x in given]} | _body(node.body))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [], f"{type(e).__name__}: {e}"
    return sorted(out, key=lambda f: (f["line"], f["name"])), None


def units(corpus: DataFrame) -> DataFrame:
    """One row for each body of each Python file, or one with `failure`: a file that can't be read never ends the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                bodies, failure = parse(content)
                rows += [{"path": path, "failure": None} | b for b in bodies] or [{"path": path, "failure": failure or "empty"} | dict.fromkeys(FIELDS)]
            yield pd.DataFrame(rows, columns=["path", "failure", *FIELDS])

    python = corpus.select("path", "content").filter(F.col("content").isNotNull() & F.coalesce(T.language_of(F.col("path")) == "python", F.lit(False)))
    return python.mapInPandas(run, f"path string, failure string, {UNIT}")


def _matches(callee: Column, names: list[str]) -> Column:
    bare = [n for n in names if "." not in n]
    return callee.isin(names) | F.element_at(F.split(callee, r"\.", -1), -1).isin(bare)


def _values(call: Column) -> Column:
    return F.concat(call["args"], F.transform(call["keywords"], lambda k: k["value"]))


def findings(rule: Rule) -> Column:
    """Array of (line, col) where a body has the rule's shape."""
    p = rule.parameters
    spot = lambda c: F.struct(c["line"].alias("line"), c["col"].alias("col"))
    if rule.shape == "order_of_operations":
        made = F.filter("calls", lambda c: _matches(c["callee"], p["creating_calls"]) & ~F.exists(c["keywords"], lambda k: k["name"].isin(p["fused_keywords"])))
        first = F.array_min(F.transform(made, spot))
        return F.transform(F.filter("calls", lambda c: _matches(c["callee"], p["permission_calls"]) & (spot(c) > first)), spot)
    if rule.shape == "decision_shape":
        said = F.filter(F.transform("returns", lambda r: r["value"]), lambda v: v.isNotNull())
        named = F.exists(F.array(*[F.lit(x) for x in p["validating_name_fragments"]]), lambda x: F.instr(F.lower("name"), x) > 0)
        gate = named & (F.size(said) > 0) & F.forall(said, lambda v: v["literal_type"] == "bool")
        tests = F.filter("tests", lambda t: (t["size"] >= p["minimum_alternatives"]) & ~t["negated"])
        return F.when(gate, F.transform(tests, lambda t: F.struct(t["line"].alias("line"), F.lit(0).alias("col"))))
    if rule.shape == "unvalidated_reach":
        valid = lambda calls: F.exists(calls, lambda c: _matches(c, p["validating_calls"]))
        checked = F.flatten(F.transform(F.filter("assignments", lambda a: valid(a["value"]["calls"])), lambda a: a["targets"]))
        reaches = lambda v: ~valid(v["calls"]) & F.arrays_overlap(v["names"], F.col("parameters")) & ~F.arrays_overlap(v["names"], checked)
        return F.transform(F.filter("calls", lambda c: _matches(c["callee"], p["sink_calls"]) & F.exists(_values(c), reaches)), spot)
    return F.transform(F.filter("calls", lambda c: _matches(c["callee"], p["dangerous_calls"]) & F.exists(_values(c), lambda v: v["kind"] == "interpolated")), spot)


def structure_hits(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows of all structural rules; a finding's window is clipped to its body."""
    each = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.precision).alias("precision"), F.lit(r.question).alias("question"), F.lit(r.version).alias("version"), findings(r).alias("spots")) for r in rules])
    found = units(corpus).filter("failure is null").select("path", "line", "end_line", F.inline(each)).filter("size(spots) > 0")
    found = found.select("path", (F.col("line") - 1).alias("first"), (F.col("end_line") - 1).alias("last"), "rule_id", "layer", "precision", "question", "version", F.inline("spots"))
    files = corpus.filter("content is not null").select("path", T.split_lines(F.col("content")).alias("lines"))
    rows = found.join(files, "path")
    index = F.col("line") - 1
    text = F.try_element_at("lines", F.col("line"))
    rows = rows.withColumn("window_sha256", T.window_sha(T.window(F.col("lines"), index, F.col("first"), F.col("last")))).withColumn("match_excerpt", F.coalesce(T.excerpt(text, F.lit(0), F.length(text)), F.lit(""))).drop("lines")
    ranked = identify(rows, ["line", "col"])
    return ranked.select("id", F.col("path").alias("file"), "line", "layer", F.lit("structure").alias("source"), "rule_id", "precision", F.trim(F.regexp_replace("question", r"\s+", " ")).alias("question"), "match_excerpt", F.lit("unresolved").alias("status"), F.col("version").alias("catalog_version"), F.lit("block-20").alias("window_spec"))


def unparsed(corpus: DataFrame) -> DataFrame:
    return units(corpus).filter("failure is not null").select("path", "failure")
