"""Rule packs: loading, strict validation, and the tables that plans are built from."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

LAYERS, PRECISIONS = {"code", "instruction", "manifest"}, {"high", "medium", "low"}
HINTS = {"high", "medium", "low", "observation", "informational"}
RESERVED = ("surface.", "structure.", "closure.")
SHAPES = {
    "order_of_operations": {"creating_calls": list, "permission_calls": list, "fused_keywords": list},
    "decision_shape": {"minimum_alternatives": int, "validating_name_fragments": list},
    "unvalidated_reach": {"sink_calls": list, "validating_calls": list},
    "sink_adjacency": {"dangerous_calls": list},
}
HOME = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules")


class RuleError(ValueError):
    """A pack that is not what it must be; names the file and the rule."""


@dataclass(frozen=True)
class Rule:
    id: str
    layer: str
    condition: str
    precision: str
    question: str
    version: str
    ignore_case: bool = False
    hint: str = ""
    languages: tuple = ()
    files: tuple = ()
    paths_exclude: tuple = ()
    shape: str = ""
    parameters: dict = field(default_factory=dict, hash=False)

    @property
    def java(self) -> str:
        """The condition for Java: Unicode classes, newline as the only line end."""
        return ("(?dUiu)" if self.ignore_case else "(?dU)") + self.condition


def pack_path(name: str) -> str:
    return os.path.join(HOME, f"{name}.json")


def document(path: str) -> dict:
    """A pack from JSON, or from YAML where a YAML library is at hand."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
    except Exception as e:
        raise RuleError(f"{path}: unreadable: {e}") from e
    if not isinstance(found, dict) or not isinstance(found.get("version"), str):
        raise RuleError(f"{path}: a pack is a mapping with a version")
    return found


def _text(raw: dict, key: str, at: str) -> str:
    if not isinstance(raw.get(key), str) or not raw[key].strip():
        raise RuleError(f"{at}: {key} must be a non-empty text")
    return raw[key]


def _names(raw: dict, key: str, at: str) -> tuple:
    value = raw.get(key, [])
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
        raise RuleError(f"{at}: {key} must be a list of texts")
    return tuple(value)


def _rule(raw: object, at: str, kind: str, version: str, file: str) -> Rule:
    if not isinstance(raw, dict):
        raise RuleError(f"{at}: a rule is a mapping")
    at = f"{at} {raw.get('id', '?')}"
    common = {"id", "layer", "precision", "question", "references"}
    allowed = {
        "patterns": common | {"regex", "flags", "default_severity_hint", "languages", "paths_exclude", "owasp"},
        "kinds": common | {"files", "declaration"},
        "rules": common | {"shape", "parameters"},
    }[kind]
    if unknown := set(raw) - allowed:
        raise RuleError(f"{at}: unknown keys {sorted(unknown)}")
    name = _text(raw, "id", at)
    layers = _names(raw, "layer", at)
    if len(layers) != 1 or layers[0] not in LAYERS:
        raise RuleError(f"{at}: layer must be one of {sorted(LAYERS)}")
    if raw.get("precision") not in PRECISIONS:
        raise RuleError(f"{at}: precision must be one of {sorted(PRECISIONS)}")
    own = {"patterns": "", "kinds": "surface.", "rules": "structure."}[kind]
    if (own and not name.startswith(own)) or (not own and name.startswith(RESERVED)):
        raise RuleError(f"{at}: the id is in another source's namespace")
    values: dict = {}
    if kind == "rules":
        shape = raw.get("shape")
        if shape not in SHAPES:
            raise RuleError(f"{at}: unknown shape {shape!r}")
        given = raw.get("parameters")
        if not isinstance(given, dict) or set(given) != set(SHAPES[shape]):
            raise RuleError(f"{at}: parameters must be {sorted(SHAPES[shape])}")
        for key, wanted in SHAPES[shape].items():
            value = given[key]
            if wanted is int and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
                raise RuleError(f"{at}: {key} must be a positive number")
            if wanted is list:
                _names(given, key, at)
                if not value:
                    raise RuleError(f"{at}: {key} is empty")
        return Rule(name, layers[0], "", raw["precision"], _text(raw, "question", at), version, shape=shape, parameters=given)
    condition = _text(raw, "regex" if kind == "patterns" else "declaration", at)
    flags = _names(raw, "flags", at)
    if set(flags) - {"i"}:
        raise RuleError(f"{at}: the only flag is i")
    try:
        compiled = re.compile(condition, re.I if flags else 0)
    except re.error as e:
        raise RuleError(f"{at}: {e}") from e
    if compiled.search(""):
        raise RuleError(f"{at}: it matches the empty text")
    if kind == "kinds":
        values["files"] = _names(raw, "files", at)
        if not values["files"]:
            raise RuleError(f"{at}: files is empty")
    else:
        if raw.get("default_severity_hint") not in HINTS:
            raise RuleError(f"{at}: default_severity_hint must be one of {sorted(HINTS)}")
        stem = os.path.splitext(os.path.basename(file))[0].lstrip("_")
        special = stem if stem in ("instruction", "manifest") else None
        if stem != "generic" and (special or "code") != layers[0]:
            raise RuleError(f"{at}: a rule of layer {layers[0]} doesn't belong in {stem}")
        values |= {"hint": raw["default_severity_hint"], "languages": _names(raw, "languages", at), "paths_exclude": _names(raw, "paths_exclude", at)}
    return Rule(name, layers[0], condition, raw["precision"], _text(raw, "question", at), version, bool(flags), **values)


def load(paths: list[str], kind: str = "patterns") -> list[Rule]:
    """Rules of some packs, by id. A damaged pack, rule or a repeated id or file name is refused."""
    names = [os.path.basename(p) for p in paths]
    if len(set(names)) < len(names):
        raise RuleError("two packs have one file name")
    rules: dict[str, Rule] = {}
    for path in sorted(paths, key=os.path.basename):
        found = document(path)
        if unknown := set(found) - {"version", kind, "comment"}:
            raise RuleError(f"{path}: unknown keys {sorted(unknown)}")
        if not isinstance(found.get(kind), list) or not found[kind]:
            raise RuleError(f"{path}: {kind} must be a list")
        for k, raw in enumerate(found[kind]):
            rule = _rule(raw, f"{path} [{k}]", kind, found["version"], path)
            if rule.id in rules:
                raise RuleError(f"{path}: {rule.id} stands twice")
            rules[rule.id] = rule
    return [rules[i] for i in sorted(rules)]


def agentic() -> list[Rule]:
    return load([pack_path(n) for n in ("base", "python", "instruction", "manifest")])


def generic() -> list[Rule]:
    return load([pack_path("generic")])


def kinds() -> list[Rule]:
    return load([pack_path("surfaces")], "kinds")


def structural() -> list[Rule]:
    return load([pack_path("structure")], "rules")
