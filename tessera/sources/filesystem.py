"""A tree of files as a Spark data source: hostile entries become rows, never failures."""

from __future__ import annotations

import hashlib
import os
import stat
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are not walked, the size bound, bytes looked at for binary content.
EXCLUDED = (".git", "node_modules", ".venv", ".venv-audit", "venv", "__pycache__", "dist", "build", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".nox", ".eggs")
MAX_BYTES, SNIFF = 5 * 1024 * 1024, 8192
_PLAIN = bytes([9, 10, 11, 12, 13, 27, 28, 29, 30]) + bytes(range(32, 256))
SCHEMA = "path string, size long, is_binary boolean, is_symlink boolean, symlink_target string, escapes_root boolean, sha256 string, is_readable boolean, is_regular boolean, is_within_size_bound boolean, content string"


class Refused(ValueError):
    """The tree can't be told apart or isn't one."""


def listing(root: str, excluded: tuple = EXCLUDED) -> list[tuple[str, str]]:
    """(path in the table, path in the tree) by code point, without excluded folders; links are not followed."""
    if not os.path.isdir(root):
        raise Refused(f"{root} is not a folder")
    found: dict[str, str] = {}
    for folder, folders, names in os.walk(root, followlinks=False):
        links = [d for d in folders if os.path.islink(os.path.join(folder, d)) and d not in excluded]
        folders[:] = [d for d in folders if d not in excluded and d not in links]
        for name in [*names, *links]:
            raw = os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")
            path = unicodedata.normalize("NFC", raw)
            if path in found:
                raise Refused(f"two entries are named {path} after normalisation")
            found[path] = raw
    return sorted(found.items())


def present(root: str, excluded: tuple = EXCLUDED) -> list[str]:
    """Which excluded folders the tree has, outside each other."""
    seen = set()
    for _, folders, _ in os.walk(root, followlinks=False):
        seen |= set(folders) & set(excluded)
        folders[:] = [d for d in folders if d not in excluded]
    return sorted(seen)


def entry(root: str, path: str, raw: str, most: int = MAX_BYTES) -> tuple:
    """One row. What a file is comes before any read: a pipe is never opened, a large file never loaded."""
    full = os.path.join(root, raw)
    row = {"path": path, "size": 0, "is_binary": False, "is_symlink": False, "symlink_target": None, "escapes_root": False, "sha256": None, "is_readable": True, "is_regular": True, "is_within_size_bound": True, "content": None}
    try:
        info = os.lstat(full)
    except OSError:
        row |= {"is_readable": False}
        return tuple(row.values())
    row["size"] = info.st_size
    if stat.S_ISLNK(info.st_mode):
        row |= {"is_symlink": True, "symlink_target": os.readlink(full), "escapes_root": _escapes(root, full)}
    elif not stat.S_ISREG(info.st_mode):
        row |= {"is_regular": False}
    elif info.st_size > most:
        row |= {"is_within_size_bound": False}
    else:
        try:
            with open(full, "rb") as f:
                data = f.read(most + 1)
        except OSError:
            row |= {"is_readable": False}
            return tuple(row.values())
        head = data[:SNIFF]
        odd = len(head.translate(None, _PLAIN))
        binary = odd > 0.05 * len(head) if head else False
        if binary:
            row |= {"is_binary": True, "sha256": hashlib.sha256(data).hexdigest()}
        else:
            text = data.decode("utf-8", "replace")
            normal = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
            row |= {"content": text, "sha256": hashlib.sha256(normal.encode()).hexdigest()}
    return tuple(row.values())


def _escapes(root: str, link: str) -> bool:
    try:
        home, to = os.path.realpath(root, strict=True), os.path.realpath(link, strict=True)
        return os.path.commonpath([home, to]) != home
    except (OSError, ValueError):
        return True


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        given = options.get("exclude")
        self.excluded = EXCLUDED if given is None else tuple(x for x in given.split(",") if x)
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.per_task = int(options.get("filespertask", 256))
        if self.most < 1:
            raise Refused("maxBytes must be positive")

    def partitions(self) -> list[InputPartition]:
        """Parts of neighbouring files of some 64 MB, or filesPerTask files."""
        parts: list[list] = [[]]
        size = 0
        for path, raw in listing(self.root, self.excluded):
            try:
                own = min(self.most, os.lstat(os.path.join(self.root, raw)).st_size)
            except OSError:
                own = 0
            if parts[-1] and (len(parts[-1]) >= self.per_task or size + own > 64_000_000):
                parts.append([])
                size = 0
            parts[-1].append((path, raw))
            size += own
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, raw in partition.files:
            yield entry(self.root, path, raw, self.most)


class Tree(DataSource):
    """format("tree"): options path, exclude (comma-separated; replaces the default, empty for none), maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def walk(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The inventory of a tree that every executor can reach, with the text of what is readable."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").options(path=root, **options).load()
