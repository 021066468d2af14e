"""Registry of the commands and tools a user can call, with their parameters and defaults."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: Mapping[str, Any] = field(default_factory=dict)  # name: default
    run: Callable[..., Any] | None = None


class Registry:
    """Named tools; calling one checks its parameters and fills in defaults."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"tool {tool.name} is registered already")
        self.tools[tool.name] = tool

    def call(self, name: str, arguments: Mapping[str, Any] | str | None = None) -> Any:
        if name not in self.tools:
            raise KeyError(f"no tool {name}")
        tool = self.tools[name]
        given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
        unknown = set(given) - set(tool.parameters)
        if unknown:
            raise TypeError(f"{name} has no parameter {sorted(unknown)}")
        if tool.run is None:
            raise NotImplementedError(name)
        return tool.run(**{**tool.parameters, **given})

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.description, json.dumps(t.parameters, sort_keys=True)) for t in sorted(self.tools.values(), key=lambda t: t.name)]
        return spark.createDataFrame(rows, "name string, description string, parameters string")

    def tree(self, depth: int = 9, ignore: frozenset[str] = frozenset()) -> dict:
        """Nested names and descriptions; names are split at spaces."""
        root: dict = {}
        for t in self.tools.values():
            parts = t.name.split(" ")
            if ignore & set(parts):
                continue
            at = root
            for p in parts[:depth]:
                at = at.setdefault(p, {})
            if len(parts) <= depth:
                at["description"] = t.description
        return root


# Names, descriptions and defaults of the commands.
COMMANDS = (
    ("navigate", "Show a captured page", {"url": None}),
    ("snapshot", "Show a captured page with its text", {"url": None}),
    ("extract", "Extract a page's content in a format", {"url": None, "format": "markdown"}),
    ("batch", "Extract a list of URLs", {"urls": None, "format": "markdown"}),
    ("crawl", "Crawl captured pages breadth-first", {"url": None, "max_depth": 2, "max_pages": 100, "same_origin": True, "format": "markdown"}),
    ("import", "Import pages into a group", {"path": None, "group": None}),
    ("export", "Export a group or all", {"group": None, "path": None}),
    ("db list", "List groups", {}),
    ("db status", "Counts of a group", {"group": None}),
    ("db query", "Full-text search", {"query": None, "group": None, "limit": 10}),
    ("db vector", "Vector search", {"query": None, "group": None, "limit": 10}),
    ("db hybrid", "Full-text candidates ranked by vectors", {"query": None, "group": None, "limit": 10, "bm25_limit": 50}),
    ("db reset", "Delete a group", {"group": None}),
    ("db reset-all", "Delete everything", {}),
)


def default_registry(runs: Mapping[str, Callable[..., Any]] | None = None) -> Registry:
    r = Registry()
    for name, description, parameters in COMMANDS:
        r.register(Tool(name, description, parameters, (runs or {}).get(name)))
    return r
