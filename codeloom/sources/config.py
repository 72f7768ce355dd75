"""Path aliases of tsconfig files: JSON with comments, and what they extend."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

MAX_EXTENDS = 5


def parse_jsonc(text: str) -> dict:
    """JSON with comments and commas before closing brackets; ValueError if it still isn't JSON."""
    strings_or_comments = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = strings_or_comments.sub(lambda m: m[0] if m[0][0] == '"' else " ", text.lstrip("﻿"))
    out = json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))
    if not isinstance(out, dict):
        raise ValueError("no object")
    return out


def load_aliases(spark: SparkSession, root: str, name: str = "tsconfig.json") -> dict | None:
    """``base_url, paths`` (pattern: targets, in order) of a project; the child's options win over what it extends. None if there are none."""

    def read(path: str) -> dict | None:
        rows = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
        try:
            found = rows.load(path).select("content").collect()
        except Exception:  # noqa: BLE001  no such file
            return None
        try:
            return parse_jsonc(bytes(found[0][0]).decode("utf-8")) if found else None
        except ValueError:
            return None

    options: dict = {}
    path: str | None = f"{root.rstrip('/')}/{name}"
    for _ in range(MAX_EXTENDS + 1):
        config = read(path) if path else None
        if config is None:
            break
        options = {**config.get("compilerOptions", {}), **options}
        parent = config.get("extends")
        path = None
        if isinstance(parent, str) and parent.startswith("."):
            folder = root.rstrip("/")
            path = f"{folder}/{parent}" + ("" if parent.endswith(".json") else ".json")
    if "paths" not in options:
        return None
    return {"base_url": options.get("baseUrl", "."), "paths": [(k, list(v)) for k, v in options["paths"].items()]}
