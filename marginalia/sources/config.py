"""Configuration from TOML. A missing or broken file gives the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.lint import ALIASES, Config
from marginalia.sources.files import MAX_CONFIG, MAX_INCLUDE, MAX_JSON, MAX_SOURCE

#: Fixed: sections whose keys count as root keys, the first winning over the second.
SECTIONS = ("marginalia", "book")


#: Fixed: other names of keys.
OTHER_NAMES = {"output_dir": ("output_dir", "output"), "language": ("language", "lang"), "inputs": ("inputs", "input")}
#: Fixed: what is set where the file says nothing. Limits are in bytes.
WATCH = {"debounce_ms": 100, "ignore_patterns": [".git/**", ".git", "node_modules/**", "build/**", "zig-out/**", "zig-cache/**", ".zig-cache/**", "*.o", "*.obj", "*.a", "*.so", "*.dylib"]}
LIMITS = {"max_file_size": MAX_SOURCE, "max_include_size": MAX_INCLUDE, "max_json_size": MAX_JSON, "max_config_size": MAX_CONFIG}


@dataclass
class Settings:
    grouping: str = "by_header"
    format: str = "mdbook"
    title: str = "API Reference"
    output_dir: str = "docs"
    language: str = "en"
    authors: list[str] = field(default_factory=list)
    external_docs: list[tuple[str, str]] = field(default_factory=lambda: [("std::", "https://en.cppreference.com/w/cpp/$$")])
    blacklist_namespace: list[str] = field(default_factory=lambda: ["detail", "internal", "impl"])
    blacklist_pattern: list[str] = field(default_factory=list)
    extract_private: bool = False
    extract_protected: bool = True
    min_coverage: int = 80
    modules: list[tuple[str, list[str]]] = field(default_factory=list)
    test_patterns: list[str] = field(default_factory=lambda: ["test/**/*.cpp", "tests/**/*.cpp"])
    lint: Config = field(default_factory=Config)
    max_depth: int = 5
    inputs: list[str] = field(default_factory=list)
    generate_intro: bool = True
    watch: dict = field(default_factory=lambda: dict(WATCH))
    limits: dict = field(default_factory=lambda: dict(LIMITS))

    def modules_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, name, g) for n, (name, globs) in enumerate(self.modules) for g in globs]
        return spark.createDataFrame(rows, "ord int, module string, glob string")

    def rules_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.lint.severities.items()), "code string, severity string")


def load_string(text: str) -> Settings:
    out = Settings()
    try:
        tree = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return out
    simple = ("grouping", "format", "title", "output_dir", "language", "authors", "blacklist_namespace", "blacklist_pattern", "extract_private", "extract_protected", "min_coverage", "inputs", "generate_intro")
    layers = [tree, *(tree.get(s, {}) for s in SECTIONS)]
    for key in simple:
        default = getattr(out, key)
        for layer, name in ((x, n) for x in layers for n in OTHER_NAMES.get(key, (key,))):
            value = layer.get(name) if isinstance(layer, dict) else None
            if isinstance(value, type(default)):
                setattr(out, key, value)
                break
    for section, known in (("watch", out.watch), ("limits", out.limits)):
        given = tree.get(section, {})
        if isinstance(given, dict):
            known |= {k: v for k, v in given.items() if k in known and type(v) is type(known[k])}
    for m in tree.get("modules", []):
        if isinstance(m, dict) and isinstance(m.get("name"), str):
            globs = m.get("patterns", m.get("headers", m.get("files", [])))
            out.modules.append((m["name"], [g for g in globs if isinstance(g, str)]))
    rules = tree.get("lint", {})
    if isinstance(rules, dict):
        for key in ("max_brief_length", "require_brief", "require_param_docs", "require_return_docs", "require_tparam_docs", "check_cross_references", "require_brief_period"):
            if isinstance(rules.get(key), type(getattr(out.lint, key))):
                setattr(out.lint, key, rules[key])
        for key in ("exclude", "exclude_patterns"):
            if isinstance(rules.get(key), list):
                out.lint.exclude = [x for x in rules[key] if isinstance(x, str)]
        given = rules.get("rules", {})
        if isinstance(given, dict):
            out.lint.severities = {k: ALIASES.get(v, v) for k, v in given.items() if isinstance(v, str)}
    return out


def load_file(path: str) -> Settings:
    p = Path(path)
    try:
        return load_string(p.read_text("utf-8")) if p.stat().st_size <= MAX_CONFIG else Settings()
    except (OSError, UnicodeDecodeError):
        return Settings()
