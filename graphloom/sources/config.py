"""The project's configuration: a lossy reading of a small subset of TOML.

    [include]
    paths = ["src/"]
    [exclude]
    paths = ["src/generated/"]
    [ignore]
    extra = ["vendor"]

What cannot be read is as if it were not there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

CONFIG_NAME = ".graphloom.toml"
#: Names of files and folders that are never entered.
IGNORED = frozenset(
    """.git .hg .svn node_modules target dist build out coverage vendor vendors third_party .cache .gradle .idea
    .pytest_cache .mypy_cache .ruff_cache .tox .cargo Pods DerivedData .next .venv venv __pycache__ .graphloom""".split()
)


@dataclass
class Config:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)

    def includes_path(self, path: str) -> bool:
        return not self.include or any(path.startswith(p) for p in self.include)

    def excludes_path(self, path: str) -> bool:
        return any(path.startswith(p) for p in self.exclude)

    def ignores_name(self, name: str) -> bool:
        return name in self.ignore


def parse_lossy(text: str) -> Config:
    config, section, pending = Config(), "", None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if pending is not None:
            line, pending = pending + " " + line, None
        if m := re.fullmatch(r"\[([^\]]*)\]", line):
            section = m[1].strip()
            continue
        key, eq, value = line.partition("=")
        if not eq:
            continue
        value = value.strip()
        if value.startswith("[") and "]" not in value:
            pending = line
            continue
        items = [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", value)]
        key = key.strip()
        clean = [p.replace("\\", "/").removeprefix("./") for p in items]
        if (section, key) == ("include", "paths"):
            config.include = [p for p in clean if p]
        elif (section, key) == ("exclude", "paths"):
            config.exclude = [p for p in clean if p]
        elif (section, key) == ("ignore", "extra"):
            config.ignore = [p for p in items if p]
    return config


def load_config(root: str) -> Config:
    try:
        return parse_lossy((Path(root) / CONFIG_NAME).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError):
        return Config()
