"""Languages by file extension and by name.  The extension is case-sensitive, the name is not."""

from __future__ import annotations

#: Fixed values.  `.h` is read as C++, which takes C headers too; `tsx` is a variant of TypeScript.
EXTENSIONS = {
    "javascript": "js jsx mjs cjs".split(),
    "typescript": "ts mts cts".split(),
    "tsx": ["tsx"],
    "python": "py pyw".split(),
    "go": ["go"],
    "rust": ["rs"],
    "java": ["java"],
    "c": ["c"],
    "cpp": "cpp cc cxx hpp hh hxx h".split(),
    "csharp": ["cs"],
    "ruby": ["rb"],
    "php": "php phtml".split(),
}
NAMES = {
    "javascript": "javascript js jsx".split(),
    "typescript": "typescript ts".split(),
    "tsx": ["tsx"],
    "python": "python py".split(),
    "go": ["go"],
    "rust": "rust rs".split(),
    "java": ["java"],
    "c": ["c"],
    "cpp": "cpp c++ cxx cc".split(),
    "csharp": "csharp c# cs".split(),
    "ruby": ["ruby", "rb"],
    "php": ["php"],
}
BY_EXTENSION = {e: v for v, es in EXTENSIONS.items() for e in es}
BY_NAME = {n: v for v, ns in NAMES.items() for n in ns}


def variant_of_path(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return BY_EXTENSION.get(name.rsplit(".", 1)[-1]) if "." in name[1:] else None


def variant_of_name(name: str) -> str | None:
    return BY_NAME.get(name.lower())


def label(variant: str) -> str:
    return "typescript" if variant == "tsx" else variant
