"""Schemas of the five graph tables (version 3) and of the extractor's output."""

from __future__ import annotations

SCHEMA_VERSION = "3"

FILES = "id long, path string, language string, sha256 string, loc int, indexed_at timestamp"
SYMBOLS = "id long, name string, qualified_name string, kind string, file_id long, start_line int, end_line int, signature string, exported boolean"
REFS = "id long, symbol_name string, from_symbol_id long, file_id long, line int, column int, context string, kind string"
EDGES = "id long, from_symbol_id long, to_symbol_name string, kind string, weight double"
IMPORTS = "id long, file_id long, source string, line int, kind string"
SOURCES = "file_id long, path string, content string"
TABLES = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "edges": EDGES, "imports": IMPORTS, "sources": SOURCES}

#: One row per symbol, reference, import or warning; `ordinal` is the pre-order place in the file.
EXTRACTED = (
    "path string, rec string, ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, "
    "signature string, exported boolean, column int, context string, from_qualified_name string"
)
