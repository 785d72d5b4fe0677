"""Source trees as DataFrames: path, language, sha256, content."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.config import IGNORED, Config
from graphloom.sources.languages import BY_EXTENSION, label

SCANNED = "path string, language string, sha256 string, content string"


def list_files(root: str, config: Config) -> tuple[list[str], list[dict]]:
    """Root-relative paths of source files, by a walk that never enters ignored folders."""
    top, paths, warnings = Path(root), [], []
    for folder, names, files in os.walk(top, onerror=lambda e: warnings.append({"path": str(e.filename), "message": f"walk failed: {e}"})):
        names[:] = sorted(n for n in names if n not in IGNORED and not config.ignores_name(n))
        for f in sorted(files):
            path = os.path.relpath(os.path.join(folder, f), top).replace("\\", "/")
            extension = f.rsplit(".", 1)[-1] if "." in f[1:] else ""
            if f not in IGNORED and not config.ignores_name(f) and extension in BY_EXTENSION and config.includes_path(path) and not config.excludes_path(path):
                paths.append(path)
    return paths, warnings


def scan_tree(spark: SparkSession, root: str, config: Config) -> tuple[DataFrame, list[dict]]:
    """Files of a tree with content and hash; those that are not UTF-8 are left out with a warning."""
    paths, warnings = list_files(root, config)
    if not paths:
        return spark.createDataFrame([], SCANNED), warnings
    base = str(Path(root).resolve())
    # only the wanted files are listed and opened; a path is taken as it is, not as a pattern
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", "false").load([f"{base}/{p}" for p in paths])
    plain = F.regexp_replace("path", "^file:/+", "/")
    read = read.select(F.substring(plain, len(base) + 2, 1 << 20).alias("path"), F.col("content").alias("raw"))
    kept = scan_frame(read)
    bad = kept.filter("content is null").select("path").collect()
    warnings += [{"path": r.path, "message": "not valid UTF-8"} for r in bad]
    return kept.filter("content is not null"), warnings


def scan_frame(raw: DataFrame) -> DataFrame:
    """`raw`: path, raw (binary), from any source that Spark reads.  Content is null where it is not UTF-8."""
    languages = F.create_map(*[F.lit(x) for e, v in BY_EXTENSION.items() for x in (e, label(v))])
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return raw.select("path", languages[extension].alias("language"), F.sha2("raw", 256).alias("sha256"), F.try_validate_utf8(F.col("raw").cast("string")).alias("content")).filter("language is not null")
