"""Watching a tree: each batch of changed files triggers an incremental index run.

A streaming file source reports new and changed files; since it says nothing of
deleted ones, each batch lists and compares the whole tree, as an incremental run
does anyway.  Without streaming, `poll` compares fingerprints of the tree.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.index import Index, IndexReport
from graphloom.sources.config import load_config
from graphloom.sources.scan import list_files


def fingerprint(root: str) -> str:
    """SHA-256 over the sorted source files' paths and contents."""
    digest = hashlib.sha256()
    for path in sorted(list_files(root, load_config(root))[0]):
        try:
            data = (Path(root) / path).read_bytes()
        except OSError:
            continue
        digest.update(path.encode() + b"\0" + data + b"\0")
    return digest.hexdigest()


def stream(spark: SparkSession, root: str, index: str, checkpoint: str, once: bool = False, seconds: float = 1.0, on_report: Callable[[IndexReport], None] | None = None) -> StreamingQuery:
    def refresh(_batch, _number: int) -> None:
        report = Index(spark, index).build(root)
        if on_report:
            on_report(report)

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(str(Path(root).resolve())).select("path", "modificationTime")
    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()


def poll(spark: SparkSession, root: str, index: str, once: bool = False, seconds: float = 0.5, debounce: float = 0.25, on_report: Callable[[IndexReport], None] | None = None) -> None:
    seen = None
    while True:
        now = fingerprint(root)
        if now != seen:
            if not once and seen is not None:
                time.sleep(debounce)
                if fingerprint(root) != now:
                    continue
            report = Index(spark, index).build(root)
            if on_report:
                on_report(report)
            seen = now
        if once:
            return
        time.sleep(seconds)
