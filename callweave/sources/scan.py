"""Workspace scan: paths on the driver, contents on the executors."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from callweave.functions.columns import LANGUAGES, LIBRARY_DIRS, NEVER_SCANNED

#: Directory of the index within a workspace.
INDEX_DIR = ".callweave"
#: Bytes of source that a task reads, about.
TASK_BYTES = 32 << 20


def skips(name: str, include_library: bool) -> bool:
    if name in (*NEVER_SCANNED, INDEX_DIR):
        return True
    if include_library:
        return name.startswith(".") and name != ".venv"
    return name in LIBRARY_DIRS or name.startswith(".")


def language_for(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower().lstrip("."))


def is_test_path(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    return path.endswith("_test.go") or "tests" in parts or ("src", "test") in zip(parts, parts[1:], strict=False)


def list_files(workspace: str, include_library: bool = False) -> list[tuple[str, str, int, int]]:
    """(path, language, size, mtime) of the supported files, hidden ones too; links are followed, each folder once."""
    out, seen = [], set()
    for folder, dirs, names in os.walk(workspace, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            dirs.clear()
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if not skips(d, include_library))
        for name in sorted(names):
            full = os.path.join(folder, name)
            if (language := language_for(name)) and os.path.isfile(full):
                stat = os.stat(full)
                out.append((os.path.relpath(full, workspace).replace(os.sep, "/"), language, stat.st_size, int(stat.st_mtime)))
    return out


def scan(spark: SparkSession, workspace: str, include_library: bool = False, only: DataFrame | None = None) -> DataFrame:
    """file_path, language, size_bytes, last_modified, is_test, content, content_hash.

    Content and hash of files that can't be read as UTF-8 are null: they are there, and nothing else is known of them.
    Paths are dealt out by bytes, so that a few large files don't meet in a task. The folder must be visible to all
    executors. ``only``: the files (file_path) that are read.
    """
    found = sorted(list_files(workspace, include_library), key=lambda f: -f[2])
    parts = max(1, min(len(found), -(-sum(f[2] for f in found) // TASK_BYTES), 10_000), min(len(found), spark.sparkContext.defaultParallelism))
    rows = [(*f, is_test_path(f[0]), k % parts) for k, f in enumerate(found)]
    paths = spark.createDataFrame(rows, "file_path string, language string, size_bytes long, last_modified long, is_test boolean, part int")
    schema = "file_path string, language string, size_bytes long, last_modified long, is_test boolean, content string, content_hash string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64].drop(columns="part")
                texts = []
                for p in part["file_path"]:
                    try:
                        texts.append(Path(workspace, p).read_bytes().decode("utf-8"))
                    except (OSError, UnicodeDecodeError):
                        texts.append(None)
                yield part.assign(content=texts, content_hash=[None if t is None else hashlib.md5(t.encode()).hexdigest() for t in texts])

    if only is not None:
        paths = paths.join(only.select("file_path"), "file_path", "left_semi").select(*paths.columns)
    return paths.repartition(parts, "part").mapInPandas(read, schema)


def git(workspace: str, *args: str) -> str | None:
    try:
        out = subprocess.run(["git", "-C", workspace, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() if out.returncode == 0 else None


def is_shallow(workspace: str) -> bool:
    """Whether the head commit is known without a parent."""
    found = git(workspace, "rev-list", "--parents", "-n", "1", "HEAD")
    return found is not None and len(found.split()) == 1


def git_facts(workspace: str) -> dict[str, str | None]:
    """Commit, subject and date of the head, branch, and whether the tree is clean."""
    last = git(workspace, "log", "-1", "--format=%H%x00%s%x00%cI")
    sha, subject, date = last.split("\0") if last and last.count("\0") == 2 else (None, None, None)
    dirty = git(workspace, "status", "--porcelain")
    return {
        "git_commit_sha": sha, "git_commit_subject": subject, "git_commit_date": date, "git_branch": git(workspace, "rev-parse", "--abbrev-ref", "HEAD"),
        "git_status": None if dirty is None else "dirty" if dirty else "clean",
    }
