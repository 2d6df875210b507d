"""Versioned outputs: sealed folders, an atomic pointer, a lock, and content hashes of tables."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.files import file_digest

MANIFEST, POINTER = "manifest.json", "current.json"


class ReleaseError(RuntimeError):
    """A release that is incomplete, changed or outside its folder."""


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order or on partitions: sums of row hashes."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)], *[F.col(c).isNull() for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"), F.sum(F.abs(row.bitwiseXOR(F.lit(0x5DEECE66D))).cast("decimal(20,0)")).alias("t")).first()
    return f"{r['n']}:{r['s'] or 0}:{r['t'] or 0}"


def _write(path: Path, value: dict) -> None:
    """Replace a file at once: readers see the old or the new one."""
    fd, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as file:
        json.dump(value, file, sort_keys=True)
        file.flush()
        os.fsync(file.fileno())
    os.replace(temporary, path)


def seal(folder: Path, required: list[str]) -> dict:
    """Write the manifest of a folder: the hash of every file; a missing required output is an error."""
    missing = [r for r in required if not (folder / r).exists()]
    if missing:
        raise ReleaseError(f"missing outputs: {', '.join(missing)}")
    files = {str(p.relative_to(folder)): file_digest(str(p)) for p in sorted(folder.rglob("*")) if p.is_file() and p.name != MANIFEST}
    _write(folder / MANIFEST, {"files": files})
    return files


def problem(folder: Path) -> str | None:
    """What is wrong with a sealed folder; None if nothing is."""
    if not (folder / MANIFEST).exists():
        return "not sealed"
    files = json.loads((folder / MANIFEST).read_text())["files"]
    for name, digest in files.items():
        if not (folder / name).is_file():
            return f"{name} is gone"
        if file_digest(str(folder / name)) != digest:
            return f"{name} has changed"
    return None


def activate(root: Path, name: str) -> None:
    """Point to a sound release of ``root``."""
    if reason := problem(root / name):
        raise ReleaseError(reason)
    _write(root / POINTER, {"release": name, "manifest": file_digest(str(root / name / MANIFEST))})


def current(root: Path) -> Path:
    """The release that is pointed to; an error if it lies outside ``root`` or its manifest was replaced."""
    said = json.loads((root / POINTER).read_text())
    folder = (root / said["release"]).resolve()
    if root.resolve() not in folder.parents:
        raise ReleaseError("the pointer leaves its folder")
    if file_digest(str(folder / MANIFEST)) != said["manifest"]:
        raise ReleaseError("the manifest has changed")
    return folder


@contextlib.contextmanager
def locked(path: Path) -> Iterator[None]:
    """Hold a file alone; an error if another process holds it."""
    with open(path, "w") as file:
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise ReleaseError("another build is running") from e
        try:
            yield
        finally:
            fcntl.flock(file, fcntl.LOCK_UN)
