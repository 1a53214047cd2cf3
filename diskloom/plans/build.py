"""A build: sources in order, failures kept apart, rules told by a fingerprint, snapshots published and installed."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import tarfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from diskloom.plans.catalogue import layout_problem, set_current
from diskloom.sources.filesystem import Store


@dataclass(frozen=True)
class Source:
    """A source of records: ``collect(spark, inputs)`` gives a DataFrame of them. Lower priority is trusted more; sources that register series run first."""

    id: str
    collect: Callable[[SparkSession, dict[str, str]], DataFrame]
    priority: int = 90
    by_default: bool = True
    registers_series: bool = False


def select_sources(known: Iterable[Source], only: Iterable[str] = (), skip: Iterable[str] = (), extra: Iterable[str] = ()) -> list[Source]:
    """The sources of a build in the order they run: those named by ``only``, else the default ones with ``extra`` and without ``skip``.

    An unknown name is an error.
    """
    known = list(known)
    only, skip, extra = set(only), set(skip), set(extra)
    if missing := (only | skip | extra) - {s.id for s in known}:
        raise ValueError(f"unknown sources: {', '.join(sorted(missing))}")
    chosen = [s for s in known if (s.id in only if only else (s.by_default or s.id in extra)) and s.id not in skip]
    return sorted(chosen, key=lambda s: not s.registers_series)


def collect_all(spark: SparkSession, sources: Iterable[Source], inputs: dict[str, str]) -> tuple[list[tuple[Source, DataFrame]], dict[str, str]]:
    """The records of each source by priority, and why any source gave none; one that fails leaves the others alone.

    A source is read to its end here (its rows are checkpointed), so that an error shows up where it can be kept apart.
    """
    from diskloom.session import cut

    done, failed = [], {}
    for order, source in enumerate(sources):
        try:
            done.append((source.priority, order, source, cut(source.collect(spark, inputs))))
        except Exception as e:  # a source may fail in any way
            failed[source.id] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return [(s, df) for _, _, s, df in sorted(done, key=lambda x: x[:2])], failed


def fingerprint(paths: Iterable[str]) -> str:
    """One hash of the contents of rule files, by name; a missing file counts as such. A change calls for a new check of what the rules decided."""
    h = hashlib.sha1()
    for path in sorted(paths):
        h.update(os.path.basename(path).encode() + b"\0")
        if os.path.exists(path):
            with open(path, "rb") as f:
                h.update(hashlib.sha1(f.read()).digest())
    return h.hexdigest()


def publish(snapshot: str, target: str) -> str:
    """A snapshot as one compressed file with its SHA-256 beside it; returns the hash. The same snapshot gives the same bytes."""
    def plain(info: tarfile.TarInfo) -> tarfile.TarInfo:
        info.mtime = info.uid = info.gid = 0
        info.uname = info.gname = ""
        return info

    part = f"{target}.part"
    with open(part, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w") as tar:
        for root, folders, files in os.walk(snapshot):
            folders.sort()
            for name in sorted(files):
                tar.add(os.path.join(root, name), os.path.relpath(os.path.join(root, name), snapshot), filter=plain)
    digest = _sha256(part)
    with open(f"{target}.sha256", "w") as f:
        f.write(f"{digest}  {os.path.basename(target)}\n")
    os.replace(part, target)
    return digest


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def install(package: str, folder: str, most_bytes: int = 4 << 30) -> str:
    """Unpack a published snapshot as the current version of a folder of versions; returns its path.

    The hash beside the file must fit, the unpacked size must stay below ``most_bytes``, and the layout must be one this
    reader knows; otherwise nothing changes.
    """
    digest = _sha256(package)
    with open(f"{package}.sha256") as f:
        if f.read().split()[0] != digest:
            raise ValueError("the package does not have its published hash")
    path = os.path.join(folder, f"version-{digest[:16]}")
    part = f"{path}.part"
    shutil.rmtree(part, ignore_errors=True)
    with tarfile.open(package) as tar:
        if sum(m.size for m in tar.getmembers()) > most_bytes:
            raise ValueError("the snapshot is larger than is installed")
        tar.extractall(part, filter="data")
    if problem := layout_problem(part):
        shutil.rmtree(part)
        raise ValueError(f"the snapshot cannot be installed: {problem}")
    shutil.rmtree(path, ignore_errors=True)
    os.rename(part, path)
    set_current(Store(folder), folder, path)
    return path


def newer(candidates: Iterable[dict], built_at: str) -> dict | None:
    """The candidate that was built last, if it was built after ``built_at``; dates compare as texts."""
    best = max(candidates, key=lambda c: c.get("built_at", ""), default=None)
    return best if best and best.get("built_at", "") > built_at else None


def migrate(row: dict, steps: list[Callable[[dict], dict]]) -> dict:
    """A stored description brought to the present layout by the steps that it has not had; a newer one is refused."""
    version = int(row.get("version", 0))
    if version > len(steps):
        raise ValueError(f"version {version} is newer than this reader's {len(steps)}")
    for step in steps[version:]:
        row = step(json.loads(json.dumps(row)))
    return row | {"version": len(steps)}
