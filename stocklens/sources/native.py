"""Facts read from binary files where they lie: versions of shared objects and commits of submodules.

Both take a listing and a root folder that all executors see; the Python is a small reader for one file at a time.
"""

from __future__ import annotations

import os
import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import version_known
from .tree import dir_of, name_of

#: Folders below a repository's root in which shared objects are looked for, and how deep.
LIBRARY_DIRS = ["lib", "lib64", "build", "build/lib", "toolchains/install/lib", "usr/lib", "usr/lib64", "usr/local/lib", ".libs"]
LIBRARY_DEPTH = 5
PRINTED = re.compile(rb"[\x20-\x7e]{4,}")
DOTTED = re.compile(rb"\d+\.\d+\.\d+")


def soname(data: bytes) -> str | None:
    """The name that a shared object's dynamic section gives it; null for anything that isn't a whole ELF file."""
    if data[:4] != b"\x7fELF" or data[4] not in (1, 2):
        return None
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    at, entry, count = (struct.unpack_from(order + f, data, o)[0] for f, o in (("Q", 32), ("H", 54), ("H", 56))) if wide else (struct.unpack_from(order + f, data, o)[0] for f, o in (("I", 28), ("H", 42), ("H", 44)))
    loads, dynamic = [], None
    for i in range(count):
        if wide:
            kind, _, offset, address, _, size = struct.unpack_from(order + "IIQQQQ", data, at + i * entry)
        else:
            kind, offset, address, _, size = struct.unpack_from(order + "IIIII", data, at + i * entry)
        if kind == 1:
            loads.append((address, offset, size))
        elif kind == 2:
            dynamic = (offset, size)
    if dynamic is None:
        return None
    tags = dict(reversed(list(struct.iter_unpack(order + ("qQ" if wide else "iI"), data[dynamic[0] : dynamic[0] + dynamic[1]]))))
    if 14 not in tags or 5 not in tags:
        return None
    for address, offset, size in loads:
        if address <= tags[5] < address + size:
            start = tags[5] - address + offset + tags[14]
            return data[start : data.index(b"\0", start)].decode("utf-8", "replace")
    return None


def numbered(name: str) -> str | None:
    """The version at the end of a shared object's name, after '.so.'."""
    tail = name.rpartition(".so.")[2] if ".so." in name else ""
    return tail if tail and not tail.strip("0123456789.") else None


def so_version(path: str) -> str | None:
    """Version of a shared object: in its name, else in its soname, else the first dotted number that it prints."""
    if found := numbered(os.path.basename(path)):
        return found
    with open(path, "rb") as f:
        data = f.read()
    try:
        found = numbered(soname(data) or "")
    except (struct.error, ValueError, IndexError):
        found = None
    if found:
        return found
    return next((m[0].decode() for part in PRINTED.finditer(data) if (m := DOTTED.search(part[0]))), None)


def shared_objects(files: DataFrame, root: str, repo: Column | None = None) -> DataFrame:
    """(project, repo, name, version) of shared objects in the library folders below each repository's root (repo, a column of files; the root of the tree where it isn't given). Files that are one by their real path count once."""
    top = F.lit("") if repo is None else repo
    inside = F.when(top == "", F.col("path")).otherwise(F.substring("path", F.length(top) + 2, F.lit(1 << 20)))
    listed = files.withColumns({"repo": top, "_in": inside}).where("not is_dir" if "is_dir" in files.columns else "true")
    listed = listed.where(name_of(F.col("path")).rlike(r"\.so$|\.so\."))
    below = "|".join(re.escape(d) for d in LIBRARY_DIRS)
    listed = listed.where(F.col("_in").rlike(rf"^(?:{below})(?:/[^/]+){{1,{LIBRARY_DEPTH}}}$"))

    def run(batches):
        base = os.path.realpath(root)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                real = os.path.realpath(os.path.join(base, r["path"]))
                if not real.startswith(base + os.sep):
                    continue
                try:
                    rows.append(r | {"real": real, "version": so_version(real), "name": os.path.basename(real)})
                except OSError:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("project", "repo", "real", "version", "name")]))

    found = listed.select("project", "repo", "path").mapInArrow(run, "project string, repo string, real string, version string, name string").dropDuplicates(["project", "repo", "real"])
    stem = F.split_part("name", F.lit(".so"), F.lit(1))
    name = F.when(stem.startswith("lib") & (F.length(stem) > 3), F.substring(stem, F.lit(4), F.length(stem)))
    named = found.where(name.isNotNull() & F.col("version").isNotNull()).select("project", "repo", name.alias("name"), "version", "real")
    return named.groupBy("project", "repo", "name").agg(F.min_by("version", "real").alias("version")).where(version_known(F.col("version")))


def git_links(index: bytes) -> dict[str, str]:
    """Paths and commits of the submodules in a git index of version 2 to 4."""
    if index[:4] != b"DIRC":
        return {}
    version, count = struct.unpack_from(">II", index, 4)
    at, last, found = 12, b"", {}
    for _ in range(count):
        mode, sha, flags = struct.unpack_from(">I", index, at + 24)[0], index[at + 40 : at + 60], struct.unpack_from(">H", index, at + 60)[0]
        start = at + 62 + (2 if version > 2 and flags & 0x4000 else 0)
        if version == 4:
            drop = index[start] & 0x7F
            while index[start] & 0x80:
                start += 1
                drop = ((drop + 1) << 7) | (index[start] & 0x7F)
            end = index.index(b"\0", start + 1)
            last = last[: len(last) - drop] + index[start + 1 : end]
            at = end + 1
        else:
            end = index.index(b"\0", start)
            last = index[start:end]
            at += (end - at + 8) // 8 * 8
        if mode >> 12 == 0o16:
            found[last.decode("utf-8", "replace")] = sha.hex()
    return found


def submodule_commits(files: DataFrame, root: str) -> DataFrame:
    """(project, dir, sub_path, commit) for the folders of a listing that hold a .gitmodules file, from the git index beside it; folders without one give no rows."""

    def links(folder: str) -> dict[str, str]:
        git = os.path.join(folder, ".git")
        if os.path.isfile(git):
            with open(git) as f:
                git = os.path.join(folder, f.read().partition("gitdir:")[2].strip())
        with open(os.path.join(git, "index"), "rb") as f:
            return git_links(f.read())

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    rows += [r | {"sub_path": p, "commit": c} for p, c in links(os.path.join(root, r["dir"])).items()]
                except (OSError, ValueError, struct.error, IndexError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("project", "dir", "sub_path", "commit")]))

    asked = files.where(name_of(F.col("path")) == ".gitmodules").select("project", dir_of(F.col("path")).alias("dir")).distinct()
    return asked.mapInArrow(run, "project string, dir string, sub_path string, commit string")
