"""Source trees as a table of files: a Python data source lists them, partition by subtree, and a second step reads texts evenly."""

from __future__ import annotations

import os
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.tables import stored

LISTED = "project string, path string, length long, is_dir boolean, inside boolean"
FILES = f"{LISTED}, text string"
#: Names of directories that hold other projects' code, and of those no scan enters.
VENDOR = ["vendor", "vendors", "third_party", "third-party", "thirdparty", "3rd_party", "3rd-party", "3rdparty", "external", "externals", "extern", "deps", "node_modules", "bower_components"]
#: Files that tell a repository's root where there is no .git.
ROOT_FILES = ["Cargo.toml", "package.json", "CMakeLists.txt"]
MAX_DEPTH = 50
MAX_BYTES = 1 << 20  # of a source file scanned for imports, and of a companion of a model
HEAD_LINES = 50  # of a C source or header that are read
PARTITIONS = 64  # subtrees that the driver splits a tree into at least, where it has as many directories
BATCH = 4096  # rows of a listing's batch
TASK_FILES, TASK_BYTES = 2000, 64 << 20  # that one task reads, on average
#: Names that are read by whom they concern even outside the vendor mode and below excluded directories: version tables, definitions, C sources, submodules,
#: and what tells vendored libraries. Package files of installed packages are asked for apart.
COMPANIONS = r".*\.(?:mk|epd|c|h|cpp|cxx|cc|hpp|hxx)|\.gitmodules|CMakeLists\.txt|library\.properties"
INSTALLED = r"^(?:(.*)/)?node_modules/((?:@[^/]+/)?[^/]+)/package\.json$"
HEADS = r".*\.[ch]"


def names_read_whole() -> str:
    """A pattern of the names whose text is read whatever its size: those of all parsers, and what else tells versions."""
    from .manifests import PARSERS

    return "|".join(f"(?:{p})" for p in [*PARSERS, r"model\.safetensors\.index\.json", r".*\.epd", r"library\.properties", "GNUmakefile", r"pom\.xml"])


def names_read_small() -> str:
    """A pattern of the names whose text is read up to MAX_BYTES: sources with imports and companions of models."""
    from .manifests import SOURCES
    from .models import COMPANIONS as OF_MODELS
    from .models import READMES

    return "|".join(f"(?:{p})" for p in [*SOURCES, *map(re.escape, [*OF_MODELS, *READMES])])


class TreeReader(DataSourceReader):
    """Lists files and directories, and tells which lie inside the vendor mode and the excludes.

    Directories outside are gone through for COMPANIONS, and with installed for the package.json of installed packages; only such files
    of them are listed. With companions false they are never entered, but for those package files.
    """

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.project = options.get("project", os.path.basename(self.root))
        self.vendor = options.get("vendor", "include")
        self.excludes = set(filter(None, options.get("excludes", "").split(",")))
        self.installed = options.get("installed", "false") == "true"
        self.companions = options.get("companions", "true") == "true"
        self.parts = int(options.get("partitions", PARTITIONS))

    def enters(self, at: str) -> bool:
        """Whether a directory, by its path below the root, is inside if the one above it is."""
        name, top = os.path.basename(at), at.split(os.sep)[0]
        if name in self.excludes or (self.vendor == "skip" and name in VENDOR):
            return False
        return self.vendor != "only" or top in VENDOR

    def lists(self, at: str, name: str) -> bool:
        """Whether a file outside is listed."""
        return (self.companions and re.fullmatch(COMPANIONS, name) is not None) or (self.installed and re.match(INSTALLED, at) is not None)

    def entries(self, at: str) -> list:
        with os.scandir(os.path.join(self.root, at)) as found:
            return sorted(found, key=lambda e: e.name)

    def partitions(self):
        """Subtrees as (path, levels, inside): directories are split, breadth first, into their own files and their subdirectories until there are enough."""
        own, todo = [], [("", True)]
        while todo and len(own) + len(todo) < self.parts:
            at, inside = todo.pop(0)
            own.append((at, inside))
            try:
                below = [os.path.join(at, e.name) for e in self.entries(at) if e.is_dir() and not e.is_symlink()]
            except OSError:
                continue
            below = [(d, inside and self.enters(d)) for d in below if d.count(os.sep) < MAX_DEPTH]
            todo += [d for d in below if d[1] or self.companions]
        return [*(InputPartition((at, 0, inside)) for at, inside in own), *(InputPartition((at, MAX_DEPTH - at.count(os.sep), inside)) for at, inside in todo)]

    def read(self, partition):
        rows = self.walk(partition)
        while some := list(islice(rows, BATCH)):
            kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=["project", "path", "length", "is_dir", "inside"])

    def walk(self, partition):
        """Rows of a subtree, or with no levels of a directory's own entries. Links are followed but no directory twice, and entries that can't be listed are left out."""
        part, depth, within = partition.value
        todo, seen = [(part, depth, within)], set()
        while todo:
            top, left, inside = todo.pop()
            try:
                real = os.path.realpath(os.path.join(self.root, top))
                entries = self.entries(top)
            except OSError:
                continue
            if real in seen:
                continue
            seen.add(real)
            listed = inside and (self.vendor != "only" or top.split(os.sep)[0] in VENDOR)
            for e in entries:
                at = os.path.join(top, e.name)
                try:
                    if not e.is_dir():
                        if listed or self.lists(at, e.name):
                            yield self.project, at, e.stat().st_size, False, listed
                        continue
                    below = inside and self.enters(at)
                    if below:
                        yield self.project, at, 0, True, True
                    elif not self.companions:
                        if self.installed and e.name == "node_modules":
                            yield from self.packages(at)
                        continue
                    if left:
                        todo.append((at, left - 1, below))
                    elif not depth and top == part and e.is_symlink():  # other subdirectories of a split one have partitions of their own
                        todo.append((at, MAX_DEPTH, below))
                except OSError:
                    continue

    def packages(self, at: str):
        """package.json of each package installed in a node_modules directory, scoped ones too."""
        for e in self.entries(at):
            for name in [os.path.join(e.name, s.name) for s in self.entries(os.path.join(at, e.name))] if e.name.startswith("@") else [e.name]:
                found = os.path.join(at, name, "package.json")
                try:
                    yield self.project, found, os.stat(os.path.join(self.root, found)).st_size, False, False
                except OSError:
                    continue


class TreeSource(DataSource):
    """spark.read.format("tree").option("project", name).load(root) lists a folder that all executors see."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, project: str | None = None, vendor: str = "include", excludes: list[str] = (), installed: bool = False, companions: bool = True) -> DataFrame:
    """The files and directories below root, without texts. vendor, excludes, installed and companions: see TreeReader and filter_entries()."""
    spark.dataSource.register(TreeSource)
    parts = max(PARTITIONS // 4, 2 * spark.sparkContext.defaultParallelism)
    options = {"partitions": str(parts), "project": project, "vendor": vendor, "excludes": ",".join(excludes), "installed": str(installed).lower(), "companions": str(companions).lower()}
    return spark.read.format("tree").options(**{k: v for k, v in options.items() if v}).load(root)


def with_texts(listing: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """listing with the text of the files that a parser knows by name: manifests and build files whole, the first HEAD_LINES lines of C sources and headers, sources and companions of models up to max_bytes. All else, and what can't be opened, has null text.

    The listing is dealt anew by path, so that a folder of many files is read by many tasks, each with about TASK_FILES files and
    TASK_BYTES bytes.
    """
    whole, small, heads = (re.compile(p) for p in (names_read_whole(), names_read_small(), HEADS))

    def text_of(path: str, length: int) -> str | None:
        name = os.path.basename(path)
        head = heads.fullmatch(name)
        if not head and not whole.fullmatch(name) and not (length <= max_bytes and small.fullmatch(name)):
            return None
        try:
            with open(os.path.join(root, path), "rb") as f:
                return (b"".join(islice(f, HEAD_LINES)) if head else f.read()).decode("utf-8", "replace")
        except OSError:
            return None

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "length", "is_dir"))
            # One small batch for each run of files, so that few large texts are held at once.
            texts, start, held = [], 0, 0
            for i, (path, length, is_dir) in enumerate(zip(*columns, strict=True)):
                texts.append(None if is_dir else text_of(path, length))
                held += len(texts[-1] or "")
                if held > TASK_BYTES // 4 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])
                    texts, start, held = [], i + 1, 0

    seen = Observation()
    kept = stored(listing.observe(seen, F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))
    sizes = seen.get
    tasks = max((sizes["files"] or 0) // TASK_FILES, (sizes["bytes"] or 0) // TASK_BYTES, listing.sparkSession.sparkContext.defaultParallelism)
    return kept.repartition(int(tasks), "path").mapInArrow(run, FILES)


def read_tree(spark: SparkSession, root: str, project: str | None = None, vendor: str = "include", excludes: list[str] = (), installed: bool = False, companions: bool = True) -> DataFrame:
    """list_tree() with_texts()."""
    return with_texts(list_tree(spark, root, project, vendor, excludes, installed, companions), root)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root '' last."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def repository_roots(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (project, dir) with repo: the nearest directory above that holds .git, else the nearest with a manifest of a root, else the tree's root."""
    git = F.regexp_extract("path", r"^(?:(.*)/)?\.git(?:/|$)", 1)
    marks = files.where(F.col("path").rlike(r"(?:^|/)\.git(?:/|$)")).select("project", git.alias("_above"), F.lit(0).alias("_rank"))
    roots = files.where(name_of(F.col("path")).isin(ROOT_FILES)).select("project", dir_of(F.col("path")).alias("_above"), F.lit(1).alias("_rank"))
    marks = marks.unionByName(roots).distinct()
    up = asked.select("project", "dir").distinct().withColumn("_above", F.explode(ancestors(F.col("dir"))))
    best = up.join(marks, ["project", "_above"]).groupBy("project", "dir").agg(F.min_by("_above", F.struct("_rank", -F.length("_above"))).alias("_repo"))
    return asked.join(best, ["project", "dir"], "left").withColumn("repo", F.coalesce("_repo", F.lit(""))).drop("_repo")


def filter_entries(files: DataFrame, vendor: str = "skip", excludes: list[str] = ()) -> DataFrame:
    """vendor: 'skip' leaves vendor directories out, 'include' keeps them, 'only' keeps what lies in a vendor directory at the top. Directories named in excludes go, with all below them."""
    if vendor not in ("skip", "include", "only"):
        raise ValueError(f"unknown vendor mode: {vendor}")
    return files.where(inside(vendor, excludes))


def inside(vendor: str, excludes: list[str] = ()) -> Column:
    """Whether a row's path lies inside the mode and the excludes."""
    parts = F.split("path", "/")
    among = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    held = ~among(excludes) if excludes else F.lit(True)
    if vendor == "skip":
        return held & ~among(VENDOR)
    return held & F.get(parts, F.lit(0)).isin(VENDOR) if vendor == "only" else held


#: Manifests that a lock file in the same directory replaces.
SIBLINGS = {"pyproject.toml": "poetry.lock", "Pipfile": "Pipfile.lock", "conanfile.txt": "conan.lock", "conanfile.py": "conan.lock"}
MAKEFILES, GENERATORS = ["Makefile", "makefile"], ["configure.ac", "configure.in", "Makefile.am"]


def silenced(files: DataFrame) -> DataFrame:
    """(project, path) of manifests whose lock file lies beside them, and of Makefiles that autotools generate (a configure script's source in the directory or the two above)."""
    named = files.select("project", "path", name_of(F.col("path")).alias("_name"), dir_of(F.col("path")).alias("_dir")).where(F.col("_name").isin([*SIBLINGS, *SIBLINGS.values(), *MAKEFILES, *GENERATORS]))
    lock = F.lit(None).cast("string")
    for manifest, by in SIBLINGS.items():
        lock = F.when(F.col("_name") == manifest, by).otherwise(lock)
    locks = named.where(F.col("_name").isin(list(set(SIBLINGS.values())))).select("project", "_dir", F.col("_name").alias("_lock"))
    replaced = named.withColumn("_lock", lock).join(locks, ["project", "_dir", "_lock"], "left_semi").select("project", "path")
    made = named.where(F.col("_name").isin(GENERATORS)).select("project", F.col("_dir").alias("_above"))
    up = lambda c: F.when(c.contains("/"), dir_of(c)).when(c != "", F.lit(""))
    parent = up(F.col("_dir"))
    makefiles = named.where(F.col("_name").isin(MAKEFILES)).select("project", "path", F.explode(F.array("_dir", parent, up(parent))).alias("_above"))
    return replaced.unionByName(makefiles.join(made, ["project", "_above"], "left_semi").select("project", "path").distinct())


def suppress_siblings(files: DataFrame) -> DataFrame:
    """files without those that are silenced()."""
    return files.join(silenced(files), ["project", "path"], "left_anti")
