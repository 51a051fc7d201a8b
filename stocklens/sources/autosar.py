"""AUTOSAR projects: detection, versions from module definitions and from source headers, and the promotion of linked modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import HEAD_LINES, dir_of, name_of

#: Directories that only such projects have, and the variables that their build files set.
DIRECTORIES = ["BSW", "MCAL", "RTE", "AUTOSAR", "SWC"]
VARIABLES = r"\b(?:AUTOSAR_VERSION|AR_VERSION)\b"
BUILD_FILES = ["CMakeLists.txt", "Makefile", "GNUmakefile"]


def in_tree(is_dir: Column) -> Column:
    """Whether a row's path tells an AUTOSAR project: an .arxml file, or a directory by one of the names."""
    parts = F.split("path", "/")
    folders = F.when(is_dir, parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.col("path").endswith(".arxml") | F.arrays_overlap(folders, F.array(*map(F.lit, DIRECTORIES)))


def in_build_file() -> Column:
    """Whether a row is a build file of the root or one level below whose text sets one of the variables."""
    parts = F.split("path", "/")
    return name_of(F.col("path")).isin(BUILD_FILES) & (F.size(parts) <= 2) & F.coalesce(F.col("text").rlike(VARIABLES), F.lit(False))


def projects(files: DataFrame) -> DataFrame:
    """project of each AUTOSAR project: by its tree, or by a variable in a build file."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    return files.where(in_tree(is_dir)).select("project").unionByName(files.where(in_build_file()).select("project")).distinct()


def definition_versions(files: DataFrame) -> DataFrame:
    """(project, name, version): the first revision label after the short name of each module in .epd files; the first file by path wins."""
    modules = F.regexp_extract_all("text", F.lit(r"(?is)<ECUC-MODULE-DEF\b[^>]*>(.*?)</ECUC-MODULE-DEF>"), F.lit(1))
    found = files.where(F.col("path").endswith(".epd") & F.col("text").isNotNull()).select("project", "path", F.posexplode(modules).alias("at", "m"))
    name = F.regexp_extract("m", r"(?is)\A(?:\s|<!--.*?-->)*<SHORT-NAME[^>]*>\s*([^<]+?)\s*</", 1)
    version = F.regexp_extract("m", r"(?is)<REVISION-LABEL[^>]*>\s*([^<]+?)\s*</", 1)
    rows = found.select("project", name.alias("name"), version.alias("version"), F.struct("path", "at").alias("place")).where("name <> '' and version <> ''")
    return rows.groupBy("project", "name").agg(F.min_by("version", "place").alias("version"))


LABEL = "SW Version"


def header_versions(files: DataFrame) -> DataFrame:
    """(project, name, version): what the label says in the comment block among the first lines of .c and .h files, by the name of their directory; the first file by path wins."""
    bare = lambda line: F.btrim(line, F.lit(" \t"))
    label = lambda line: bare(F.substring_index(line, ":", 1))
    told = lambda line: label(line).rlike(r"^\*\s") & (bare(F.substring(label(line), 2, len(LABEL) + 40)) == LABEL) & line.contains(":")
    lines = F.filter(F.slice(F.split("text", "\n"), 1, HEAD_LINES), told)
    version = F.regexp_extract(F.get(lines, F.lit(0)), r":\s*(\S+)", 1)
    sources = files.where(F.col("path").rlike(r"\.[ch]$") & F.col("text").contains(LABEL))
    rows = sources.select("project", name_of(dir_of(F.col("path"))).alias("name"), version.alias("version"), "path").where("version <> '' and name <> ''")
    return rows.groupBy("project", "name").agg(F.min_by("version", "path").alias("version"))


def with_versions(components: DataFrame, files: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Versions of autosar rows, and in AUTOSAR projects (own, else those of files) system rows that a definition or a header knows become autosar rows of its version."""
    known = definition_versions(files).withColumnRenamed("version", "_epd").join(header_versions(files).withColumnRenamed("version", "_head"), ["project", "name"], "full")
    own = (projects(files) if own is None else own).withColumn("_own", F.lit(True))
    joined = components.join(known, ["project", "name"], "left").join(own, "project", "left")
    found = F.coalesce("_epd", "_head")
    promoted = (F.col("ecosystem") == "system") & F.coalesce("_own", F.lit(False)) & found.isNotNull()
    open_row = (F.col("ecosystem") == "autosar") & (F.col("version") == "unspecified")
    version = F.when(promoted | open_row, F.coalesce(found, "version")).otherwise(F.col("version"))
    return joined.withColumns({"version": version, "ecosystem": F.when(promoted, "autosar").otherwise(F.col("ecosystem"))}).select(components.columns)
