"""Deduplication by source priority, suppression chain, link refinement and version resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_priority(components: DataFrame, keys=("name", "version", "ecosystem"), rank: str = "source_rank", order=("source_file", "ordinal")) -> DataFrame:
    """One row per key: the highest rank, then the smallest by order (nulls last)."""
    tie = [F.col(c).asc_nulls_last() for c in order]
    w = Window.partitionBy(*keys).orderBy(F.col(rank).desc(), *tie)
    return components.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_imports(imports: DataFrame) -> DataFrame:
    """Import-scan rows: the first of each (name, ecosystem)."""
    return dedup_priority(imports.withColumn("_r", F.lit(0)), ("name", "ecosystem"), "_r").drop("_r")


def suppress_lower_sources(components: DataFrame, keys=("name", "ecosystem")) -> DataFrame:
    """Rows of the highest source rank of each (name, ecosystem): lock files silence manifests, both silence import scans."""
    w = Window.partitionBy(*keys)
    return components.withColumn("_top", F.max("source_rank").over(w)).where("source_rank = _top").drop("_top")


def suppress_unspecified(components: DataFrame, keys=("name", "ecosystem")) -> DataFrame:
    """Drops 'unspecified' rows of a (name, ecosystem) that has any other version."""
    w = Window.partitionBy(*keys)
    seen = F.bool_or(F.col("version") != "unspecified").over(w)
    return components.withColumn("_seen", seen).where("version <> 'unspecified' or not _seen").drop("_seen")


def suppress_across_ecosystems(components: DataFrame, within=()) -> DataFrame:
    """Four ordered suppressions by name; each looks at the survivors of those before it.

    system silences BUILD-CONFIG, what is left of that silences VENDORED, pkg-config silences system whatever the case, and
    autosar silences what is left of system. A name's fate depends on rows of that name only (of the lower-cased name for
    pkg-config), so the chain is a few flags over one window by lower-cased name, and one shuffle. Columns in within keep
    their groups apart.
    """
    low = F.lower("name")
    eco = lambda e: F.col("ecosystem") == e
    exact, folded = Window.partitionBy(*within, low, "name"), Window.partitionBy(*within, low)
    flagged = components.withColumns(
        {
            "_system": F.bool_or(eco("system")).over(exact),
            "_config": F.bool_or(eco("BUILD-CONFIG")).over(exact),
            "_autosar": F.bool_or(eco("autosar")).over(exact),
            "_pkg": F.bool_or(eco("pkg-config")).over(folded),
        }
    )
    gone = (eco("BUILD-CONFIG") & F.col("_system")) | (eco("VENDORED") & F.col("_config") & ~F.col("_system")) | (eco("system") & (F.col("_pkg") | F.col("_autosar")))
    return flagged.where(~gone).drop("_system", "_config", "_autosar", "_pkg")


def reconcile(components: DataFrame) -> DataFrame:
    """Deduplication and all suppressions, in their order."""
    return suppress_across_ecosystems(suppress_unspecified(suppress_lower_sources(dedup_priority(components))))


#: Other names of libraries whose base name differs from the package's.
LIBRARY_ALIASES = {
    "z": ["zlib", "libz"],
    "ssl": ["ssl", "crypto", "openssl", "libssl", "libcrypto"],
    "crypto": ["ssl", "crypto", "openssl", "libssl", "libcrypto"],
    "curl": ["curl", "libcurl"],
    "xml2": ["xml2", "libxml2"],
    "pcap": ["pcap", "libpcap"],
    "pthread": ["pthread", "pthreads", "libpthread"],
    "m": ["m", "libm", "math"],
    "dl": ["dl", "libdl"],
}


def library_candidates(name: Column) -> Column:
    """Names under which a linked library may be listed: sorted and distinct."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?s)(\.so|\.dll|\.dylib).*$", ""), "^(lib)+", "")
    known = F.lit(None).cast("array<string>")
    for alias, names in LIBRARY_ALIASES.items():
        known = F.when(base == alias, F.array(*map(F.lit, names))).otherwise(known)
    qt = F.when(base.rlike("^Qt[56]"), F.array(F.regexp_replace(base, "^Qt[56]", "Qt"))).otherwise(F.array().cast("array<string>"))
    plain = F.when(base == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("lib"), base)), qt))
    return F.array_sort(F.array_distinct(F.concat(F.array(name, base), F.coalesce(known, plain))))


def refine_by_links(components: DataFrame, within=()) -> DataFrame:
    """BUILD-CONFIG rows in scope Build whose candidate names meet those of a system row become Runtime at 0.9.

    Candidates of both sides are exploded to distinct names and joined on equality; no pair of rows is compared.
    """
    linked = components.where(F.lower("ecosystem") == "system").select(*within, F.explode(library_candidates(F.col("name"))).alias("c")).distinct()
    open_rows = (F.col("ecosystem") == "BUILD-CONFIG") & (F.col("scope") == "Build")
    asked = components.where(open_rows).select(*within, "name").distinct().withColumn("c", F.explode(library_candidates(F.col("name"))))
    hits = asked.join(linked, [*within, "c"], "left_semi").select(*within, "name").distinct().withColumn("_linked", F.lit(True))
    hit = open_rows & F.coalesce("_linked", F.lit(False))
    return components.join(hits, [*within, "name"], "left").withColumns(
        {
            "scope": F.when(hit, "Runtime").otherwise(F.col("scope")),
            "scope_confidence": F.when(hit, 0.9).otherwise(F.col("scope_confidence")),
            "scope_reason": F.when(hit, "BUILD-CONFIG linked at runtime (matched SYSTEM lib)").otherwise(F.col("scope_reason")),
        }
    ).select(components.columns)


#: Packages that libraries named at a linker's command line come from; others are tried with and without 'lib'.
LINKED_NAMES = {"z": "zlib", "ssl": "openssl", "crypto": "openssl", "ssh2": "libssh2", "pcap": "libpcap", "xml2": "libxml2", "nl": "libnl", "sqlite3": "sqlite", "pthread": "pthreads", "m": "libm", "dl": "libdl", "rt": "librt", "jpeg": "libjpeg", "png": "libpng"}


def linked_candidates(name: Column) -> Column:
    """Names under which makefile variables and shared objects may know a linked library, in the order they are tried."""
    other = F.when(name.startswith("lib"), F.substring(name, F.lit(4), F.length(name))).otherwise(F.concat(F.lit("lib"), name))
    for library, package in LINKED_NAMES.items():
        other = F.when(name == library, package).otherwise(other)
    return F.array(name, other)


def resolve_versions(components: DataFrame, candidates: Column, *tables: DataFrame, within=(), notes: list[str] | None = None) -> DataFrame:
    """Fills 'unspecified' versions from tables (candidate, version): the first candidate that any table has, earlier tables first.

    Columns in within are part of the key on both sides; notes, one for each table, tell in source_file where a version came from.
    """
    key = [*within, "name", "ecosystem"]
    asked = components.where("version = 'unspecified'").select(*key, candidates.alias("c")).distinct().select(*key, F.posexplode("c").alias("pos", "candidate"))
    known = reduce(DataFrame.unionByName, [t.groupBy(*within, "candidate").agg(F.min("version").alias("found")).withColumn("src", F.lit(i)) for i, t in enumerate(tables)])
    best = asked.join(known, [*within, "candidate"]).groupBy(*key).agg(F.min_by(F.struct("found", "src"), F.struct("pos", "src")).alias("_best"))
    joined = components.join(best, key, "left")
    hit = (F.col("version") == "unspecified") & F.col("_best").isNotNull()
    filled = {"version": F.when(hit, F.col("_best.found")).otherwise(F.col("version"))}
    if notes:
        note = F.get(F.array(*map(F.lit, notes)), F.col("_best.src"))
        filled["source_file"] = F.when(hit, F.concat("source_file", F.lit(" [version from "), note, F.lit(": "), F.col("_best.found"), F.lit("]"))).otherwise(F.col("source_file"))
    return joined.withColumns(filled).select(components.columns)


def resolve_ros_versions(components: DataFrame, known: DataFrame, distro: str) -> DataFrame:
    """ros rows without a version take that of a distribution's table (name, version, repository_url): the first of five spellings that it has, and its repository."""
    dashed = F.replace("name", F.lit("_"), F.lit("-"))
    spellings = F.array(F.col("name"), F.concat(F.lit("python3-"), "name"), F.concat(F.lit(f"ros-{distro}-"), "name"), dashed, F.concat(F.lit("python3-"), dashed))
    open_row = (F.col("ecosystem") == "ros") & F.col("version").isin("unspecified", "detected")
    asked = components.where(open_row).select("name").distinct().select("name", F.posexplode(spellings).alias("pos", "spelt"))
    table = known.groupBy(F.col("name").alias("spelt")).agg(F.min_by(F.struct("version", "repository_url"), "version").alias("told"))
    best = asked.join(table, "spelt").groupBy("name").agg(F.min_by("told", "pos").alias("_told"))
    hit = open_row & F.col("_told").isNotNull()
    filled = {"version": F.when(hit, F.col("_told.version")).otherwise(F.col("version")), "repository_url": F.when(hit, F.coalesce("_told.repository_url", "repository_url")).otherwise(F.col("repository_url"))}
    return components.join(best, "name", "left").withColumns(filled).select(components.columns)


def lookup(components: DataFrame, table: DataFrame, key: Column, name: str, default: str | None = None) -> DataFrame:
    """Left join with a small dictionary (key, value) given as a table; missing keys take the default."""
    joined = components.withColumn("_k", key).join(table.select(F.col("key").alias("_k"), F.col("value").alias("_v")), "_k", "left")
    kept = [c for c in components.columns if c != name]
    return joined.select(*kept, (F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).alias(name))


def component_dirs(components: DataFrame, directories: DataFrame) -> DataFrame:
    """components (project, parent, name, ...) with dir: the child of parent that has the name, else 'lib' and the name, else either in any case. directories: project, path."""
    low = F.lower("name")
    parts = directories.select("project", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("parent"), F.element_at(F.split("path", "/"), -1).alias("_child"), F.col("path").alias("_dir"))
    asked = components.select("project", "parent", "name").distinct()
    met = asked.withColumn("_low", F.explode(F.array(low, F.concat(F.lit("lib"), low)))).join(parts.withColumn("_low", F.lower("_child")), ["project", "parent", "_low"])
    rank = F.when(F.col("_child") == F.col("name"), 0).when(F.col("_child") == F.concat(F.lit("lib"), "name"), 1).otherwise(2)
    best = met.groupBy("project", "parent", "name").agg(F.min_by("_dir", F.struct(rank, "_child")).alias("dir"))
    return components.join(best, ["project", "parent", "name"], "left")


def fill_registry_metadata(components: DataFrame, metadata: DataFrame) -> DataFrame:
    """License, author, homepage and repository from a supplied table (ecosystem, name, version, ...), where a row has none."""
    fields = ["license", "author", "homepage_url", "repository_url"]
    m = metadata.select("ecosystem", "name", "version", *(F.col(f).alias(f"_{f}") for f in fields)).dropDuplicates(["ecosystem", "name", "version"])
    return components.join(m, ["ecosystem", "name", "version"], "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).select(components.columns)
