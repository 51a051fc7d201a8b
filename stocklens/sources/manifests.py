"""Parsers of manifests, lock files, build scripts and imports, as column expressions over a table of files.

Each parser takes files (project, path, text) and returns component rows; a file that can't be read as its format gives no rows, but
parse_errors() tells it. TOML, which Spark has no reader for, is turned into JSON by one small UDF and then read like JSON; another
finds the end of calls, whose brackets nest to any depth.
"""

from __future__ import annotations

import json
import re
import sys
import tomllib
from collections.abc import Callable
from functools import partial, reduce
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

from ..functions.dictionaries import library_license, ros_license
from ..functions.identity import git_parts, js_root, python_name, python_root, source_info
from ..plans.tables import stored
from ..schema import as_components
from .tree import INSTALLED, MAX_BYTES, dir_of, name_of

NONE = "unspecified"
M = "map<string,string>"


def of_text(kind: DataType | str):
    """A UDF of one text. Texts go to Python by a hundred or so, whatever a table holds; an Arrow batch has 10,000 whole files and their results, for each core."""
    return F.udf(returnType=kind, useArrow=False)


@of_text(StringType())
def toml_json(t: str) -> str | None:
    try:
        return json.dumps(tomllib.loads(t), default=str)
    except (tomllib.TOMLDecodeError, TypeError, RecursionError):
        return None


def calls(head: str, marks: str) -> Callable[[Column], Column]:
    """Of a text the calls whose start fits head: an array of (call, body), in order. A call ends where its bracket closes, whatever nests in it; one that is never closed is left out.

    head ends with the opening bracket, and its first group is the call's name. marks is a pattern of what may hold brackets that don't
    count, as strings and comments.
    """
    start, mark = re.compile(head), re.compile(rf"{marks}|[()]", re.S)

    @of_text(ArrayType(StructType().add("call", StringType()).add("body", StringType())))
    def found(t: str) -> list[dict]:
        out = []
        for begun in start.finditer(t):
            depth = 1
            for m in mark.finditer(t, begun.end()):
                depth += (m[0] == "(") - (m[0] == ")")
                if not depth:
                    out.append({"call": begun[1], "body": t[begun.end() : m.start()]})
                    break
        return out

    return found


#: Strings and comments between which brackets count; a string that never ends runs to the end of the text.
CMAKE_DECLARE = calls(r"(?i)\b(FetchContent_Declare)\s*\(", r"""#[^\n]*|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)""")
CMAKE_ADD = calls(r"(?i)\b(ExternalProject_Add)\s*\(", r"""#[^\n]*|"(?:[^"\\]|\\.)*(?:"|\Z)""")
MESON_CALL = calls(r"(?<![\w.])(dependency)\s*\(", r"'(?:[^'\\\n]|\\.)*'")
BAZEL_CALL = calls(r"\b(http_archive|git_repository|local_repository|bazel_dep)\s*\(", r"""#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")


def called(files: DataFrame, *finders: Callable[[Column], Column], text: Column | None = None) -> DataFrame:
    """A row for each call that any of the finders finds: call, body and its place among those of its finder."""
    text = F.col("text") if text is None else text
    rows = [files.select("project", "path", F.posexplode(find(text)).alias("ordinal", "c")).select("project", "path", "ordinal", "c.call", "c.body") for find in finders]
    return union(*rows)


def first_of(rows: DataFrame, *keys: str, order: tuple = ("ordinal",)) -> DataFrame:
    """The first row of each key in a file, by order."""
    w = Window.partitionBy("project", *keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def emit(rows: DataFrame, label: str, ecosystem: str | Column, **values: Column) -> DataFrame:
    """Component rows of a parser; empty names go, empty versions are unspecified."""
    version = values.pop("version", F.lit(NONE))
    version = F.when(F.coalesce(F.trim(version), F.lit("")) == "", NONE).otherwise(F.trim(version))
    eco = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    given = {"source_file": source_info(F.lit(label), F.col("path")), "source_path": F.col("path"), **values}
    return as_components(rows, ecosystem=eco, version=version, **given).where("name is not null and trim(name) <> ''")


def each(files: DataFrame, pattern: str, *names: str, text: Column | None = None) -> DataFrame:
    """A row for each match of pattern in the text, with its groups by name and its place as ordinal."""
    found = files.select("project", "path", F.posexplode(F.regexp_extract_all(F.col("text") if text is None else text, F.lit(pattern), F.lit(0))).alias("ordinal", "_m"))
    return found.select("project", "path", "ordinal", "_m", *(F.regexp_extract("_m", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def distinct_names(files: DataFrame, names: Column, **more: Column) -> DataFrame:
    """A row for each different name of an array, in the order of first places: no shuffle, as a file is one row."""
    return files.select("project", "path", *(v.alias(n) for n, v in more.items()), F.posexplode(F.array_distinct(names)).alias("ordinal", "name"))


def json_of(files: DataFrame, schema: str, toml: bool = False) -> DataFrame:
    # Told to be nondeterministic, as filters and fields further up would each parse the text anew.
    text = toml_json.asNondeterministic()("text") if toml else F.col("text")
    return files.select("project", "path", F.from_json(text, schema).alias("j")).where("j is not null")


def entries(rows: DataFrame, column: str, **more: Column) -> DataFrame:
    """Keys and values of a map column as k and v."""
    return rows.select("project", "path", *(v.alias(n) for n, v in more.items()), F.explode(column).alias("k", "v"))


def union(*frames: DataFrame) -> DataFrame:
    """All frames, two at a time: each step is analyzed anew, so that a chain of many would cost the square of their number."""
    while len(frames) > 1:
        frames = [frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]



def package_json(files):
    sections = [("dependencies", False), ("devDependencies", True), ("peerDependencies", False), ("optionalDependencies", False)]
    j = json_of(files, ", ".join(f"{s} {M}" for s, _ in sections))
    direct = ~F.col("path").contains("node_modules")
    rows = union(*(entries(j, f"j.{s}", is_dev=F.lit(dev), ordinal=F.lit(i)) for i, (s, dev) in enumerate(sections)))
    return emit(rows, "npm", "npm", name=F.col("k"), version=F.col("v"), is_direct=direct)


LOCKED = f"packages map<string, struct<version string, integrity string, dev boolean, license string, resolved string, dependencies {M}>>"


LOCK_V1 = ArrayType(StructType().add("name", StringType()).add("version", StringType()).add("dev", BooleanType()).add("direct", BooleanType()))


@of_text(LOCK_V1)
def nested_packages(t: str) -> list[dict]:
    """Packages of a lock file of version 1, whose dependencies nest to any depth; those below the first level are transitive. Each is followed by those below it, names in order."""
    try:
        lock = json.loads(t)
        level = lambda d, direct: [(n, i, direct) for n, i in sorted((d or {}).items(), reverse=True)]
        todo, found = [] if "packages" in lock else level(lock.get("dependencies"), True), []
        while todo:
            name, info, direct = todo.pop()
            found.append({"name": name, "version": info.get("version") or "unknown", "dev": info.get("dev") is True, "direct": direct})
            todo += level(info.get("dependencies"), False)
        return found
    except (ValueError, AttributeError, RecursionError):
        return []


def package_lock_v1(files):
    rows = files.select("project", "path", F.posexplode(nested_packages("text")).alias("ordinal", "p")).withColumns({"name": F.col("p.name"), "version": F.col("p.version")})
    return emit(first_of(rows, "path", "name", "version"), "npm lock", "npm", version=F.col("version"), source=F.lit("LockFile"), is_dev=F.col("p.dev"), is_direct=F.col("p.direct"))


def json_text(column: str, key: str, *inner: str) -> Column:
    """A field that is a string, or an object of which the first of the inner fields is taken."""
    raw = F.get_json_object(column, f"$.{key}")
    inside = F.coalesce(F.lit(None), *(F.get_json_object(raw, f"$.{i}") for i in inner))
    return F.when(raw.startswith("{"), inside).when(~raw.startswith("["), raw)


def install_metadata(files: DataFrame) -> DataFrame:
    """project, dir, name and what the package.json of a package installed in dir/node_modules tells: license, author, maintainers, repository_url, homepage_url."""
    rows = files.where(F.col("path").rlike(INSTALLED) & F.col("text").isNotNull()).select("project", F.regexp_extract("path", INSTALLED, 1).alias("dir"), F.regexp_extract("path", INSTALLED, 2).alias("name"), "text")
    people = F.from_json(F.get_json_object("text", "$.maintainers"), "array<string>")
    named = F.array_compact(F.transform(people, lambda m: F.when(m.startswith("{"), F.get_json_object(m, "$.name")).otherwise(m)))
    return rows.select(
        "project", "dir", "name",
        F.coalesce(json_text("text", "license", "type"), F.get_json_object("text", "$.licenses[0].type")).alias("license"),
        json_text("text", "author", "name").alias("author"),
        F.when(F.size(named) > 0, named).alias("maintainers"),
        json_text("text", "repository", "url").alias("repository_url"),
        json_text("text", "homepage").alias("homepage_url"),
    )


def with_install_metadata(components: DataFrame, files: DataFrame) -> DataFrame:
    """npm rows of a project's manifest and lock file, with what the packages installed beside it tell where the row has nothing."""
    told = install_metadata(files)
    fields = ["license", "author", "maintainers", "repository_url", "homepage_url"]
    told = told.select("project", F.col("dir").alias("_dir"), "name", *(F.col(f).alias(f"_{f}") for f in fields), F.lit("npm").alias("ecosystem"))
    keyed = components.withColumn("_dir", dir_of(F.col("source_path")))
    return keyed.join(told, ["project", "_dir", "name", "ecosystem"], "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).select(components.columns)


def package_lock(files):
    """Lock files of versions 2 and 3, and of version 1. The name follows the last node_modules/; one level of it is a direct dependency. Of a name and version the entry of the smallest path stays."""
    return package_lock_v2(files).unionByName(package_lock_v1(files))


def package_lock_v2(files):
    rows = entries(json_of(files, LOCKED), "j.packages").where("k <> ''").withColumns({"name": F.regexp_replace("k", "^.*node_modules/", ""), "version": F.coalesce("v.version", F.lit("unknown"))})
    rows = first_of(rows, "path", "name", "version", order=("k",))
    levels = F.size(F.split("k", "node_modules/")) - 1
    algorithm, digest = F.split_part("v.integrity", F.lit("-"), F.lit(1)), F.regexp_extract("v.integrity", "^[^-]+-(.*)$", 1)
    sha = lambda n: F.when(F.col("v.integrity").isNotNull() & (algorithm == n), digest)
    return emit(rows, "npm lock", "npm", version=F.col("version"), source=F.lit("LockFile"), is_dev=F.coalesce("v.dev", F.lit(False)), is_direct=levels == 1, license=F.col("v.license"), checksum_sha256=sha("sha256"), checksum_sha512=sha("sha512"))


def package_lock_edges(files):
    """project, parent_id, child_name, ord of a lock file."""
    rows = entries(json_of(files, LOCKED), "j.packages").where("k <> '' and v.version is not null")
    parent = F.concat_ws("@", F.regexp_replace("k", "^.*node_modules/", ""), "v.version")
    return rows.select("project", parent.alias("parent_id"), F.posexplode(F.array_sort(F.map_keys("v.dependencies"))).alias("ord", "child_name")).select("project", "parent_id", "child_name", "ord")


def yarn_lock(files):
    found = each(files, r'(?m)^"?((?:@[^@\s"/]+/)?[^@\s"]+)@[^\n]*:\n\s+version:?\s+"?([^"\n]+)"?', "name", "v")
    return emit(found, "yarn", "npm", version=F.col("v"), source=F.lit("LockFile"))


def cargo_toml(files):
    rows = entries(json_of(files, f"dependencies {M}", True), "j.dependencies")
    return emit(rows, "cargo", "cargo", name=F.col("k"), version=F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.version")).otherwise(F.col("v")))


CRATES = "package array<struct<name string, version string, checksum string, dependencies array<string>>>"


def cargo_lock(files):
    rows = json_of(files, CRATES, True).select("project", "path", F.explode("j.package").alias("p"))
    return emit(rows, "cargo lock", "cargo", name=F.col("p.name"), version=F.col("p.version"), checksum_sha256=F.col("p.checksum"), source=F.lit("LockFile"))


def cargo_lock_edges(files):
    rows = json_of(files, CRATES, True).select("project", F.explode("j.package").alias("p"))
    return rows.select("project", F.concat_ws("@", "p.name", "p.version").alias("parent_id"), F.posexplode("p.dependencies").alias("ord", "child_name")).select("project", "parent_id", "child_name", "ord")


def pip_exact(spec: Column) -> Column:
    """The version of an exact pin, else unspecified."""
    return F.nullif(F.regexp_extract(spec, r"^\s*={2,3}\s*([^\s,;*]+)\s*(?:;.*)?$", 1), F.lit(""))


REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)"
#: Extras that are for development.
DEV_EXTRAS = ["test", "tests", "testing", "dev", "development", "doc", "docs"]


def requirement_rows(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumns({"name": F.regexp_extract(column, REQUIREMENT, 1), "spec": F.trim(F.regexp_extract(column, REQUIREMENT, 2))})


def requirements_txt(files):
    lines = files.select("project", "path", F.posexplode(F.split(F.regexp_replace("text", r"(?m)(^|\s)#.*$", ""), r"\r?\n")).alias("ordinal", "line"))
    return emit(requirement_rows(lines.where("not ltrim(line) like '-%'"), "line"), "requirements.txt", "pip", version=pip_exact(F.col("spec")))


def setup_py(files):
    """The first install list, in brackets of either kind, and the lists of extras for development."""
    install = each(files, r"(?s)install_requires\s*=\s*([\[(])(.*?)[\])]", "bracket", "body").where("ordinal = 0").drop("bracket", "_m").withColumn("dev", F.lit(False))
    extras = each(files, r"(?s)['\"]([^'\"]+)['\"]\s*:\s*\[(.*?)\]", "extra", "body").where(F.col("extra").isin(DEV_EXTRAS)).drop("extra", "_m").withColumn("dev", F.lit(True))
    rows = install.unionByName(extras)
    strings = rows.select("project", "path", "dev", (F.col("ordinal") * 1000 + F.col("dev").cast("int")).alias("list"), F.posexplode(F.regexp_extract_all("body", F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))).alias("at", "line"))
    strings = strings.withColumn("ordinal", F.row_number().over(Window.partitionBy("project", "path").orderBy("dev", "list", "at")))
    return emit(requirement_rows(strings, "line"), "setup.py", "pip", version=F.col("spec"), is_dev=F.col("dev"))


POETRY = f"package array<struct<name string, version string, category string, files array<struct<hash string>>, dependencies {M}>>"


def poetry_lock(files):
    rows = json_of(files, POETRY, True).select("project", "path", F.explode("j.package").alias("p"))
    digest = F.regexp_replace(F.get("p.files", F.lit(0))["hash"], "^sha256:", "")
    return emit(rows, "poetry", "pip", name=F.col("p.name"), version=F.col("p.version"), is_dev=F.coalesce(F.col("p.category") == "dev", F.lit(False)), checksum_sha256=digest, source=F.lit("LockFile"))


def poetry_lock_edges(files):
    rows = json_of(files, POETRY, True).select("project", F.explode("j.package").alias("p"))
    return rows.select("project", F.concat_ws("@", "p.name", "p.version").alias("parent_id"), F.posexplode(F.array_sort(F.map_keys("p.dependencies"))).alias("ord", "child_name")).select("project", "parent_id", "child_name", "ord")


def pipfile_lock(files):
    kind = "map<string, struct<version string, `index` string, hashes array<string>>>"
    j = json_of(files, f"`default` {kind}, develop {kind}")
    digest = F.regexp_replace(F.get(F.filter("v.hashes", lambda h: h.startswith("sha256:")), F.lit(0)), "^sha256:", "")
    one = lambda s, dev: emit(entries(j, f"j.{s}"), "Pipfile.lock", "pip", name=F.col("k"), version=F.regexp_replace("v.version", "^==", ""), is_dev=F.lit(dev), is_direct=F.col("v.index").isNotNull(), checksum_sha256=digest, source=F.lit("LockFile"))
    return union(one("default", False), one("develop", True))


def table_version(v: Column) -> Column:
    """The version of a TOML value, which is a string or a table."""
    spec = F.when(v.startswith("{"), F.get_json_object(v, "$.version")).otherwise(v)
    return F.when(spec == "*", NONE).otherwise(spec)


def pipfile(files):
    j = json_of(files, f"packages {M}, `dev-packages` {M}", True)
    return union(*(emit(entries(j, f"j.{s}"), "Pipfile", "pip", name=F.col("k"), version=table_version(F.col("v")), is_dev=F.lit(dev)) for s, dev in (("packages", False), ("`dev-packages`", True))))


def pyproject_toml(files):
    """Poetry's tables where there are any, else the project table, else PDM's development groups."""
    j = json_of(files, f"project struct<dependencies array<string>, `optional-dependencies` map<string, array<string>>>, tool struct<poetry struct<dependencies {M}, `dev-dependencies` {M}, `group` map<string, struct<dependencies {M}>>>, pdm struct<`dev-dependencies` map<string, array<string>>>>", True)
    poetry, pep = F.col("j.tool.poetry").isNotNull(), F.col("j.project.dependencies").isNotNull() | F.col("j.project.`optional-dependencies`").isNotNull()
    p = j.where(poetry)
    groups = p.select("project", "path", F.explode("j.tool.poetry.group").alias("g", "t")).select("project", "path", F.explode("t.dependencies").alias("k", "v"))
    tables = [(entries(p, "j.tool.poetry.dependencies"), False), (entries(p, "j.tool.poetry.`dev-dependencies`"), True), (groups, True)]
    rows = [emit(t.where("k <> 'python'"), "pyproject.toml", "pip", name=F.col("k"), version=table_version(F.col("v")), is_dev=F.lit(dev)) for t, dev in tables]
    e, d = j.where(~poetry & pep), j.where(~poetry & ~pep)
    named = lambda f, c: f.select("project", "path", F.explode(c).alias("g", "list")).select("project", "path", F.explode("list").alias("line"))
    lists = [(e.select("project", "path", F.explode("j.project.dependencies").alias("line")), False), (named(e, "j.project.`optional-dependencies`"), False), (named(d, "j.tool.pdm.`dev-dependencies`"), True)]
    return union(*rows, *(emit(requirement_rows(f, "line"), "pyproject.toml", "pip", version=F.col("spec"), is_dev=F.lit(dev)) for f, dev in lists))


def go_mod(files):
    blocks = each(files, r"(?sm)^require\s*\((.*?)^\s*\)", "body").select("project", "path", F.col("body").alias("text"))
    single = each(files, r"(?m)^require[ \t]+([^\s(]+)[ \t]+(\S+)", "name", "v")
    lines = each(blocks, r"(?m)^[ \t]*([^\s/][^\s]*)[ \t]+([^\s/]\S*)", "name", "v")
    return emit(single.unionByName(lines), "go.mod", "go", version=F.col("v"))


def gemfile(files):
    found = each(files, r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*([^,\n]+))?""", "name", "v")
    return emit(found, "Gemfile", "rubygems", version=F.regexp_replace("v", r"""^['"]|['"]$""", ""))


def composer_json(files):
    j = json_of(files, f"`require` {M}, `require-dev` {M}")
    keep = ~((F.col("k") == "php") | F.col("k").startswith("ext-"))
    return union(*(emit(entries(j, f"j.{s}").where(keep), "composer", "composer", name=F.col("k"), version=F.col("v"), is_dev=F.lit(dev)) for s, dev in (("`require`", False), ("`require-dev`", True))))


#: Gradle configurations and the scopes that they stand for; all others are Runtime.
GRADLE = {
    "Runtime": ["implementation", "api", "compile", "runtimeOnly", "runtime", "debugImplementation", "releaseImplementation"],
    "Provided": ["compileOnly", "compileOnlyApi", "providedCompile", "providedRuntime"],
    "Test": ["testImplementation", "testCompile", "testRuntimeOnly", "testCompileOnly", "androidTestImplementation"],
    "Build": ["annotationProcessor", "kapt", "classpath"],
}


def gradle_scope(configuration: Column) -> Column:
    out = F.lit("Runtime")
    for scope, names in GRADLE.items():
        out = F.when(configuration.isin(names), scope).otherwise(out)
    return out


def build_gradle(files):
    """Coordinates in map, platform and string forms, comments apart; of a (name, version) the first stays, in that order of forms."""
    # Strings are matched first and put back, so that comment marks inside them stay.
    plain = F.regexp_replace("text", r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?s:/\*.*?\*/)|//[^\n]*""", "$1")
    conf = "(" + "|".join(c for names in GRADLE.values() for c in names) + ")"
    strings = each(files, rf"""\b{conf}\s*\(?\s*(?:(?:platform|enforcedPlatform)\s*\(\s*)?['"]([^:'"]+):([^:'"]+)(?::([^'":@]+))?""", "conf", "g", "n", "v", text=plain)
    maps = each(files, rf"""\b{conf}\s*\(?\s*group\s*[:=]\s*['"]([^'"]+)['"]\s*,\s*name\s*[:=]\s*['"]([^'"]+)['"](?:\s*,\s*version\s*[:=]\s*['"]([^'"]+)['"])?""", "conf", "g", "n", "v", text=plain)
    scope = gradle_scope(F.col("conf"))
    rows = maps.withColumn("form", F.lit(0)).unionByName(strings.withColumn("form", F.when(F.col("_m").contains("latform"), 1).otherwise(2))).withColumn("name", F.concat_ws(":", "g", "n"))
    rows = first_of(rows, "path", "name", "v", order=("form", "ordinal"))
    return emit(rows, "gradle", "maven", version=F.col("v"), scope=scope, scope_confidence=F.lit(1.0), scope_reason=F.concat(F.lit("Gradle configuration: "), F.col("conf")), ordinal=F.col("form") * 100_000 + F.col("ordinal"))


def package_xml(files):
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    lic = ros_license(F.regexp_extract("text", r"(?s)<license[^>]*>\s*([^<]+?)\s*</license>", 1))
    found = each(files, r"<(depend|build_depend|exec_depend|run_depend|build_export_depend|test_depend)(?:\s[^>]*)?>\s*([^<\s]+)\s*</", "tag", "name", text=bare)
    own = files.select("project", "path", F.lit(0).alias("ordinal"), F.regexp_extract(bare, r"<name>\s*([^<\s]+)\s*</name>", 1).alias("name"), F.regexp_extract(bare, r"<version[^>]*>\s*([^<\s]+)\s*</", 1).alias("v"), lic.alias("license"))
    people = F.regexp_extract_all(bare, F.lit(r"(?s)<maintainer[^>]*>\s*([^<]+?)\s*</maintainer>"), F.lit(1))
    mails = F.regexp_extract_all(bare, F.lit(r"""<maintainer[^>]*\bemail\s*=\s*["']([^"']+)["']"""), F.lit(1))
    named = F.transform(people, lambda p, i: F.concat(p, F.coalesce(F.concat(F.lit(" <"), F.get(mails, i), F.lit(">")), F.lit(""))))
    author = F.nullif(F.regexp_extract(bare, r"(?s)<author[^>]*>\s*([^<]+?)\s*</author>", 1), F.lit(""))
    own = own.join(files.select("project", "path", F.when(F.size(named) > 0, named).alias("maintainers"), author.alias("author")), ["project", "path"])
    return union(emit(own, "package.xml", "ros", version=F.col("v")), emit(found, "package.xml", "ros", is_dev=F.col("tag") == "test_depend"))


def with_setup_versions(components: DataFrame) -> DataFrame:
    """Rows of a package.xml take the version that the setup.py beside it gives for a name that is the same but for case and separators; of several such rows the first does."""
    name, place = python_name(F.col("name")), dir_of(F.col("source_path"))
    setup = components.where((F.col("ecosystem") == "pip") & (name_of(F.col("source_path")) == "setup.py") & (F.col("source") == "Manifest") & (F.col("version") != NONE))
    given = setup.groupBy("project", place.alias("_dir"), name.alias("_norm")).agg(F.max_by("version", "ordinal").alias("_setup"))
    mine = (F.col("ecosystem") == "ros") & (name_of(F.col("source_path")) == "package.xml")
    first = Window.partitionBy("project", "source_path", "_norm").orderBy("ordinal", "name")
    ros = components.where(mine).withColumns({"_norm": name, "_dir": place}).withColumn("_n", F.row_number().over(first))
    merged = ros.join(given, ["project", "_dir", "_norm"], "left").withColumn("version", F.when(F.col("_n") == 1, F.coalesce("_setup", "version")).otherwise(F.col("version")))
    return components.where(~F.coalesce(mine, F.lit(False))).unionByName(merged.select(components.columns))


def ros_packages(files: DataFrame, components: DataFrame) -> DataFrame:
    """project, package, version, source_path, dependencies (array of component structs): one row for each package.xml, with what it and a setup.py beside it need.

    The version is the package's own, else that of the setup.py; packages without either are left out.
    """
    xml = files.where((name_of(F.col("path")) == "package.xml") & F.col("text").isNotNull())
    setup = files.where((name_of(F.col("path")) == "setup.py") & F.col("text").isNotNull()).select("project", dir_of(F.col("path")).alias("_dir"), F.regexp_extract("text", r"""\bversion\s*=\s*['"]([^'"]+)['"]""", 1).alias("_setup"))
    tag = lambda t: F.nullif(F.regexp_extract("text", rf"<{t}[^>]*>\s*([^<\s]+)\s*</", 1), F.lit(""))
    own = xml.select("project", F.col("path").alias("source_path"), dir_of(F.col("path")).alias("_dir"), tag("name").alias("package"), tag("version").alias("v"))
    own = own.join(setup, ["project", "_dir"], "left").withColumn("version", F.coalesce("v", F.nullif("_setup", F.lit("")))).where("package is not null and version is not null")
    used = components.where(name_of(F.col("source_path")).isin("package.xml", "setup.py") & F.col("ecosystem").isin("ros", "pip") & (F.col("source") == "Manifest"))
    one = F.struct(*(F.col(c) for c in components.columns))
    lists = used.select("project", dir_of(F.col("source_path")).alias("_dir"), one.alias("d"))
    joined = own.select("project", "_dir", "package", "version", "source_path").join(lists, ["project", "_dir"], "left").where("d is null or d.ecosystem <> 'ros' or d.name <> package")
    return joined.groupBy("project", "package", "version", "source_path").agg(F.array_sort(F.collect_list("d"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("dependencies"))


PIP_REPORT = "install array<struct<metadata struct<name string, version string, requires_dist array<string>>>>"


def _report_rows(files):
    rows = json_of(files, PIP_REPORT).select("project", "path", F.posexplode("j.install.metadata").alias("ordinal", "m")).where("m.name is not null")
    first = Window.partitionBy("project", "path", python_name(F.col("m.name"))).orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def pip_report(files):
    """Packages of a report that pip has written (pip-report.json); none is direct until the requirements beside it are known."""
    return emit(_report_rows(files), "pip transitive resolution", "pip", name=F.col("m.name"), version=F.col("m.version"), source=F.lit("LockFile"), is_direct=F.lit(False))


def pip_report_edges(files):
    child = F.transform("m.requires_dist", lambda r: F.regexp_extract(r, r"^([\p{Alnum}_-]*)", 1))
    parent = F.concat_ws("@", "m.name", F.coalesce("m.version", F.lit(NONE)))
    return _report_rows(files).select("project", parent.alias("parent_id"), F.posexplode(child).alias("ord", "child_name"))


def with_report_requirements(components: DataFrame) -> DataFrame:
    """Rows of a pip report that the requirements.txt beside it names are direct and count as manifest rows."""
    name, place, of = python_name(F.col("name")), dir_of(F.col("source_path")), lambda f: name_of(F.col("source_path")) == f
    asked = components.where(of("requirements.txt")).select("project", place.alias("_dir"), name.alias("_norm")).distinct().withColumn("_asked", F.lit(True))
    joined = components.withColumns({"_dir": place, "_norm": name}).join(asked, ["project", "_dir", "_norm"], "left")
    hit = F.coalesce(of("pip-report.json") & F.col("_asked"), F.lit(False))
    told = {"is_direct": F.when(hit, True).otherwise(F.col("is_direct")), "source": F.when(hit, "Manifest").otherwise(F.col("source")), "source_rank": F.when(hit, 2).otherwise(F.col("source_rank"))}
    return joined.withColumns(told).select(components.columns)


def url_version(url: Column) -> Column:
    """The last dotted number of a URL, else its last number."""
    last = lambda p: F.get(F.reverse(F.regexp_extract_all(url, F.lit(p), F.lit(0))), F.lit(0))
    return F.coalesce(last(r"[0-9]+(?:\.[0-9]+)+"), last("[0-9]+"))


def argument(text: Column, key: str) -> Column:
    """What follows a keyword, with or without quotes; only quoted text may have spaces."""
    groups = [F.nullif(F.regexp_extract(text, rf'\b{key}\s+(?:"([^"]*)"|([^\s)"]+))', i), F.lit("")) for i in (1, 2)]
    return F.coalesce(*groups)


def cmake(files):
    found = called(files, CMAKE_DECLARE, CMAKE_ADD).withColumns({"name": F.regexp_extract("body", r"^\s*(\w+)", 1), "body": F.regexp_replace("body", r"^\s*\w+", "")})
    repo, tag, url = argument(F.col("body"), "GIT_REPOSITORY"), argument(F.col("body"), "GIT_TAG"), argument(F.col("body"), "URL")
    rows = found.where((repo.isNotNull() | url.isNotNull()) & ~F.coalesce(F.concat_ws(" ", repo, tag, url).contains("${"), F.lit(False)))
    return emit(rows, "cmake", "cmake", version=F.coalesce(tag, url_version(url)), repository_url=F.coalesce(url, repo), checksum_sha256=F.nullif(F.regexp_extract("body", r"\b(?i:SHA256)=([0-9a-fA-F]{64})", 1), F.lit("")))


def conan_row(rows, column, label, **values):
    ref = F.col(column)
    version = F.regexp_replace(F.regexp_extract(ref, r"^[^/]+/([^@#]+)", 1), r"^\[|\]$", "")
    return emit(rows, label, "conan", name=F.trim(F.regexp_extract(ref, r"^([^/@#]+)", 1)), version=version, checksum_sha256=F.nullif(F.regexp_extract(ref, r"#([^%]+)", 1), F.lit("")), **values)


def conan_lock(files):
    j = json_of(files, "requires array<string>, build_requires array<string>, tool_requires array<string>, test_requires array<string>")
    return union(*(conan_row(j.select("project", "path", F.explode(f"j.{s}").alias("ref")), "ref", "conan lock", is_dev=F.lit(s != "requires"), source=F.lit("LockFile")) for s in ("requires", "build_requires", "tool_requires", "test_requires")))


def conanfile_txt(files):
    """References line by line, each under the section header before it; a header is a name alone in brackets, so that version ranges are none."""
    lines = files.select("project", "path", F.posexplode(F.split("text", r"\r?\n")).alias("ordinal", "line")).withColumn("line", F.trim("line"))
    header = F.nullif(F.regexp_extract("line", r"^\[([A-Za-z_]+)\]$", 1), F.lit(""))
    above = Window.partitionBy("project", "path").orderBy("ordinal")
    held = lines.withColumns({"header": header, "section": F.last(header, ignorenulls=True).over(above)})
    rows = held.where(F.col("header").isNull() & F.col("section").isin("requires", "build_requires", "tool_requires", "test_requires") & (F.col("line") != "") & ~F.col("line").startswith("#"))
    return conan_row(rows, "line", "conanfile.txt", is_dev=F.col("section") != "requires")


def conanfile_py(files):
    lists = each(files, r"""(?s)\b(requires|build_requires|tool_requires|test_requires)\s*=\s*[\[(]?(\s*['"].*?)(?:[\])]|\n\n)""", "section", "body").select("project", "path", "section", F.explode(F.regexp_extract_all("body", F.lit(r"""['"]([^'"]+/[^'"]+)['"]"""), F.lit(1))).alias("ref"))
    calls = each(files, r"""self\.(requires|build_requires|tool_requires|test_requires)\(\s*['"]([^'"]+)['"]""", "section", "ref").select("project", "path", "section", "ref")
    return conan_row(lists.unionByName(calls), "ref", "conanfile.py", is_dev=F.col("section") != "requires")


def vcpkg_json(files):
    fields = ["version", "version-semver", "version-date", "version-string"]
    j = json_of(files, "dependencies array<string>, overrides array<string>")
    of = lambda c, *keys: F.coalesce(*(F.get_json_object(c, f"$['{k}']") for k in keys))
    overrides = j.select("project", "path", F.explode("j.overrides").alias("o")).select("project", "path", of("o", "name").alias("name"), of("o", *fields).alias("forced"))
    rows = j.select("project", "path", F.explode("j.dependencies").alias("d"))
    table = F.col("d").startswith("{")
    rows = rows.withColumns({"name": F.when(table, of("d", "name")).otherwise(F.col("d")), "own": F.when(table, of("d", *fields, "version>=", "version>", "port-version")), "dev": F.when(table, F.coalesce(of("d", "host") == "true", F.lit(False))).otherwise(False)})
    return emit(rows.join(overrides, ["project", "path", "name"], "left"), "vcpkg", "vcpkg", version=F.coalesce("forced", "own"), is_dev=F.col("dev"))


SUBMODULE_DEPTH = 3


def submodule_paths(files):
    """project, path, dir, ordinal, sub_name, sub_path, url of the submodules that .gitmodules files list; those without a path or url are left out."""
    found = each(files.where(name_of(F.col("path")) == ".gitmodules"), r'(?s)\[submodule "([^"]+)"\]((?:(?!\[submodule).)*)', "sub_name", "body")
    key = lambda k: F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^\s*{k}\s*=\s*(.+)$", 1)), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(key("path"), r"^(?:\./)+|/+$", ""), r"/(?:\./)+", "/")
    return found.select("project", "path", dir_of(F.col("path")).alias("dir"), "ordinal", "sub_name", path.alias("sub_path"), key("url").alias("url")).where("sub_path is not null and url is not null")


def gitmodules(files, depth: int = SUBMODULE_DEPTH):
    """Submodules, and those of their folders' own .gitmodules files, whether inside the vendor mode or not, to depth levels below the first; each level names the submodules that hold it in source_file.

    A file is taken where its folder is first reached: at the top only if no file above it names its folder. Folders on the way to one aren't
    gone into again.
    """
    # Written once, and each level too, as all levels below would read the texts anew.
    listed = stored(submodule_paths(files))
    folder = F.when(F.col("dir") == "", F.col("sub_path")).otherwise(F.concat_ws("/", "dir", "sub_path"))
    inside = stored(submodule_paths(files.where("inside"))) if "inside" in files.columns else listed
    named = listed.select("project", folder.alias("_folder"), "dir").where("_folder <> dir").select("project", F.col("_folder").alias("dir")).distinct()
    level = stored(inside.join(named, ["project", "dir"], "left_anti").withColumns({"held_by": F.lit(""), "seen": F.array("dir")}))
    levels = [level]
    for _ in range(depth):
        above = level.select("project", folder.alias("dir"), F.concat(F.lit(" (submodule: "), "sub_name", F.lit(")"), "held_by").alias("held_by"), F.array_append("seen", folder).alias("seen")).where(~F.array_contains(F.slice("seen", 1, F.size("seen") - 1), F.col("dir")))
        level = stored(listed.join(above, ["project", "dir"]).select(*listed.columns, "held_by", "seen"))
        if level.isEmpty():
            break
        levels.append(level)
    rows = union(*levels)
    repo = F.get(F.transform(F.array("url"), git_parts), F.lit(0))  # bound once, as filters on the name would copy all of it
    named = F.coalesce(F.concat_ws("/", F.nullif(repo["owner"], F.lit("")), repo["repo"]), F.col("sub_name"))
    source = F.concat(source_info(F.lit("git submodule"), F.col("path")), "held_by")
    return emit(rows, "git submodule", "git-submodule", name=F.when(repo["repo"].isNotNull(), named).otherwise(F.col("sub_name")), version=F.lit("uninitialized"), repository_url=F.col("url"), source_file=source)


def with_commits(components: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """Submodule rows with their commits (project, dir, sub_path, commit) as versions; those without stay uninitialized."""
    known = submodule_paths(files).drop("path").join(commits, ["project", "dir", "sub_path"]).groupBy("project", F.col("dir").alias("_dir"), F.col("url").alias("repository_url")).agg(F.min("commit").alias("_commit")).withColumn("ecosystem", F.lit("git-submodule"))
    joined = components.withColumn("_dir", dir_of(F.col("source_path"))).join(known, ["project", "_dir", "repository_url", "ecosystem"], "left")
    return joined.withColumn("version", F.coalesce("_commit", "version")).select(components.columns)


FLAG = r"(?<![\w-])-l([A-Za-z0-9_+.-]+)"
PKG_CALL = r"pkg-config\s+(?:--[\w-]+(?:=\S+)?\s+)*([A-Za-z0-9][\w.+-]*)"


def flags(files, label, ecosystem):
    return emit(distinct_names(files, F.regexp_extract_all("text", F.lit(FLAG), F.lit(1))), label, ecosystem, license=library_license(F.col("name")))


def configure_ac(files):
    """pkg-config modules, checked libraries and searched ones, in this order; of a name the first stays."""
    checked = each(files, r"AC_CHECK_LIB\s*\(\s*\[?([\w.+-]+)", "name").withColumn("form", F.lit(1))
    searched = each(files, r"(?s)AC_SEARCH_LIBS\s*\(\s*\[?[\w.+-]+\]?\s*,\s*\[?([\w.+\s-]+)", "list").select("project", "path", "ordinal", F.explode(F.split(F.trim("list"), r"\s+")).alias("name"), F.lit(2).alias("form"))
    modules = each(files, r"(?s)PKG_CHECK_MODULES\s*\(\s*\[?\w+\]?\s*,\s*\[?([^\])]+)", "list")
    specs = modules.select("project", "path", "ordinal", F.explode(F.regexp_extract_all("list", F.lit(r"[A-Za-z][\w.+-]*(?:\s*[<>=]+\s*[\w.]+)?"), F.lit(0))).alias("spec"), F.lit(0).alias("form"))
    specs = specs.withColumns({"name": F.regexp_extract("spec", r"^([A-Za-z][\w.+-]*)", 1), "v": F.regexp_extract("spec", r"[<>=]\s*([\w.]+)$", 1)})
    every = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), (specs, checked, searched))
    rows = first_of(every, "path", "name", order=("form", "ordinal", "v"))
    return emit(rows, "autotools", F.when(F.col("form") == 0, "pkg-config").otherwise("autotools"), version=F.col("v"), ordinal=F.col("form") * 100_000 + F.col("ordinal"))


def makefile_am(files):
    return flags(files, "Makefile.am", "autotools")


def makefile(files):
    return union(flags(files, "Makefile", "system"), emit(distinct_names(files, F.regexp_extract_all("text", F.lit(PKG_CALL), F.lit(1))), "Makefile", "pkg-config"))


def pc_file(files):
    key = lambda k: F.trim(F.regexp_extract("text", rf"(?m)^{k}\s*:\s*(.+)$", 1))
    stem = F.regexp_replace(name_of(F.col("path")), r"\.pc$", "")
    return emit(files, "pkg-config", "pkg-config", name=F.coalesce(F.nullif(key("Name"), F.lit("")), stem), version=F.when(key("Version").contains("${"), NONE).otherwise(key("Version")))


#: Variables of tools, toolchains and platforms, and ends of such names.
MK_TOOLS = ["make", "cmake", "gcc", "clang", "python", "perl", "ruby", "autoconf", "automake", "libtool", "pkg_config", "pkgconfig", "ninja", "meson", "bash", "sh", "awk", "sed", "toolchain", "toolchains", "kl", "ndk", "raspbian", "ub_x86_64", "nvidia_jetson_orin"]
MK_ENDS = r"_(?:toolchains?|kl)$"
MK_VARIABLES = ("_VERSION", "_LIB_VER", "_VER")


def mk_assigned(line: str) -> tuple[str, str] | None:
    """Name and value of a version variable that a line sets, whichever way; only the value's first word counts."""
    left, equals, right = line.partition("=")
    name = re.search(r"\w+$", left.rstrip("?:").rstrip())
    words = right.partition("#")[0].split()
    return (name[0], words[0]) if equals and words and name and name[0].endswith(MK_VARIABLES) else None


def mk_holds(condition: str, look: Callable[[str], str]) -> bool:
    """Whether the inside of an ifeq holds: a $(filter) call over a variable and a list, or two equal sides. look gives a variable's value."""
    inside = condition.partition("$(filter")[2]
    if inside:
        variable, _, names = inside.partition(",")
        return look(variable.strip().removeprefix("$(").removesuffix(")")) in names.partition(")")[0].split()
    left, comma, right = (part.strip() for part in condition.partition(","))
    if not comma or "," in right:
        return False
    value = look("ARCH") if left == "$(ARCH)" else left
    return value == (look(right[2:-1]) if right.startswith("$(") and right.endswith(")") else right)


def mk_versions(text: str, arch: str | None) -> dict[str, str]:
    """Version variables of a makefile fragment. With an architecture only branches taken under it count, in their order; without one, a variable whose last value lies in a conditional has none."""
    values, unsure, branches = {}, set(), []
    look = lambda name: (arch or "") if name == "ARCH" else values.get(name, "")
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            continue
        if line.startswith("ifeq") and line[4:].lstrip().startswith("(") and ")" in line:
            branches.append(arch is None or mk_holds(line[line.index("(") + 1 : line.rindex(")")], look))
        elif line == "else":
            branches[-1:] = [not b for b in branches[-1:]]
        elif line == "endif":
            branches[-1:] = []
        elif (found := mk_assigned(line)) and (arch is None or all(branches)):
            name, value = found
            if branches and arch is None:
                if "$(" not in value:
                    unsure.add(name)
                continue
            unsure.discard(name)
            if "$(" not in value:
                values[name] = value
    return {k: v for k, v in values.items() if k not in unsure}


def mk_files(files: DataFrame, arch: str | None = None) -> DataFrame:
    """project, path, variable, version of the version variables in .mk files."""

    @of_text("map<string,string>")
    def read(t: str) -> dict[str, str]:
        return mk_versions(t, arch)

    return files.select("project", "path", F.explode(read("text")).alias("variable", "version"))


def mk_libraries(files: DataFrame, arch: str | None = None) -> DataFrame:
    """project, path, name, version: libraries by the variables that name them; those of patches name none."""
    variable = F.col("variable")
    name = F.lower(F.regexp_replace(variable, "(?:_VERSION|_LIB_VER|_VER)$", ""))
    return mk_files(files, arch).where(~variable.rlike("_PATCH_|_PATCH_VERSION$")).select("project", "path", name.alias("name"), "version")


def mk_file(files, arch: str | None = None):
    """Libraries of a project's .mk files; of a name that several set, the last file by path decides."""
    found = mk_libraries(files, arch).where(~F.col("name").isin(MK_TOOLS) & ~F.col("name").rlike(MK_ENDS))
    last = found.groupBy("project", "name").agg(F.max_by(F.struct("path", "version"), "path").alias("l")).select("project", "name", "l.*")
    return emit(last, "mk-file", "BUILD-CONFIG", version=F.col("version"), license=library_license(F.col("name")))


def library_json(files):
    j = json_of(files, "name string, version string, license string, homepage string, repository struct<url string>")
    return emit(j, "library.json", "vendored", name=F.col("j.name"), version=F.col("j.version"), license=F.col("j.license"), repository_url=F.col("j.repository.url"), homepage_url=F.col("j.homepage"), scope=F.lit("Runtime"), scope_confidence=F.lit(0.5))


#: Children of a vendored directory that are no libraries, directories that aren't searched, and names that mean another.
NO_LIBRARIES = "test tests testing googletest gtest catch2 doctest benchmark benchmarks example examples samples doc docs documentation build .git .svn".split()
TEST_NAMES = r"^(?:tests?|testing|benchmark)[_-]|[_-](?:tests?|benchmarks?)$"
NOT_SEARCHED = "node_modules target build dist .git .svn .hg __pycache__ .tox .mypy_cache .pytest_cache".split()
VENDORED_NAMES = {"paho-embedded-c": "paho.mqtt.embedded-c", "paho_mqtt_embedded_c": "paho.mqtt.embedded-c", "minizip-ng": "minizip"}
VENDORED = r"^((?:.*/)?(?:3rd_party|3rdparty)/([^/]+))/([^/]+)$"


def cmake_words(command: str) -> Column:
    """The words of each call of a command without brackets in it: an array of arrays, quotes gone."""
    bodies = F.regexp_extract_all("text", F.lit(rf"\b{command}\s*\(([^()]*)\)"), F.lit(1))
    return F.transform(bodies, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda w: F.replace(w, F.lit('"'), F.lit(""))))


DOTTED = r"^[0-9]+(?:\.[0-9]+){0,3}"


def cmake_version() -> Column:
    """The version of a project() call, else of variables that are set for its parts: X_MAJOR_VERSION, or X_VERSION_MAJOR, and so on."""
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  value is made once, however often then names it
    leading = lambda c: F.nullif(F.regexp_extract(c, DOTTED, 0), F.lit(""))
    projects = F.filter(cmake_words("(?i:project)"), lambda w: (F.get(w, F.lit(1)) == "VERSION") & F.get(w, F.lit(2)).rlike(DOTTED))
    given = F.filter(cmake_words("set"), lambda w: (F.size(w) == 2) & F.get(w, F.lit(1)).rlike("^[0-9]+$"))
    names = ("MAJOR", "MINOR", "PATCH")

    def part(sets: Column, end: str) -> Column:
        hits = F.filter(sets, lambda w: F.get(w, F.lit(0)).rlike(rf"^\w+{end}$"))
        return bound(hits, lambda h: F.get(F.element_at(F.when(F.size(h) > 0, h), -1), F.lit(1)))

    def joined(sets: Column) -> Column:
        last, other = (F.struct(*(part(sets, end.format(p)).alias(p) for p in names)) for end in ("_{}_VERSION", "_VERSION_{}"))
        return bound(F.struct(last.alias("last"), other.alias("other")), chosen)

    def chosen(both: Column) -> Column:
        last, other = both["last"], both["other"]
        major, minor, patch = (F.coalesce(last[p], other[p]) if p == "MAJOR" else F.when(last["MAJOR"].isNotNull(), last[p]).otherwise(F.coalesce(other[p], last[p])) for p in names)
        return F.when(major.isNotNull() & ~(minor.isNull() & patch.isNotNull()), F.concat_ws(".", major, minor, patch))

    return F.coalesce(bound(F.get(F.get(projects, F.lit(0)), F.lit(2)), leading), bound(given, joined))


def vendored_libraries(files: DataFrame) -> DataFrame:
    """Children of 3rd_party and 3rdparty: the version that their CMakeLists.txt gives, else their library.properties; a child with C sources and neither has none."""
    child, name = F.regexp_extract("path", VENDORED, 2), name_of(F.col("path"))
    inside = files.where(F.col("path").rlike(VENDORED) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, NOT_SEARCHED))) & ~F.lower(child).isin(NO_LIBRARIES) & ~F.lower(child).rlike(TEST_NAMES))
    place = ["project", F.regexp_extract("path", VENDORED, 1).alias("root"), child.alias("child")]
    properties = F.nullif(F.regexp_extract(F.regexp_extract("text", r"(?m)^version\s*=\s*(\S+)", 1), DOTTED, 0), F.lit(""))
    cmake, told = name == "CMakeLists.txt", F.struct("path", F.when(name == "CMakeLists.txt", F.coalesce(cmake_version(), F.lit(NONE))).otherwise(properties).alias("version"))
    useful = (name == "CMakeLists.txt") | ((name == "library.properties") & properties.isNotNull())
    # Texts of the two names only; of all other files the path is enough.
    texts = inside.where(useful & F.col("text").isNotNull()).select(*place, told.alias("told"), F.when(cmake, 0).otherwise(1).alias("rank"), F.lit(False).alias("source"))
    sources = inside.where(name.rlike(r"\.(?:c|cpp|cxx|cc|h|hpp|hxx)$")).select(*place, F.lit(None).cast(texts.schema["told"].dataType).alias("told"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("source"))
    best = texts.unionByName(sources).groupBy("project", "root", "child").agg(F.min_by("told", "rank").alias("told"))
    best = best.select("project", F.coalesce("told.path", "root").alias("path"), F.coalesce("told.version", F.lit(NONE)).alias("v"), "child")
    meant = F.col("child")
    for other, library in VENDORED_NAMES.items():
        meant = F.when(F.col("child") == other, library).otherwise(meant)
    return emit(best, "vendored-3rdparty", "VENDORED", name=meant, version=F.col("v"))


#: Elements whose short names are components.
COMPONENT_TAGS = ["SW-COMPONENT-PROTOTYPE", "BSW-MODULE-DESCRIPTION", "APPLICATION-SW-COMPONENT-TYPE", "ECU-ABSTRACTION-SW-COMPONENT-TYPE", "SERVICE-SW-COMPONENT-TYPE", "COMPOSITION-SW-COMPONENT-TYPE", "COMPLEX-DEVICE-DRIVER-SW-COMPONENT-TYPE"]


def arxml(files):
    found = each(files, rf"(?is)<(?:{'|'.join(COMPONENT_TAGS)})(?:\s[^>]*)?>(?:\s|<!--.*?-->)*<SHORT-NAME[^>]*>\s*([^<]+?)\s*</", "name")
    return emit(first_of(found, "name", order=("path", "ordinal")), "autosar/arxml", "autosar")


def meson_build(files):
    """dependency(), find_library() and subproject() calls; of a name and kind the first stays."""
    plain = F.regexp_replace("text", r"(?m)#[^\n]*", "")
    bare = r"""^\s*['"]([^'"]+)['"]"""
    deps = called(files, MESON_CALL, text=plain).withColumns({"name": F.regexp_extract("body", bare, 1), "v": F.regexp_replace(F.regexp_extract("body", r"""version\s*:\s*\[?\s*['"]([^'"]+)['"]""", 1), r"^[<>=!\s]+", "")})
    kinds = {"meson": deps, "system": each(files, r"""\bfind_library\s*\(\s*['"]([^'"]+)['"]""", "name", text=plain), "meson-subproject": each(files, r"""(?<!\w)subproject\s*\(\s*['"]([^'"]+)['"]""", "name", text=plain)}
    rows = [(kind, first_of(found.where("name <> ''"), "path", "name")) for kind, found in kinds.items()]
    more = {"meson": {"version": F.col("v")}, "system": {"license": library_license(F.col("name"))}, "meson-subproject": {"version": F.lit("subproject")}}
    return union(*(emit(found, "meson", kind, **more[kind]) for kind, found in rows))


def wrap(files):
    key = lambda k: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^\s*{k}\s*=\s*(.+)$", 1)), F.lit(""))
    version = F.coalesce(F.nullif(F.regexp_extract(key("directory"), r"-v?([0-9][\w.]*)$", 1), F.lit("")), url_version(key("source_url")), key("revision"))
    rows = files.where(F.col("text").rlike(r"\[wrap-(?:file|git)\]") & F.col("path").rlike(r"(?:^|/)subprojects/[^/]+$"))
    return emit(rows, "meson wrap", "meson-wrap", name=F.regexp_replace(name_of(F.col("path")), r"\.wrap$", ""), version=version, repository_url=F.coalesce(key("url"), key("source_url")), checksum_sha256=key("source_hash"))


def bazel_value(body: str, key: str) -> Column:
    return F.nullif(F.regexp_extract(body, rf"""\b{key}\s*=\s*\[?\s*["']([^"']+)["']""", 1), F.lit(""))


def workspace(files):
    """Archives, git repositories and local ones, in this order; of a name the first stays. An archive's version is the first number of strip_prefix, else of its URL."""
    plain = F.regexp_replace("text", r"(?m)^\s*#[^\n]*", "")
    found = called(files, BAZEL_CALL, text=plain).where("call <> 'bazel_dep'")
    val = lambda k: bazel_value("body", k)
    url = F.coalesce(val("remote"), val("urls?"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    archive = F.coalesce(number(val("strip_prefix")), number(url))
    version = F.when(F.col("call") == "local_repository", "local").when(F.col("call") == "http_archive", archive).otherwise(F.coalesce(val("tag"), F.substring(val("commit"), 1, 7)))
    form = F.when(F.col("call") == "http_archive", 0).when(F.col("call") == "local_repository", 2).otherwise(1)
    rows = first_of(found.withColumns({"name": val("name"), "form": form}).where("name is not null"), "path", "name", order=("form", "ordinal"))
    return emit(rows, "bazel", "bazel", version=version, repository_url=F.when(F.col("call") != "local_repository", url), checksum_sha256=val("sha256"), ordinal=F.col("form") * 100_000 + F.col("ordinal"))


def module_bazel(files):
    found = called(files, BAZEL_CALL).where("call = 'bazel_dep'")
    return emit(found.where(bazel_value("body", "version").isNotNull()), "bazel module", "bazel-bzlmod", name=bazel_value("body", "name"), version=bazel_value("body", "version"))


#: Modules that Node.js brings, and those that mark a file as written for MicroPython.
NODE = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
#: Modules of Python's standard library: those of this version, and those that versions since 3.8 have dropped.
REMOVED = "_bootlocale aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils dummy_threading formatter imghdr imp lib2to3 macpath mailcap msilib nis nntplib ossaudiodev parser pipes smtpd sndhdr spwd sunau symbol telnetlib uu xdrlib".split()
STANDARD = sorted({*sys.stdlib_module_names, *REMOVED})
MICRO = ["machine", "micropython", "utime", "ujson", "uos", "network", "esp", "esp32", "rp2"]


def imported(rows, label, ecosystem):
    return emit(rows, label, ecosystem, version=F.lit("detected"), source=F.lit("ImportScan"))


def without(names: Column, known: list[str]) -> Column:
    return F.array_except(names, F.array(*map(F.lit, known)))


PYTHON_IMPORT = r"(?m)^[ \t]*(?:import[ \t]+([A-Za-z_]\w*)(?=[\s,]|$)|from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b)"


def python_imports(files):
    found = F.regexp_extract_all("text", F.lit(PYTHON_IMPORT), F.lit(0))
    root = lambda m: python_root(F.coalesce(*(F.nullif(F.regexp_extract(m, PYTHON_IMPORT, i), F.lit("")) for i in (1, 2))))
    named = files.select("project", "path", F.transform(found, root).alias("names"))
    micro = F.arrays_overlap("names", F.array(*map(F.lit, MICRO)))
    rows = distinct_names(named, without(F.col("names"), [*STANDARD, *MICRO]), micro=micro)
    return imported(rows, "Python import", F.when(F.col("micro"), "micropython").otherwise("pip"))


JS_IMPORT = r"""(?:\brequire\(\s*|\bfrom\s+|(?m:^)\s*import\s+)['"]([^'"\n]+)['"]"""


def js_imports(files):
    found = F.filter(F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(1)), lambda m: ~m.rlike(r"^[./]|^node:"))
    return imported(distinct_names(files, without(F.transform(found, js_root), NODE)), "JavaScript import", "npm")


def go_imports(files):
    quoted = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    blocks = F.flatten(F.transform(quoted(F.col("text"), r"(?sm)^import\s*\((.*?)\)"), lambda b: quoted(b, '"([^"]+)"')))
    names = F.concat(quoted(F.col("text"), r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), blocks)
    foreign = F.filter(names, lambda n: F.split_part(n, F.lit("/"), F.lit(1)).contains(".") & ~n.startswith("golang.org/x/"))
    return imported(distinct_names(files, foreign), "Go import", "go")


#: Parsers by a pattern of the file's name; pom.xml has none, since it yields no rows.
PARSERS = {
    r"package\.json": package_json, r"package-lock\.json": package_lock, r"yarn\.lock": yarn_lock, r"Cargo\.toml": cargo_toml, r"Cargo\.lock": cargo_lock,
    r"requirements\.txt": requirements_txt, r"pip-report\.json": pip_report, r"setup\.py": setup_py, r"poetry\.lock": poetry_lock, r"Pipfile\.lock": pipfile_lock, r"Pipfile": pipfile,
    r"pyproject\.toml": pyproject_toml, r"go\.mod": go_mod, r"Gemfile": gemfile, r"composer\.json": composer_json, r"build\.gradle(?:\.kts)?": build_gradle,
    r"package\.xml": package_xml, r"CMakeLists\.txt|.*\.cmake": cmake, r"conan\.lock": conan_lock, r"conanfile\.txt": conanfile_txt, r"conanfile\.py": conanfile_py,
    r"vcpkg\.json": vcpkg_json, r"\.gitmodules": gitmodules, r"configure\.(?:ac|in)": configure_ac, r"Makefile\.am": makefile_am, r"[Mm]akefile": makefile,
    r".*\.pc": pc_file, r".*\.mk": mk_file, r"library\.json": library_json, r".*\.arxml": arxml, r"meson\.build": meson_build,
    r".*\.wrap": wrap, r"WORKSPACE(?:\.bazel)?": workspace, r"MODULE\.bazel": module_bazel,
}
SOURCES = {r".*\.py": python_imports, r".*\.(?:js|jsx|ts|tsx|mjs|cjs)": js_imports, r".*\.go": go_imports}
EDGES = {r"package-lock\.json": package_lock_edges, r"Cargo\.lock": cargo_lock_edges, r"poetry\.lock": poetry_lock_edges, r"pip-report\.json": pip_report_edges}


#: Formats that a file either is in or not, and the kinds of files that must be in them.
JSON = [r"package\.json", r"package-lock\.json", r"pip-report\.json", r"Pipfile\.lock", r"composer\.json", r"conan\.lock", r"vcpkg\.json", r"library\.json"]
TOML = [r"Cargo\.toml", r"Cargo\.lock", r"poetry\.lock", "Pipfile", r"pyproject\.toml"]
XML = [r"package\.xml", r".*\.arxml"]
INI = [r"\.gitmodules", r".*\.wrap"]
#: Parsers whose rows depend on files outside the vendor mode too.
EVERYWHERE = [r".*\.mk", r"\.gitmodules"]
#: Kinds that tree.silenced() may take out, and those that silence them.
SILENCED = [r"pyproject\.toml", "Pipfile", r"conanfile\.txt", r"conanfile\.py", "[Mm]akefile"]
SILENCING = [r"poetry\.lock", r"Pipfile\.lock", r"conan\.lock", r"configure\.(?:ac|in)", r"Makefile\.am"]


#: Names that a pattern of several names stands for; all others are one name, or one suffix after '.*'.
NAMES = {r"build\.gradle(?:\.kts)?": ["build.gradle", "build.gradle.kts"], r"CMakeLists\.txt|.*\.cmake": ["CMakeLists.txt"], r"configure\.(?:ac|in)": ["configure.ac", "configure.in"], "[Mm]akefile": ["Makefile", "makefile"], r"WORKSPACE(?:\.bazel)?": ["WORKSPACE", "WORKSPACE.bazel"]}


def kind_of(path: Column) -> Column:
    """The pattern in PARSERS or SOURCES that a file's name fits, else null; each file has one. Whole names are looked up, so that only suffixes are tried as patterns."""
    patterns = [*PARSERS, *SOURCES]
    known = {name: p for p in patterns for name in NAMES.get(p, [] if p.startswith(".*") else [p.replace("\\", "")])}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    out = F.lit(None).cast("string")
    for p in patterns:
        if ".*" in p:
            out = F.when(path.rlike(f"(?:^|/)[^/]*{p.rpartition('.*')[2]}$"), p).otherwise(out)
    return F.coalesce(F.try_element_at(table, name_of(path)), out)


@of_text(StringType())
def toml_fault(t: str) -> str | None:
    try:
        tomllib.loads(t)
    except (tomllib.TOMLDecodeError, RecursionError) as fault:
        return f"TOML: {fault}"


@of_text(StringType())
def xml_fault(t: str) -> str | None:
    try:
        expat.ParserCreate(encoding="utf-8").Parse(t.encode(), True)
    except expat.ExpatError as fault:
        return f"XML: {fault}"


def ini_fault(text: Column) -> Column:
    """The first line that is neither a section, a comment, a setting nor part of the one before it, or stands before any section."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(x)), lambda x: (x != "") & ~x.rlike(r"^\s*[#;]"))
    odd = F.get(F.filter(lines, lambda x: ~x.rlike(r"^\s*\[[^\]]+\]\s*(?:[#;].*)?$|^\s*[\w.-]+\s*(?:[=:]|$)|^\s+\S")), F.lit(0))
    first = F.get(lines, F.lit(0))
    bad = F.when(first.isNotNull() & ~first.rlike(r"^\s*\["), first).otherwise(odd)
    return F.when(bad.isNotNull(), F.concat(F.lit("INI: "), F.substring(bad, 1, 80)))


def parse_errors(files: DataFrame, kinds: set[str] | None = None, counted: Observation | None = None) -> DataFrame:
    """(project, path, parser, reason) of manifests that aren't in their parser's format, or couldn't be read. Parsers give no rows of such files, or those before the fault.

    JSON must be an object. counted takes the number of errors as 'errors' when the table is first computed.
    """
    files = files.select("project", "path", "text", F.coalesce(F.col("kind") if "kind" in files.columns else F.lit(None), kind_of(F.col("path"))).alias("parser"))
    read = files.where("text is not null")
    json_fault = F.when(F.try_parse_json("text").isNull(), "JSON: malformed").when(~F.ltrim("text").startswith("{"), "JSON: not an object")
    checks = ((JSON, json_fault), (TOML, toml_fault("text")), (XML, xml_fault("text")), (INI, ini_fault(F.col("text"))))
    rows = [read.where(F.col("parser").isin(names)).select("project", "path", "parser", fault.alias("reason")) for names, fault in checks if kinds is None or kinds & set(names)]
    missing = files.where(F.col("text").isNull() & F.col("parser").isin([*PARSERS])).select("project", "path", "parser", F.lit("not read").alias("reason"))
    found = union(missing, *rows).where("reason is not null")
    return found.observe(counted, F.count(F.lit(1)).alias("errors")) if counted is not None else found


def kinds_of(files: DataFrame) -> set[str]:
    """Kinds that there are: as many rows as patterns at most. Parsers of the others stay out of the plan."""
    return {r.kind for r in files.select("kind").distinct().collect()}


def _with_kind(files: DataFrame) -> DataFrame:
    kept = files.where("text is not null")
    return (kept if "kind" in files.columns else kept.withColumn("kind", kind_of(F.col("path")))).where("kind is not null")


def components(files: DataFrame, imports: bool = True, arch: str | None = None, listing: DataFrame | None = None, kinds: set[str] | None = None, silenced: DataFrame | None = None, depth: int = SUBMODULE_DEPTH) -> DataFrame:
    """Component rows of all manifests, and of the imports of source files up to MAX_BYTES. Files with null text give none.

    files may bring a column kind (kind_of), best as a partition column: then each parser reads its own files only, and none where kinds,
    those that there are, leaves it out. Rows outside the vendor mode (a column inside that is false) give version tables only. arch is the
    target architecture of conditionals in .mk files, depth how many levels of nested submodules are followed. listing has the files that tell
    libraries without manifests; silenced (project, path) names manifests that aren't parsed.
    """
    libraries = vendored_libraries(files if listing is None else listing)
    files = _with_kind(files)
    kinds = kinds_of(files) if kinds is None else kinds
    within = files.where("inside") if "inside" in files.columns else files

    def pick(kind: str) -> DataFrame:
        rows = (files if kind in EVERYWHERE else within).where(F.col("kind") == kind)
        return rows.join(silenced, ["project", "path"], "left_anti") if silenced is not None and kind in SILENCED else rows

    parsers = PARSERS | {r".*\.mk": partial(mk_file, arch=arch), r"\.gitmodules": partial(gitmodules, depth=depth)}
    found = {kind: parse(pick(kind)) for kind, parse in parsers.items() if kind in kinds}
    # Parsers whose rows are joined with each other's, those alone.
    for pair, joined in (((r"package\.xml", r"setup\.py"), with_setup_versions), ((r"requirements\.txt", r"pip-report\.json"), with_report_requirements)):
        if set(pair) <= kinds:
            found[pair] = joined(union(*(found.pop(kind) for kind in pair)))
    frames = [*found.values(), libraries]
    if imports:
        scripts = lambda *names: within.where(F.col("kind").isin(*names) & (F.octet_length("text") <= MAX_BYTES))
        frames += [parse(scripts(kind)) for kind, parse in SOURCES.items() if kind in kinds]
        also = sorted(kinds & {r"setup\.py", r"conanfile\.py"})
        frames += [python_imports(scripts(*also))] if also else []
    return union(*frames)


def edges(files: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    files = _with_kind(files)
    if "inside" in files.columns:
        files = files.where("inside")
    kinds = kinds_of(files) if kinds is None else kinds
    empty = files.limit(0).select("project", F.lit("").alias("parent_id"), F.lit("").alias("child_name"), F.lit(0).alias("ord"))
    return union(empty, *(parse(files.where(F.col("kind") == kind)) for kind, parse in EDGES.items() if kind in kinds))
