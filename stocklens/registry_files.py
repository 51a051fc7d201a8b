"""Queries that render the part table as manifests, lock files and build scripts, parse them, and give the parsed rows; their SQL reads the part table alone.

Forty parts make a directory with one file of each format, and ten directories in turn a project. How a file looks is written here, apart
from the parsers; so is what its rows must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.tables import stored
from .sources import manifests

COLUMNS = ["project", "path", "name", "version", "ecosystem", "source", "is_dev", "is_direct", "license", "checksum_sha256", "checksum_sha512", "repository_url", "scope"]
BASE_SQL = """base as (
  select p_partkey as k, p_partkey // 40 as f, 'p' || (p_partkey // 40 % 10) as project, 'd' || (p_partkey // 40) as d, replace(p_name, ' ', '-') || '-' || p_partkey as name,
    replace(p_name, ' ', '_') || '_' || p_partkey as word, p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) as version, p_partkey % 3 = 0 as dev from part)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    f = F.expr("p_partkey div 40")
    tail = lambda mark: F.concat(F.replace("p_name", F.lit(" "), F.lit(mark)), F.lit(mark), k.cast("string"))
    version = F.concat_ws(".", F.col("p_size").cast("string"), (k % 7).cast("string"), (k % 3).cast("string"))
    return part.select(k.alias("k"), F.concat(F.lit("p"), (f % 10).cast("string")).alias("project"), F.concat(F.lit("d"), f.cast("string")).alias("d"), tail("-").alias("name"), tail("_").alias("word"), version.alias("version"), (k % 3 == 0).alias("dev"))


Line = Callable[[Column], Column]


def fill(pattern: str) -> Line:
    """A line of a part: {name}, {word}, {version}, {sha} and {upper} stand for what they say."""

    def made(r: Column) -> Column:
        hashed = F.sha2(r["name"], 256)
        values = {"name": r["name"], "word": r["word"], "version": r["version"], "sha": hashed, "upper": F.upper(r["word"])}
        out, rest = [], pattern
        while rest:
            before, _, rest = rest.partition("{{")
            key, _, rest = rest.partition("}}")
            out += [F.lit(before), *([values[key]] if key else [])]
        return F.concat(*out)

    return made


def lines(pattern: str, sep: str = "\n", where: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    return lambda rows: F.array_join(F.transform(F.filter(rows, where) if where else rows, fill(pattern)), sep)


def dev(r: Column) -> Column:
    return r["dev"]


def used(r: Column) -> Column:
    return ~r["dev"]


def nth(n: int, at: int = 0) -> Callable[[Column], Column]:
    return lambda r: r["k"] % n == at


def other(n: int, at: int = 0) -> Callable[[Column], Column]:
    return lambda r: r["k"] % n != at


def sql(path: str, ecosystem: str, name: str = "name", version: str = "version", source: str = "'Manifest'", is_dev: str = "false", is_direct: str = "true", license: str = "null", sha256: str = "null", sha512: str = "null", url: str = "null", scope: str = "'Runtime'", where: str = "true") -> str:
    """The rows of one file of each directory, as SQL over base; {d} in path stands for the directory."""
    return f"select project, d || '/{path}' as path, {name} as name, {version} as version, '{ecosystem}' as ecosystem, {source} as source, {is_dev} as is_dev, {is_direct} as is_direct, {license}::varchar as license, {sha256}::varchar as checksum_sha256, {sha512}::varchar as checksum_sha512, {url}::varchar as repository_url, {scope} as scope from base where {where}"


LOCK, NONE = "'LockFile'", "'unspecified'"
#: By family the files of a directory: path, what it is made of (text, or lines of its parts), and the SQL of its rows.
FAMILIES: dict[str, list[tuple[str, list, list[str]]]] = {
    "javascript": [
        ("package.json", ['{"dependencies": {', lines('"{{name}}": "^{{version}}"', ", ", used), '}, "devDependencies": {', lines('"{{name}}": "{{version}}"', ", ", dev), "}}"], [sql("package.json", "npm", version="case when dev then version else '^' || version end", is_dev="dev")]),
        (
            "lock/package-lock.json",
            ['{"lockfileVersion": 3, "packages": {"": {"name": "top"}, ', lines('"node_modules/{{name}}": {"version": "{{version}}", "license": "MIT", "integrity": "sha512-{{sha}}", "dependencies": {"x-{{name}}": "1"}}', ", ", other(5)), ", ", lines('"node_modules/a/node_modules/@s/{{name}}": {"version": "{{version}}", "dev": true, "integrity": "sha256-{{sha}}"}', ", ", nth(5)), "}}"],
            [
                sql("lock/package-lock.json", "npm", source=LOCK, license="'MIT'", sha512="sha256(name)", where="k % 5 <> 0"),
                sql("lock/package-lock.json", "npm", "'@s/' || name", source=LOCK, is_dev="true", is_direct="false", sha256="sha256(name)", where="k % 5 = 0"),
            ],
        ),
        (
            "old/package-lock.json",
            ['{"lockfileVersion": 1, "dependencies": {', lines('"{{name}}": {"version": "{{version}}", "dependencies": {"in-{{name}}": {"version": "{{version}}", "dev": true, "dependencies": {"deep-{{name}}": {}}}}}', ", "), "}}"],
            [sql("old/package-lock.json", "npm", source=LOCK), sql("old/package-lock.json", "npm", "'in-' || name", source=LOCK, is_dev="true", is_direct="false"), sql("old/package-lock.json", "npm", "'deep-' || name", "'unknown'", source=LOCK, is_direct="false")],
        ),
        ("yarn.lock", ["# yarn lockfile v1\n\n", lines('{{name}}@^{{version}}, {{name}}@*:\n  version "{{version}}"\n  resolved "u"\n', "\n", other(4)), "\n", lines('"@s/{{name}}@^1":\n  version "{{version}}"\n', "\n", nth(4))], [sql("yarn.lock", "npm", "case when k % 4 = 0 then '@s/' || name else name end", source=LOCK)]),
        ("a.ts", [lines("import x from '{{name}}/deep'\nimport './{{name}}'", "\n", other(2)), "\nimport fs from 'fs'\n", lines("const y = require('@s/{{name}}/z'); const z = require('{{name}}x');", "\n", nth(2))], [sql("a.ts", "npm", "case when k % 2 = 1 then name else '@s/' || name end", "'detected'", "'ImportScan'"), sql("a.ts", "npm", "name || 'x'", "'detected'", "'ImportScan'", where="k % 2 = 0")]),
        ("composer.json", ['{"require": {"php": ">=8", "ext-json": "*"', lines(', "v/{{name}}": "{{version}}"', "", used), '}, "require-dev": {', lines('"v/{{name}}": "{{version}}"', ", ", dev), "}}"], [sql("composer.json", "composer", "'v/' || name", is_dev="dev")]),
    ],
    "python": [
        ("requirements.txt", ["# pinned\n-r other.txt\n", lines("{{name}}[extra]=={{version}} ; python_version > '3'", "\n", nth(2)), "\n", lines("{{name}}>={{version}}  # not exact", "\n", nth(4, 1)), "\n"], [sql("requirements.txt", "pip", version="case when k % 2 = 0 then version else 'unspecified' end", where="k % 2 = 0 or k % 4 = 1")]),
        ("pip-report.json", ['{"install": [', lines('{"metadata": {"name": "{{word}}", "version": "{{version}}", "requires_dist": ["x-{{name}} (>=1); extra == \'t\'"]}}', ", "), "]}"], [sql("pip-report.json", "pip", "word", source="case when k % 2 = 0 or k % 4 = 1 then 'Manifest' else 'LockFile' end", is_direct="k % 2 = 0 or k % 4 = 1")]),
        ("pkg/setup.py", ["setup(\n  install_requires=(\n", lines("    '{{name}}>={{version}}',", "\n", used), "\n  ),\n  extras_require={'tests': [", lines("'{{name}}=={{version}}'", ", ", dev), "], 'gui': ['never']})\n"], [sql("pkg/setup.py", "pip", version="case when dev then '==' else '>=' end || version", is_dev="dev")]),
        ("poetry.lock", [lines('[[package]]\nname = "{{name}}"\nversion = "{{version}}"\ncategory = "main"\nfiles = [{hash = "sha256:{{sha}}"}, {hash = "sha256:00"}]\n\n[package.dependencies]\n"x-{{name}}" = "*"\n', "\n", used), "\n", lines('[[package]]\nname = "{{name}}"\nversion = "{{version}}"\ncategory = "dev"\n', "\n", dev)], [sql("poetry.lock", "pip", source=LOCK, is_dev="dev", sha256="case when not dev then sha256(name) end")]),
        ("Pipfile.lock", ['{"default": {', lines('"{{name}}": {"version": "=={{version}}", "index": "pypi", "hashes": ["md5:0", "sha256:{{sha}}"]}', ", ", used), '}, "develop": {', lines('"{{name}}": {"version": "=={{version}}"}', ", ", dev), "}}"], [sql("Pipfile.lock", "pip", source=LOCK, is_dev="dev", is_direct="not dev", sha256="case when not dev then sha256(name) end")]),
        ("pip/Pipfile", ["[packages]\n", lines('{{name}} = "*"', "\n", used), "\n[dev-packages]\n", lines('{{name}} = {version = "{{version}}", extras = ["a"]}', "\n", dev)], [sql("pip/Pipfile", "pip", version="case when dev then version else 'unspecified' end", is_dev="dev")]),
        ("poe/pyproject.toml", ['[tool.poetry.dependencies]\npython = "^3"\n', lines('{{name}} = "{{version}}"', "\n", used), "\n[tool.poetry.group.test.dependencies]\n", lines('{{name}} = { version = "{{version}}" }', "\n", dev), '\n[project]\ndependencies = ["never"]\n'], [sql("poe/pyproject.toml", "pip", is_dev="dev")]),
        ("pep/pyproject.toml", ["[project]\ndependencies = [", lines('"{{name}}=={{version}}"', ", ", used), "]\n[project.optional-dependencies]\ngui = [", lines('"{{name}}>{{version}}"', ", ", dev), "]\n"], [sql("pep/pyproject.toml", "pip", version="case when dev then '>' else '==' end || version")]),
        ("m.py", ["import os\nfrom . import near\n", lines("import {{word}}", "\n", used), "\n", lines("from {{word}}.inner import x", "\n", dev), "\n"], [sql("m.py", "pip", "word", "'detected'", "'ImportScan'")]),
        ("micro/m.py", ["import machine\n", lines("import {{word}}"), "\n"], [sql("micro/m.py", "micropython", "word", "'detected'", "'ImportScan'")]),
    ],
    "other": [
        ("Cargo.toml", ['[package]\nname = "x"\n[dependencies]\n', lines('{{name}} = "{{version}}"', "\n", used), "\n", lines('{{name}} = { version = "{{version}}", features = ["f"] }', "\n", dev), '\n[dev-dependencies]\nnever = "1"\n'], [sql("Cargo.toml", "cargo")]),
        ("Cargo.lock", [lines('[[package]]\nname = "{{name}}"\nversion = "{{version}}"\nchecksum = "{{sha}}"\ndependencies = ["x-{{name}}"]\n')], [sql("Cargo.lock", "cargo", source=LOCK, sha256="sha256(name)")]),
        ("go.mod", ["module m\n", lines("require x.org/{{name}} v{{version}}", "\n", dev), "\nrequire (\n\t// two words here\n", lines("\tx.org/{{name}} v{{version}} // indirect", "\n", used), "\n)\n"], [sql("go.mod", "go", "'x.org/' || name", "'v' || version")]),
        ("c.go", ['import "fmt"\n', lines('import "x.org/{{name}}"', "\n", dev), '\nimport (\n\t"os"\n\t"golang.org/x/net"\n', lines('\tq "x.org/{{name}}/v2"', "\n", used), "\n)\n"], [sql("c.go", "go", "'x.org/' || name || case when dev then '' else '/v2' end", "'detected'", "'ImportScan'")]),
        ("Gemfile", [lines("gem '{{name}}', '~> {{version}}'", "\n", used), "\n", lines('  gem "{{name}}"', "\n", dev)], [sql("Gemfile", "rubygems", version="case when dev then 'unspecified' else '~> ' || version end")]),
        ("build.gradle", ["/* implementation 'a:b:1' */\n", lines("implementation 'g:{{name}}:{{version}}' // note", "\n", nth(3, 1)), "\n", lines("testImplementation group: 'g', name: '{{name}}', version: '{{version}}'", "\n", dev), "\n", lines("annotationProcessor(platform(\"g:{{name}}:{{version}}\"))", "\n", nth(3, 2)), "\n"], [sql("build.gradle", "maven", "'g:' || name", scope="case k % 3 when 0 then 'Test' when 1 then 'Runtime' else 'Build' end")]),
        ("kts/build.gradle.kts", [lines('compileOnly("g:{{name}}:{{version}}")'), "\n"], [sql("kts/build.gradle.kts", "maven", "'g:' || name", scope="'Provided'")]),
        ("package.xml", ["<package><!-- <depend>no</depend> --><name>own", "</name><version>0.5</version><license>MIT</license>", lines("<exec_depend version_gte='1'>{{name}}</exec_depend>", "", used), lines("<test_depend>{{name}}</test_depend>", "", dev), "</package>"], [sql("package.xml", "ros", version=NONE, is_dev="dev"), "select distinct project, d || '/package.xml', 'own', '0.5', 'ros', 'Manifest', false, true, 'MIT', null::varchar, null::varchar, null::varchar, 'Runtime' from base"]),
        ("vcpkg.json", ['{"dependencies": [', lines('"{{name}}"', ", ", used), ", ", lines('{"name": "{{name}}", "version>=": "{{version}}", "host": true}', ", ", dev), '], "overrides": [', lines('{"name": "{{name}}", "version": "{{version}}"}', ", ", nth(3, 1)), "]}"], [sql("vcpkg.json", "vcpkg", version="case when k % 3 = 2 then 'unspecified' else version end", is_dev="dev")]),
        ("conan.lock", ['{"requires": [', lines('"{{name}}/{{version}}#{{sha}}%7"', ", ", used), '], "build_requires": [', lines('"{{name}}/{{version}}"', ", ", dev), "]}"], [sql("conan.lock", "conan", source=LOCK, is_dev="dev", sha256="case when not dev then sha256(name) end")]),
        ("txt/conanfile.txt", ["[requires]\n# c\n", lines("{{name}}/[{{version}}]@u/c", "\n", used), "\n[tool_requires]\n", lines("{{name}}/{{version}}", "\n", dev), "\n[generators]\nnever/1\n"], [sql("txt/conanfile.txt", "conan", is_dev="dev")]),
        ("py/conanfile.py", ["class A:\n    requires = [", lines('"{{name}}/{{version}}"', ",\n        ", used), "]\n    def b(self):\n", lines("        self.tool_requires('{{name}}/{{version}}')", "\n", dev), "\n"], [sql("py/conanfile.py", "conan", is_dev="dev")]),
        (".gitmodules", [lines('[submodule "{{name}}"]\n\tpath = libs/{{name}}\n\turl = https://x.org/o/{{name}}.git\n', "", used), lines('[submodule "{{name}}"]\n\tpath = libs/{{name}}\n\turl = ../{{name}}\n', "", dev), '[submodule "no"]\n\tpath = no\n'], [sql(".gitmodules", "git-submodule", "case when dev then name else 'o/' || name end", "'uninitialized'", url="case when dev then '../' || name else 'https://x.org/o/' || name || '.git' end")]),
    ],
    "build": [
        ("CMakeLists.txt", [lines('FetchContent_Declare({{word}} # a ) note\n  GIT_REPOSITORY "https://x.org/{{name}}.git" GIT_TAG v{{version}} PATCH_COMMAND a (b (c (d) "(")))', "\n", used), "\n", lines("externalproject_add ( {{word}} URL https://x.org/v1/{{name}}-{{version}}.tar.gz URL_HASH SHA256={{sha}} X (((y))))", "\n", dev), "\nFetchContent_Declare(v GIT_REPOSITORY ${U})\n"], [sql("CMakeLists.txt", "cmake", "word", "case when dev then version else 'v' || version end", sha256="case when dev then sha256(name) end", url="case when dev then 'https://x.org/v1/' || name || '-' || version || '.tar.gz' else 'https://x.org/' || name || '.git' end")]),
        ("configure.ac", [lines("AC_CHECK_LIB([{{name}}], [main])", "\n", other(3, 2)), "\n", lines("PKG_CHECK_MODULES([X], [{{name}} >= {{version}}])", "\n", dev), "\nAC_SEARCH_LIBS([f], [", lines("{{name}}", " ", nth(3, 2)), "])\n"], [sql("configure.ac", "pkg-config", where="dev"), sql("configure.ac", "autotools", version=NONE, where="not dev")]),
        ("am/Makefile.am", ["L = ", lines("-l{{name}}", " "), " -lmore -lmore\n"], [sql("am/Makefile.am", "autotools", version=NONE), "select distinct project, d || '/am/Makefile.am', 'more', 'unspecified', 'autotools', 'Manifest', false, true, null::varchar, null::varchar, null::varchar, null::varchar, 'Runtime' from base"]),
        ("make/makefile", [lines("L += -l{{name}}", "\n", used), "\n", lines("P := $(shell pkg-config --cflags {{name}})", "\n", dev), "\n"], [sql("make/makefile", "system", version=NONE, where="not dev"), sql("make/makefile", "pkg-config", version=NONE, where="dev")]),
        ("v.mk", [lines("{{upper}}_VERSION ?= {{version}} # c", "\n", used), "\nifeq ($(ARCH),arm)\n", lines("{{upper}}_VER = {{version}}", "\n", dev), "\nendif\nGCC_VERSION = 9\n"], [sql("v.mk", "BUILD-CONFIG", "lower(word)", where="not dev")]),
        ("meson.build", ["# dependency('no')\n", lines("a = dependency('{{name}}', fallback: f(g('x')), version: '>={{version}}')", "\n", nth(3, 1)), "\n", lines("b = cc.find_library('{{name}}', required: false)", "\n", dev), "\n", lines("subproject('{{name}}')", "\n", nth(3, 2)), "\n"], [sql("meson.build", "meson", where="k % 3 = 1"), sql("meson.build", "system", version=NONE, where="dev"), sql("meson.build", "meson-subproject", version="'subproject'", where="k % 3 = 2")]),
        ("WORKSPACE", ["# http_archive(name = 'no')\n", lines('http_archive(\n  name = "{{name}}", urls = ["https://x.org/a-{{version}}.tgz"], sha256 = "{{sha}}", p = f(g(h(1))))', "\n", nth(3, 1)), "\n", lines('git_repository(name = "{{name}}", remote = "https://x.org/{{name}}", commit = "{{sha}}")', "\n", dev), "\n", lines('local_repository(name = "{{name}}", path = "p")', "\n", nth(3, 2)), "\n"], [sql("WORKSPACE", "bazel", version="case k % 3 when 1 then version when 0 then sha256(name)[1:7] else 'local' end", sha256="case when k % 3 = 1 then sha256(name) end", url="case k % 3 when 1 then 'https://x.org/a-' || version || '.tgz' when 0 then 'https://x.org/' || name end")]),
        ("MODULE.bazel", [lines('bazel_dep(name = "{{name}}", version = "{{version}}", x = f((1)))', "\n", used), "\n", lines('bazel_dep(name = "{{name}}")', "\n", dev), "\n"], [sql("MODULE.bazel", "bazel-bzlmod", where="not dev")]),
        ("s.arxml", ["<AR>", lines("<BSW-MODULE-DESCRIPTION UUID='1'><SHORT-NAME>{{word}}</SHORT-NAME><P><SHORT-NAME>no</SHORT-NAME></P></BSW-MODULE-DESCRIPTION>", ""), "</AR>"], [sql("s.arxml", "autosar", "word", NONE)]),
    ],
    # A file of each part, named by it.
    "single": [
        ("{{name}}.pc", [fill("prefix=/usr\nName: {{name}}\nVersion: {{version}}\n")], [sql("' || name || '.pc", "pkg-config")]),
        ("{{name}}/library.json", [fill('{"name": "{{name}}", "version": "{{version}}", "license": "MIT", "repository": {"url": "u/{{name}}"}}')], [sql("' || name || '/library.json", "vendored", license="'MIT'", url="'u/' || name")]),
        ("subprojects/{{name}}.wrap", [fill("[wrap-file]\ndirectory = {{name}}-{{version}}\nsource_url = https://x.org/{{name}}.tgz\nsource_hash = {{sha}}\n")], [sql("subprojects/' || name || '.wrap", "meson-wrap", sha256="sha256(name)", url="'https://x.org/' || name || '.tgz'")]),
        ("3rd_party/{{name}}/CMakeLists.txt", [fill('project("{{name}}" VERSION {{version}} LANGUAGES C)\n')], [sql("3rd_party/' || name || '/CMakeLists.txt", "VENDORED")]),
        ("3rdparty/{{name}}/CMakeLists.txt", [fill('set(A_MAJOR_VERSION "7")\nset(A_MINOR_VERSION 2)\n')], [sql("3rdparty/' || name || '/CMakeLists.txt", "VENDORED", version="'7.2'")]),
    ],
}


def rendered(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """(project, path, text) of a family's files."""
    parts = base(spark, sf_dir)
    if family == "single":
        one = F.struct("k", "name", "word", "version", "dev")
        files = [F.struct(F.concat("d", F.lit("/"), fill(path)(one)).alias("path"), F.concat(*(part(one) for part in made)).alias("text")) for path, made, _ in FAMILIES[family]]
        return parts.select("project", F.inline(F.array(*files)))
    held = parts.groupBy("project", "d").agg(F.array_sort(F.collect_list(F.struct("k", "name", "word", "version", "dev"))).alias("r"))
    text = lambda made: F.concat(*(F.lit(part) if isinstance(part, str) else part(F.col("r")) for part in made))
    # A branch for each file, as one projection of all would outgrow generated code; the grouping below them is shuffled once.
    return manifests.union(*(held.select("project", F.concat("d", F.lit(f"/{path}")).alias("path"), text(made).alias("text")) for path, made, _ in FAMILIES[family]))


def parsed(family: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a family's files, which are written once by kind, as in a scan."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = rendered(spark, sf_dir, family)
        found = manifests.components(stored(files.withColumn("kind", manifests.kind_of(F.col("path"))), "kind"))
        return found.withColumn("path", F.col("source_path")).select(COLUMNS)

    return query


EDGE_FILES = {"javascript": ["lock/package-lock.json"], "python": ["poetry.lock", "pip-report.json"], "other": ["Cargo.lock"]}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of lock files and reports."""
    files = manifests.union(*(rendered(spark, sf_dir, family).where(F.col("path").rlike("|".join(f"/{p.replace('.', '[.]')}$" for p in paths))) for family, paths in EDGE_FILES.items()))
    return manifests.edges(stored(files.withColumn("kind", manifests.kind_of(F.col("path"))), "kind"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of files of which every third is cut short."""
    parts = base(spark, sf_dir)
    texts = {"package.json": '{"dependencies": {"{{name}}": "1"}}', "Cargo.toml": '[dependencies]\n{{name}} = "1"', "package.xml": "<package><name>{{word}}</name></package>", "s/x.wrap": "[wrap-file]\ndirectory = {{name}}-1"}
    one = F.struct("k", "name", "word", "version", "dev")
    cut = {"s/x.wrap": lambda t: F.concat(F.lit("stray\n"), t)}
    made = [F.struct(F.concat("d", F.lit("/"), "name", F.lit(f"/{path}")).alias("path"), F.when(F.col("dev"), cut.get(path, lambda t: F.substring(t, 1, 13))(fill(text)(one))).otherwise(fill(text)(one)).alias("text")) for path, text in texts.items()]
    found = manifests.parse_errors(parts.select("project", F.inline(F.array(*made))))
    return found.select("project", "path", "parser", F.split_part("reason", F.lit(":"), F.lit(1)).alias("format"))


FAULTS_SQL = f"""with {BASE_SQL}, kinds(file, parser, format) as (values ('package.json', 'package\\.json', 'JSON'), ('Cargo.toml', 'Cargo\\.toml', 'TOML'), ('package.xml', 'package\\.xml', 'XML'), ('s/x.wrap', '.*\\.wrap', 'INI'))
select project, d || '/' || name || '/' || file as path, parser, format from base, kinds where dev"""
EDGES_SQL = f"""with {BASE_SQL}
select project, name || '@' || version as parent_id, 'x-' || name as child_name, 0 as ord from base where k % 5 <> 0
union all select project, name || '@' || version, 'x-' || name, 0 from base where not dev
union all select project, word || '@' || version, 'x-' || name, 0 from base
union all select project, name || '@' || version, 'x-' || name, 0 from base"""
QUERIES = {f"parsed_{family}": parsed(family) for family in FAMILIES} | {"parsed_edges": edges, "parse_errors": faults}
ORACLES = {f"parsed_{family}": f"with {BASE_SQL}\n" + "\nunion all ".join(q for _, _, some in files for q in some) for family, files in FAMILIES.items()} | {"parsed_edges": EDGES_SQL, "parse_errors": FAULTS_SQL}
