"""Queries whose rows are picked to meet every rule of classification, identity and candidate names, with SQL that is written out by hand.

A row is a part; its key chooses an entry of each list, so that all entries meet in many combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dictionaries, identity
from .operators import classify, reconcile
from .schema import as_components, version_known

NAMES = ["gtest", "gtest_main", "pytest-cov", "Unity", "cmake", "make_tool", "g++", "pkg-config", "eslint-plugin", "black", "blackbird", "asan", "libasan", "pthread", "libm", "c", "curl-tools", "libcurl4", "zlib", "zlibx", "qt", "foo-dev", "Foo-Devel", "test-foo", "foo-test", "plain", "@scope/pkg-a.b", "github.com/org/mod", "vendor/my-package"]
ECOSYSTEMS = ["npm", "cargo", "pip", "maven", "gradle", "meson-wrap", "meson-subproject", "git-submodule", "vendored", "VENDORED", "BUILD-CONFIG", "system", "go", "rubygems", "composer", "ros", "autosar", "bazel", "cmake", "gguf", "safetensors", "php", "conan"]
PLACES = ["Cargo.toml [dev-dependencies]", "Cargo.toml [build-dependencies]", "x/requirements-dev.txt", "requirements-test.txt", "build-requirements.txt", "pom scope:test", "pom scope:provided", "pom scope:compile", "a testImplementation b", "compileOnly c", "/a/Tests/b", "/src/build/x", "/opt/tools/y", "plain"]
VERSIONS = ["1.2.3", "^1.0-beta", "~2", ">=3.1", "unspecified", "unknown", "detected", "$(FOO)", "local", "<=4"]
URLS = [None, "https://github.com/o/r", "https://example.com/a/x.tar.gz", "git@gitlab.com:g/s/r.git", "https://huggingface.co/org/m"]
AUTHORS = [None, "Jane <j@x.org>", "The Foundation", "Person: Bob", "Acme Inc", "Someone"]
LIBRARIES = ["libz.so.1", "z", "ssl", "libcrypto.so", "curl.dll", "xml2", "libpcap", "Qt5Core", "libQt6Gui.so.6", "Qt4Gui", "liblibfoo", "m", "dl", "pthread", "plain", ".so", "lib", "foo.dylib"]


def pick(values: list, at: Column) -> Column:
    """The value at a position modulo the list's length."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))))


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("int")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return as_components(
        parts,
        name=pick(NAMES, key),
        ecosystem=pick(ECOSYSTEMS, F.floor(key / 3)),
        version=pick(VERSIONS, F.floor(key / 2)),
        repository_url=pick(URLS, F.floor(key / 5)),
        author=pick(AUTHORS, F.floor(key / 4)),
        source_file=pick(PLACES, F.floor(key / 7)),
        is_dev=key % 2 == 0,
        ordinal=key,
    )


def listed(values: list) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v + "'" for v in values) + "]"


def sql_pick(values: list, at: str) -> str:
    return f"{listed(values)}[{at} % {len(values)} + 1]"


PICKED = f"""picked as (
  select p_partkey as ordinal, {sql_pick(NAMES, "p_partkey")} as name, {sql_pick(ECOSYSTEMS, "(p_partkey // 3)")} as ecosystem, {sql_pick(VERSIONS, "(p_partkey // 2)")} as version,
    {sql_pick(URLS, "(p_partkey // 5)")} as url, {sql_pick(AUTHORS, "(p_partkey // 4)")} as author, {sql_pick(PLACES, "(p_partkey // 7)")} as place, p_partkey % 2 = 0 as is_dev from part)"""


def classify_branches(spark, sf_dir) -> DataFrame:
    return classify.classify(picked(spark, sf_dir)).select("ordinal", "name", "ecosystem", "scope", "scope_confidence", "scope_reason")


CLASSIFY_SQL = f"""with {PICKED},
low as (
  select *, lower(name) as n, lower(ecosystem) as e, lower(place) as p,
    list_filter(['unity', 'gtest', 'googletest', 'catch2', 'doctest', 'pytest', 'unittest', 'nose', 'tox', 'junit', 'testng', 'mockito', 'mocha', 'jest', 'vitest', 'jasmine', 'karma', 'chai', 'rspec', 'minitest', 'xunit', 'nunit'],
      lambda x: lower(name) = x or starts_with(lower(name), x || '-') or starts_with(lower(name), x || '_'))[1] as test,
    list_filter(['cmake', 'meson', 'ninja', 'make', 'automake', 'autoconf', 'libtool', 'gcc', 'clang', 'g++', 'llvm', 'rustc', 'pkg-config', 'pkgconfig'],
      lambda x: lower(name) = x or starts_with(lower(name), x || '-') or starts_with(lower(name), x || '_'))[1] as build,
    list_filter(['eslint', 'prettier', 'tslint', 'stylelint', 'pylint', 'flake8', 'black', 'isort', 'mypy', 'ruff', 'clippy', 'rustfmt', 'rubocop', 'phpcs', 'php-cs-fixer'],
      lambda x: lower(name) = x or starts_with(lower(name), x || '-') or starts_with(lower(name), x || '_'))[1] as dev,
    list_filter(['asan', 'ubsan', 'msan', 'tsan', 'lsan'], lambda x: lower(name) = x or starts_with(lower(name), x || '-') or starts_with(lower(name), x || '_'))[1] as sanitizer,
    list_filter(['c', 'm', 'dl', 'pthread', 'rt', 'socket', 'curses', 'ncurses'], lambda x: lower(name) = x or lower(name) = 'lib' || x)[1] as clib,
    list_filter(['zlib', 'openssl', 'mbedtls', 'curl', 'vsomeip', 'nanopb', 'protobuf', 'elfutils', 'libxml2', 'libxslt', 'sqlite', 'postgresql', 'mysql', 'boost', 'qt', 'gtk', 'glib'],
      lambda x: lower(name) = x or starts_with(lower(name), 'lib' || x) or starts_with(lower(name), x || '-'))[1] as runtime from picked),
ruled as (
  select *, case
    when e = 'npm' and is_dev then 'Development|1|package.json devDependencies'
    when e = 'cargo' and contains(place, '[dev-dependencies]') then 'Development|1|Cargo.toml [dev-dependencies]'
    when e = 'cargo' and contains(place, '[build-dependencies]') then 'Build|1|Cargo.toml [build-dependencies]'
    when e = 'pip' and (contains(place, 'requirements-dev.txt') or contains(place, 'dev-requirements.txt')) then 'Development|0.9|requirements-dev.txt convention'
    when e = 'pip' and (contains(place, 'requirements-test.txt') or contains(place, 'test-requirements.txt')) then 'Test|0.9|requirements-test.txt convention'
    when e = 'pip' and (contains(place, 'requirements-build.txt') or contains(place, 'build-requirements.txt')) then 'Build|0.9|requirements-build.txt convention'
    when e = 'maven' and contains(place, 'scope:test') then 'Test|1|Maven test scope'
    when e = 'maven' and contains(place, 'scope:provided') then 'Provided|1|Maven provided scope'
    when e = 'maven' and contains(place, 'scope:runtime') then 'Runtime|1|Maven runtime scope'
    when e = 'maven' and contains(place, 'scope:compile') then 'Runtime|1|Maven compile scope'
    when e = 'gradle' and (contains(place, 'testImplementation') or contains(place, 'testCompileOnly') or contains(place, 'testRuntimeOnly')) then 'Test|1|Gradle test dependency'
    when e = 'gradle' and contains(place, 'compileOnly') then 'Provided|1|Gradle compileOnly'
    when e = 'pip' and (contains(p, '/test/') or contains(p, '/tests/')) then 'Test|0.9|PIP package from test directory'
    when e in ('meson-wrap', 'meson-subproject') then 'Build|0.8|Meson build dependency'
    when e = 'git-submodule' then 'Provided|0.7|Source code submodule'
    when e = 'vendored' then 'Runtime|0.9|Vendored 3rd-party library'
    when e = 'build-config' then 'Build|0.6|BUILD-CONFIG package - Build dependency pending link analysis'
    when test is not null then 'Test|1|Test framework: ' || test
    when build is not null then 'Build|1|Build tool: ' || build
    when dev is not null then 'Development|1|Development tool: ' || dev
    when sanitizer is not null then 'Development|1|Sanitizer tool: ' || sanitizer
    when clib is not null then 'Provided|1|Standard C library: ' || clib
    when runtime is not null then 'Runtime|0.9|Known runtime library: ' || runtime
    when ends_with(n, '-dev') or ends_with(n, '-devel') then 'Development|0.7|Package name ends with -dev/-devel'
    when starts_with(n, 'test-') or ends_with(n, '-test') then 'Test|0.7|Package name contains ''test'''
    when contains(p, '/test/') or contains(p, '/tests/') then 'Test|0.7|Found in test directory'
    when contains(p, '/build/') then 'Build|0.7|Found in build directory'
    when contains(p, '/tools/') then 'Development|0.7|Found in development directory'
    else 'Runtime|0.3|Default (no match)' end as told from low)
select ordinal, name, ecosystem, split_part(told, '|', 1) as scope, split_part(told, '|', 2)::double as scope_confidence, split_part(told, '|', 3) as scope_reason from ruled"""


def identity_branches(spark, sf_dir) -> DataFrame:
    name, version, eco, url, author = (F.col(c) for c in ("name", "version", "ecosystem", "repository_url", "author"))
    return picked(spark, sf_dir).select(
        "ordinal",
        identity.purl(name, version, eco, url).alias("purl"),
        identity.cpe23(name, version, eco).alias("cpe"),
        identity.download_location(name, version, eco, url).alias("download"),
        identity.supplier(eco).alias("supplier"),
        identity.originator(author).alias("originator"),
        identity.spdx_id(name).alias("spdx_id"),
        identity.version_info(version).alias("version_info"),
        identity.python_name(name).alias("python_name"),
        identity.js_root(name).alias("js_root"),
        version_known(version).alias("known"),
    )


IDENTITY_SQL = f"""with {PICKED},
repos(url, is_git, place, hub) as (values ('https://github.com/o/r', true, 'github/o/r', null), ('https://example.com/a/x.tar.gz', false, 'generic/a/x.tar.gz', null),
  ('git@gitlab.com:g/s/r.git', true, 'gitlab/g/s/r', null), ('https://huggingface.co/org/m', true, 'generic/org/m', 'org/m')),
kinds(ecosystem, kind) as (values ('npm', 'npm'), ('cargo', 'cargo'), ('pip', 'pypi'), ('maven', 'maven'), ('go', 'golang'), ('rubygems', 'gem'), ('composer', 'composer'), ('ros', 'ros'), ('conan', 'conan')),
known as (
  select p.*, kind, coalesce(is_git, false) as is_git, r.place as repo, hub, version not in ('unspecified', 'unknown', 'detected') and not contains(version, '$(') as known, string_split(name, '/') as parts
  from picked p left join repos r on p.url = r.url left join kinds k on k.ecosystem = p.ecosystem),
shown as (
  select *, case when known then '@' || version else '' end as v, 'pkg:generic/' || name as generic,
    case when ecosystem = 'npm' and starts_with(name, '@') then replace(ltrim(parts[1], '@'), '-', '_') when ecosystem = 'npm' then 'npm' when ecosystem = 'cargo' then 'rust' when ecosystem = 'pip' then 'python'
      when ecosystem = 'rubygems' then 'ruby' when ecosystem = 'composer' then replace(parts[1], '-', '_') when ecosystem = 'go' then replace(coalesce(parts[2], 'go'), '-', '_') else replace(ecosystem, '-', '_') end as vendor,
    replace(replace(case when starts_with(name, '@') then coalesce(parts[2], name) else parts[-1] end, '-', '_'), '.', '_') as product,
    case version when '^1.0-beta' then '1.0_beta' when '~2' then '2' when '>=3.1' then '3.1' when '<=4' then '4' else version end as plain from known)
select ordinal,
  case when kind is not null then 'pkg:' || kind || '/' || name || v
    when ecosystem in ('meson-subproject', 'vendored', 'system', 'autosar') then generic || v || '?type=' || ecosystem
    when ecosystem = 'meson-wrap' then case when is_git then 'pkg:' || repo else generic end || v || '?type=meson-wrap'
    when ecosystem = 'bazel' then case when is_git then 'pkg:' || repo else generic end || v || '?type=bazel'
    when ecosystem = 'cmake' then case when is_git then 'pkg:' || repo else generic end || v
    when ecosystem = 'git-submodule' then case when repo is not null then 'pkg:' || repo else generic end || v
    when ecosystem in ('gguf', 'safetensors') and hub is not null then 'pkg:huggingface/' || hub || v
    when ecosystem = 'gguf' then generic || v || '?type=gguf'
    when ecosystem = 'safetensors' and contains(name, '/') then 'pkg:huggingface/' || name || v
    when ecosystem = 'safetensors' then generic || v || '?type=safetensors'
    else generic || v end as purl,
  case when known then 'cpe:2.3:a:' || vendor || ':' || product || ':' || plain || ':*:*:*:*:*:*:*' end as cpe,
  case when not known then 'NOASSERTION'
    when ecosystem = 'npm' then 'https://registry.npmjs.org/' || name || '/-/' || parts[-1] || '-' || version || '.tgz'
    when ecosystem = 'pip' then 'https://pypi.org/project/' || name || '/' || version || '/'
    when ecosystem = 'cargo' then 'https://crates.io/api/v1/crates/' || name || '/' || version || '/download'
    when ecosystem in ('go', 'ros') then coalesce(url, 'NOASSERTION')
    when ecosystem = 'php' then 'https://packagist.org/packages/' || name else 'NOASSERTION' end as download,
  case ecosystem when 'npm' then 'Organization: npmjs' when 'pip' then 'Organization: pypi' when 'cargo' then 'Organization: crates.io' when 'go' then 'Organization: go modules' when 'ros' then 'Organization: ROS' when 'php' then 'Organization: packagist' end as supplier,
  case author when 'Jane <j@x.org>' then 'Person: Jane <j@x.org>' when 'The Foundation' then 'Organization: The Foundation' when 'Person: Bob' then author when 'Acme Inc' then 'Organization: Acme Inc' when 'Someone' then 'Person: Someone' end as originator,
  regexp_replace(name, '[^A-Za-z0-9.-]', '-', 'g') as spdx_id, case when known then version else 'NOASSERTION' end as version_info, regexp_replace(lower(name), '[-_.]+', '_', 'g') as python_name,
  case when starts_with(name, '@') then parts[1] || '/' || parts[2] else parts[1] end as js_root, known
from shown"""


def library_candidates(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("int")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pick(LIBRARIES, key).alias("name"))
    return parts.select("p_partkey", "name", F.concat_ws(",", reconcile.library_candidates(F.col("name"))).alias("candidates"), F.concat_ws(",", reconcile.linked_candidates(F.col("name"))).alias("linked"), dictionaries.library_license(F.col("name")).alias("license"))


CANDIDATES_SQL = f"""with named as (select p_partkey, {sql_pick(LIBRARIES, "p_partkey")} as name from part),
based as (select *, regexp_replace(regexp_replace(name, '(\\.so|\\.dll|\\.dylib).*$', ''), '^(lib)+', '') as base from named)
select p_partkey, name,
  array_to_string(list_sort(list_distinct(list_concat([name, base], case base when 'z' then ['zlib', 'libz'] when 'ssl' then ['ssl', 'crypto', 'openssl', 'libssl', 'libcrypto'] when 'crypto' then ['ssl', 'crypto', 'openssl', 'libssl', 'libcrypto']
    when 'curl' then ['curl', 'libcurl'] when 'xml2' then ['xml2', 'libxml2'] when 'pcap' then ['pcap', 'libpcap'] when 'pthread' then ['pthread', 'pthreads', 'libpthread'] when 'm' then ['m', 'libm', 'math'] when 'dl' then ['dl', 'libdl'] when '' then []
    else list_concat(['lib' || base], case when starts_with(base, 'Qt5') or starts_with(base, 'Qt6') then ['Qt' || base[4:]] else [] end) end))), ',') as candidates,
  name || ',' || case name when 'z' then 'zlib' when 'ssl' then 'openssl' when 'xml2' then 'libxml2' when 'pthread' then 'pthreads' when 'm' then 'libm' when 'dl' then 'libdl' else case when starts_with(name, 'lib') then name[4:] else 'lib' || name end end as linked,
  case lower(name) when 'z' then 'Zlib' when 'ssl' then 'Apache-2.0' when 'xml2' then 'MIT' when 'm' then 'LGPL-2.1-or-later' when 'dl' then 'LGPL-2.1-or-later' when 'pthread' then 'LGPL-2.1-or-later' end as license
from based"""

QUERIES = {"classify_branches": classify_branches, "identity_branches": identity_branches, "library_candidates": library_candidates}
ORACLES = {"classify_branches": CLASSIFY_SQL, "identity_branches": IDENTITY_SQL, "library_candidates": CANDIDATES_SQL}
