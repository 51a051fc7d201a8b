"""Scope classification: ordered rules, the first that fits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import contains_any

# Fixed values of the name rules.
TEST_FRAMEWORKS = ["unity", "gtest", "googletest", "catch2", "doctest", "pytest", "unittest", "nose", "tox", "junit", "testng", "mockito", "mocha", "jest", "vitest", "jasmine", "karma", "chai", "rspec", "minitest", "xunit", "nunit"]
BUILD_TOOLS = ["cmake", "meson", "ninja", "make", "automake", "autoconf", "libtool", "gcc", "clang", "g++", "llvm", "rustc", "pkg-config", "pkgconfig"]
DEV_TOOLS = ["eslint", "prettier", "tslint", "stylelint", "pylint", "flake8", "black", "isort", "mypy", "ruff", "clippy", "rustfmt", "rubocop", "phpcs", "php-cs-fixer"]
SANITIZERS = ["asan", "ubsan", "msan", "tsan", "lsan"]
C_LIBRARIES = ["c", "m", "dl", "pthread", "rt", "socket", "curses", "ncurses"]
RUNTIME_LIBRARIES = ["zlib", "openssl", "mbedtls", "curl", "vsomeip", "nanopb", "protobuf", "elfutils", "libxml2", "libxslt", "sqlite", "postgresql", "mysql", "boost", "qt", "gtk", "glib"]
TEST_DIRS = ["/test/", "/tests/", "/unit_test/", "\\test\\", "\\tests\\", "\\unit_test\\"]
BUILD_DIRS = ["/3rd_party/", "/toolchains/", "/build/", "/pb/", "/lib/atom_utils/", "/lib/quark/", "\\3rd_party\\", "\\toolchains\\", "\\pb\\", "\\lib\\atom_utils\\", "\\lib\\quark\\"]
DEV_DIRS = ["/scripts/", "/tools/", "/util/", "/utils/", "_utils/", "/dev/", "\\scripts\\", "\\tools\\", "\\util\\", "\\utils\\", "_utils\\"]

TEST, BUILD, DEV, PROVIDED, RUNTIME = "Test", "Build", "Development", "Provided", "Runtime"


def rule(condition: Column, scope: str, confidence: float, reason: Column | str) -> Column:
    """(scope, confidence, reason) where the condition is true, else null."""
    told = F.struct(F.lit(scope).alias("scope"), F.lit(confidence).cast("double").alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return F.when(F.coalesce(condition, F.lit(False)), told)


def matched(entries: list[str], text: Column, form: str) -> Column:
    """The first entry that fits, else null; form holds {e} where the entry stands. One pattern, whose alternatives are tried in order."""
    one = lambda e: form.format(e=re.escape(e))
    return F.nullif(F.regexp_extract(text, "^(?:" + "|".join(map(one, entries)) + ")", 0), F.lit(""))


def named(entry: Column, scope: str, confidence: float, label: str) -> Column:
    return rule(entry.isNotNull(), scope, confidence, F.concat(F.lit(f"{label}: "), entry))


def native_rules(eco: Column, source: Column, is_dev: Column) -> list[Column]:
    inside = lambda e, *parts: (eco == e) & contains_any(source, list(parts))
    return [
        rule((eco == "npm") & is_dev, DEV, 1.0, "package.json devDependencies"),
        rule(inside("cargo", "[dev-dependencies]"), DEV, 1.0, "Cargo.toml [dev-dependencies]"),
        rule(inside("cargo", "[build-dependencies]"), BUILD, 1.0, "Cargo.toml [build-dependencies]"),
        rule(inside("pip", "requirements-dev.txt", "dev-requirements.txt"), DEV, 0.9, "requirements-dev.txt convention"),
        rule(inside("pip", "requirements-test.txt", "test-requirements.txt"), TEST, 0.9, "requirements-test.txt convention"),
        rule(inside("pip", "requirements-build.txt", "build-requirements.txt"), BUILD, 0.9, "requirements-build.txt convention"),
        rule(inside("maven", "scope:test"), TEST, 1.0, "Maven test scope"),
        rule(inside("maven", "scope:provided"), PROVIDED, 1.0, "Maven provided scope"),
        rule(inside("maven", "scope:runtime"), RUNTIME, 1.0, "Maven runtime scope"),
        rule(inside("maven", "scope:compile"), RUNTIME, 1.0, "Maven compile scope"),
        rule(inside("gradle", "testImplementation", "testCompileOnly", "testRuntimeOnly"), TEST, 1.0, "Gradle test dependency"),
        rule(inside("gradle", "compileOnly"), PROVIDED, 1.0, "Gradle compileOnly"),
    ]


def ecosystem_rules(eco: Column, source: Column) -> list[Column]:
    path = F.replace(F.lower(source), F.lit("\\"), F.lit("/"))
    return [
        rule((eco == "pip") & contains_any(path, ["/test/", "/tests/"]), TEST, 0.9, "PIP package from test directory"),
        rule(eco.isin("meson-wrap", "meson-subproject"), BUILD, 0.8, "Meson build dependency"),
        rule(eco == "git-submodule", PROVIDED, 0.7, "Source code submodule"),
        rule(eco == "vendored", RUNTIME, 0.9, "Vendored 3rd-party library"),
        rule(eco == "build-config", BUILD, 0.6, "BUILD-CONFIG package - Build dependency pending link analysis"),
    ]


def name_rules(name: Column) -> list[Column]:
    low = F.lower(name)
    tool = lambda entries: matched(entries, low, "{e}(?=$|[-_])")
    c_library = matched(C_LIBRARIES, F.regexp_replace(low, "^lib", ""), "{e}$")
    runtime = matched(RUNTIME_LIBRARIES, low, "{e}(?=$|-)|lib{e}")
    bare = F.when(runtime.isin(RUNTIME_LIBRARIES), runtime).otherwise(F.substring(runtime, 4, 99))
    return [
        named(tool(TEST_FRAMEWORKS), TEST, 1.0, "Test framework"),
        named(tool(BUILD_TOOLS), BUILD, 1.0, "Build tool"),
        named(tool(DEV_TOOLS), DEV, 1.0, "Development tool"),
        named(tool(SANITIZERS), DEV, 1.0, "Sanitizer tool"),
        named(c_library, PROVIDED, 1.0, "Standard C library"),
        named(bare, RUNTIME, 0.9, "Known runtime library"),
        rule(low.endswith("-dev") | low.endswith("-devel"), DEV, 0.7, "Package name ends with -dev/-devel"),
        rule(low.startswith("test-") | low.endswith("-test"), TEST, 0.7, "Package name contains 'test'"),
    ]


def directory_rules(ecosystem: Column, source: Column) -> list[Column]:
    low = F.lower(source)
    return [
        rule(contains_any(low, TEST_DIRS), TEST, 0.7, "Found in test directory"),
        rule((ecosystem != "BUILD-CONFIG") & contains_any(low, BUILD_DIRS), BUILD, 0.7, "Found in build directory"),
        rule(contains_any(low, DEV_DIRS), DEV, 0.7, "Found in development directory"),
    ]


def classify(components: DataFrame) -> DataFrame:
    """Fills scope, scope_confidence and scope_reason; rows that come with confidence 1 or more stay as they are."""
    eco, source = F.lower("ecosystem"), F.col("source_file")
    given = F.when(F.col("scope_confidence") >= 1.0, F.struct("scope", F.col("scope_confidence").cast("double").alias("confidence"), F.col("scope_reason").alias("reason")))
    rules = [given, *native_rules(eco, source, F.col("is_dev")), *ecosystem_rules(eco, source), *name_rules(F.col("name")), *directory_rules(F.col("ecosystem"), source), rule(F.lit(True), RUNTIME, 0.3, "Default (no match)")]
    told = components.withColumn("_rule", F.coalesce(*rules))
    return told.withColumns({"scope": F.col("_rule.scope"), "scope_confidence": F.col("_rule.confidence"), "scope_reason": F.col("_rule.reason")}).select(components.columns)


def classify_autosar(components: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows whose lower-cased name is a known module (name, layer, platform) become autosar and take its metadata."""
    known = modules.select(F.lower("name").alias("_low"), F.struct(F.col("name").alias("module_name"), "layer", "platform").alias("_m")).dropDuplicates(["_low"])
    joined = components.withColumn("_low", F.lower("name")).join(known, "_low", "left")
    hit = F.col("_m").isNotNull()
    return joined.withColumns({"ecosystem": F.when(hit, "autosar").otherwise(F.col("ecosystem")), "autosar": F.coalesce("_m", "autosar")}).select(components.columns)


def parse_scopes(text: str) -> list[str]:
    """Scopes of a comma-separated list; any case, 'dev' for development; an unknown name is an error."""
    known = {s.lower(): s for s in (RUNTIME, BUILD, TEST, DEV, "Optional", PROVIDED)} | {"dev": DEV}
    parts = [p.strip().lower() for p in text.split(",") if p.strip()]
    for p in parts:
        if p not in known:
            raise ValueError(f"unknown scope: {p}")
    return list(dict.fromkeys(known[p] for p in parts))


def filter_scopes(components: DataFrame, scopes: str | None = None, production: bool = False) -> DataFrame:
    """Rows in the listed scopes; production means Runtime and Optional. Both together are an error."""
    if scopes and production:
        raise ValueError("scopes and production exclude each other")
    if production:
        return components.where(F.col("scope").isin(RUNTIME, "Optional"))
    return components.where(F.col("scope").isin(parse_scopes(scopes))) if scopes else components
