"""Rows that a scan must give: brackets at any depth, first entries, companions outside the vendor mode, order of the steps, errors, submodules."""

import json

import pytest
from pyspark.sql import Observation

from stocklens.plans.scan import scan, scan_tree
from stocklens.sources import manifests

FILES = "project string, path string, text string"
NESTED = 'FetchContent_Declare(one GIT_REPOSITORY https://x.org/one.git GIT_TAG v1 CONFIGURE_COMMAND "a (" $<IF:$<BOOL:(x(y(z)))>,(a),(b)> # a note (\n PATCH_COMMAND (((p))))'
PROJECTS = {
    "cmake": {"CMakeLists.txt": f"{NESTED}\nExternalProject_Add(two URL https://x.org/two-2.5.tar.gz STEP (a (b (c (d)))))\nFetchContent_Declare(open GIT_REPOSITORY https://x.org/o.git (\n"},
    "bazel": {"WORKSPACE": 'http_archive(name = "deep", urls = [f(g(h("https://x.org/deep-9.9.tar.gz")))], strip_prefix = "deep-3.2.1", url = "https://x.org/v7/deep-9.9.zip")\ngit_repository(name = "deep", remote = "r", tag = "t", x = (1, (2, (3))))\ngit_repository(name = "g", remote = "https://x.org/g", commit = "0123456789", init = a(b(c())))\nlocal_repository(name = "g", path = "p")\n', "MODULE.bazel": 'bazel_dep(name = "m", repo = f(g(1)), version = "4")\n'},
    "meson": {"meson.build": "a = dependency('deep', default_options: f(g(h('x'))), version: '>=1.5')\nb = dependency('deep', version: '2')\n", "wraps/lost.wrap": "[wrap-file]\ndirectory = lost-1\n", "subprojects/kept.wrap": "[wrap-git]\nurl = u\nrevision = r5\n"},
    "auto": {"configure.ac": "AC_CHECK_LIB([foo], [f])\nPKG_CHECK_MODULES([FOO], [foo >= 1.2])\nAC_CHECK_LIB([m], [cos])\n", "sub/makefile": "L = -lhidden\n"},
    "make": {"makefile": "L = -lz\n", "v.mk": "export ZLIB_VERSION ?= 1.3 # c\nA_VERSION += 9\nB_VER = $(ZLIB_VERSION)\n"},
    "setup": {"setup.py": "setup(install_requires=('six>=1.0', 'attrs'), extras_require={'x-y': ['never'], 'docs': ['sphinx==7']})"},
    "npm": {"package-lock.json": json.dumps({"packages": {"": {}, "node_modules/z/node_modules/a": {"version": "1", "license": "late"}, "node_modules/a": {"version": "1", "license": "first", "dev": True, "dependencies": {"lost": "1", "z": "1"}}, "node_modules/z": {"version": "2"}}}), "d/package.json": '{"dependencies": {"both": "1"}, "devDependencies": {"both": "1"}}'},
    "plain": {"package.json": '{"dependencies": {"com": "1"}}'},
    "car": {"package.json": '{"dependencies": {"com": "1"}}', "BSW/x.txt": ""},
    "ros": {"p/package.xml": "<package><name>p</name><version>1</version><depend>rclcpp</depend></package>"},
    "bad": {"package.json": "{not json", "b/package.json": "[1]", "Cargo.toml": "[[[", "package.xml": "<package><name>", ".gitmodules": "path = before any section\n", "s/x.wrap": "[wrap-file]\n???\n", "s/package.json": "{}", "s/setup.py": "not [ a format", "m/Cargo.toml": None},
    "dirs": {"src/CMakeLists.txt": "FetchContent_Declare(foo URL u-1.0)\nFetchContent_Declare(bar URL u-2.0)\n", "3rd_party/lib/CMakeLists.txt": 'project(lib\n VERSION 1.2.3.4 LANGUAGES C)', "3rd_party/plain/a.c": ""},
}


@pytest.fixture(scope="module")
def seen():
    return Observation()


@pytest.fixture(scope="module")
def found(spark, seen):
    files = spark.createDataFrame([(p, path, text, False) for p, some in PROJECTS.items() for path, text in some.items()] + [("dirs", d, None, True) for d in ("src", "src/libfoo", "src/Bar")], f"{FILES}, is_dir boolean")
    modules = spark.createDataFrame([("Com", "Services", "CP")], "name string, layer string, platform string")
    versions = spark.createDataFrame([("rclcpp", "9.1", "https://r")], "name string, version string, repository_url string")
    return scan(files, modules=modules, ros_versions=versions, errors=seen)


@pytest.fixture(scope="module")
def rows(found):
    return found.components.collect()


def of(rows, project):
    return {(r.ecosystem, r.name, r.version) for r in rows if r.project == project}


@pytest.mark.parametrize(
    "project,want",
    [
        ("cmake", {("cmake", "one", "v1"), ("cmake", "two", "2.5")}),
        ("bazel", {("bazel", "deep", "3.2.1"), ("bazel", "g", "0123456"), ("bazel-bzlmod", "m", "4")}),
        ("meson", {("meson", "deep", "1.5"), ("meson-wrap", "kept", "r5")}),
        ("auto", {("pkg-config", "foo", "1.2"), ("autotools", "m", "unspecified")}),
        ("make", {("system", "z", "1.3")}),
        ("setup", {("pip", "six", ">=1.0"), ("pip", "attrs", "unspecified"), ("pip", "sphinx", "==7")}),
        ("npm", {("npm", "a", "1"), ("npm", "z", "2"), ("npm", "both", "1")}),
        ("plain", {("npm", "com", "1")}),
        ("car", {("autosar", "com", "1")}),
        ("ros", {("ros", "p", "1"), ("ros", "rclcpp", "9.1")}),
        ("bad", set()),
        ("dirs", {("cmake", "foo", "1.0"), ("cmake", "bar", "2.0"), ("VENDORED", "lib", "1.2.3.4"), ("VENDORED", "plain", "unspecified")}),
    ],
)
def test_rows(rows, project, want):
    assert {r for r in of(rows, project) if r[0] != "BUILD-CONFIG"} == want


def test_first_entries_win(rows):
    by = {r.name: r for r in rows if r.project == "npm"}
    assert by["a"].license == "first" and by["a"].is_dev and by["a"].is_direct and not by["both"].is_dev
    assert next(r for r in rows if r.project == "car").autosar.layer == "Services"


@pytest.mark.parametrize("parts", [1, 8])
def test_first_entries_under_any_partitioning(spark, parts):
    """Two entries of one name and version with other flags, in files that are spread over partitions."""
    lock = json.dumps({"packages": {f"node_modules/{'y/node_modules/' * (i % 3)}n{i // 3}": {"version": "1", "dev": i % 3 > 0, "license": str(i % 3)} for i in range(90)}})
    files = spark.createDataFrame([(f"p{i}", "package-lock.json", lock) for i in range(5)], FILES).repartition(parts)
    got = manifests.package_lock(files).collect()
    assert len(got) == 150 and {(r.license, r.is_dev) for r in got} == {("0", False)}
    gradle = spark.createDataFrame([("p", "build.gradle", "api 'g:a:1'\nimplementation group: 'g', name: 'a', version: '1'\ntestImplementation 'g:a:1'\n")], FILES).repartition(parts)
    assert [(r.name, r.scope, r.scope_reason) for r in manifests.build_gradle(gradle).collect()] == [("g:a", "Runtime", "Gradle configuration: implementation")]


def test_ros_versions_in_both_outputs(found):
    packages = {r.package: r for r in found.ros.collect()}
    assert [(d.name, d.version, d.repository_url) for d in packages["p"].dependencies] == [("rclcpp", "9.1", "https://r")]


def test_errors(found, seen):
    got = {(r.path, r.reason.partition(":")[0]) for r in found.errors.collect()}
    assert got == {("package.json", "JSON"), ("b/package.json", "JSON"), ("Cargo.toml", "TOML"), ("package.xml", "XML"), (".gitmodules", "INI"), ("s/x.wrap", "INI"), ("m/Cargo.toml", "not read")}
    assert {r.project for r in found.errors.collect()} == {"bad"} and seen.get["errors"] == len(got)


def test_folders_and_unresolved_edges(found, rows):
    assert {r.name: r.component_dir for r in rows if r.project == "dirs"} == {"foo": "src/libfoo", "bar": "src/Bar", "lib": "3rd_party/lib", "plain": "3rd_party/plain"}
    assert [(r.project, r.parent_id, r.child_name) for r in found.unresolved.collect()] == [("npm", "a@1", "lost")]


def module(name, path):
    return f'[submodule "{name}"]\n\tpath = {path}\n\turl = https://github.com/o/{name}.git\n'


def test_submodules_below_submodules(spark):
    """Three levels below the first, through a vendor folder, and a folder that names itself."""
    files = {".gitmodules": module("a", "third_party/a"), "third_party/a/.gitmodules": module("b", "./b/") + module("self", "."), "third_party/a/b/.gitmodules": module("c", "c"), "third_party/a/b/c/.gitmodules": module("d", "d"), "third_party/a/b/c/d/.gitmodules": module("deep", "e"), "third_party/other/.gitmodules": module("x", "x")}
    table = spark.createDataFrame([("p", p, t) for p, t in files.items()], FILES)
    held = {r.name: r.source_file.partition(" (submodule")[1:] for r in scan(table, vendor="skip").components.collect()}
    assert {n: "".join(h) for n, h in held.items()} == {"o/a": "", "o/b": " (submodule: a)", "o/self": " (submodule: a)", "o/c": " (submodule: b) (submodule: a)", "o/d": " (submodule: c) (submodule: b) (submodule: a)"}
    assert {r.name for r in scan(table, vendor="skip", submodule_depth=1).components.collect()} == {"o/a", "o/b", "o/self"}


def test_companions_outside_the_vendor_mode(spark, tmp_path):
    """Version tables, definitions of any size and vendored libraries are read below pruned folders, manifests there are not."""
    module = "<ECUC-MODULE-DEF><SHORT-NAME>{}</SHORT-NAME><REVISION-LABEL>{}</REVISION-LABEL></ECUC-MODULE-DEF>"
    files = {
        "3rd_party/foo/CMakeLists.txt": "project(foo VERSION 1.2)\nFetchContent_Declare(hidden URL https://x.org/h-1.0.zip)\n",
        "3rd_party/v.mk": "BAR_VERSION = 4.5\n",
        "3rd_party/package.json": '{"dependencies": {"hidden": "1"}}',
        "node_modules/p/Gpt.h": "",
        "vendor/big.epd": "<A>" + module.format("Adc", "4.2.0") + "<!--" + "x" * (2 << 20) + "-->" + module.format("Gpt", "1.1") + "</A>",
        "vendor/Late/late.c": "/*\n *\tSW Version : 7.7\n */\n" + "int x;\n" * 200_000,
        "out/Off/off.h": " * SW Version : 8\n",
        "SWC/x.txt": "",
        "Makefile": "L = -lAdc -lGpt -lLate -lOff -lother\n",
    }
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = scan_tree(spark, str(tmp_path), "demo", vendor="skip", excludes=["out"])
    want = {("VENDORED", "foo", "1.2"), ("BUILD-CONFIG", "bar", "4.5"), ("autosar", "Adc", "4.2.0"), ("autosar", "Gpt", "1.1"), ("autosar", "Late", "7.7"), ("autosar", "Off", "8"), ("system", "other", "unspecified")}
    assert of(found.components.collect(), "demo") == want
    plain = scan_tree(spark, str(tmp_path), "demo", vendor="skip", excludes=["out"], companions=False)
    assert of(plain.components.collect(), "demo") == {("system", n, "unspecified") for n in ("Adc", "Gpt", "Late", "Off", "other")}
