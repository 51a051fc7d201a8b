"""Listing, parsers that look at several files, binary files, AUTOSAR, and the wiring of a scan."""

import json
import struct

import pytest

from stocklens.operators import reconcile
from stocklens.plans.scan import corrected, scan, scan_tree
from stocklens.sinks import bom
from stocklens.sources import autosar, manifests, native, tree

FILES = "project string, path string, text string"


def table(spark, files, project="demo"):
    return spark.createDataFrame([(project, p, t) for p, t in files.items()], FILES)


def write(top, files):
    for p, t in files.items():
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def test_pruned_directories_are_never_opened(spark, tmp_path):
    write(tmp_path, {"package.json": "{}", "src/a/b/c.py": "import x", "node_modules/p/package.json": '{"license": "MIT"}', "node_modules/p/deep/package.json": "{}", "node_modules/p/v.mk": "", "node_modules/@s/q/package.json": "{}", "out/x.py": "", "out/d.epd": ""})
    (tmp_path / "node_modules" / "p" / "locked").mkdir()

    def walked(companions, opened=None, **options):
        reader = tree.TreeReader({"path": str(tmp_path), "partitions": "3", "companions": str(companions).lower(), **options})
        if opened is not None:
            entries = reader.entries
            reader.entries = lambda at: (opened.append(at), entries(at))[1]
        return {r[1]: r[4] for p in reader.partitions() for r in reader.walk(p) if not r[3]}

    inside, skip = {"package.json": True, "src/a/b/c.py": True}, {"vendor": "skip", "excludes": "out"}
    installed = {"node_modules/p/package.json": False, "node_modules/@s/q/package.json": False}
    opened = []
    assert walked(False, opened, **skip) == inside and not any("node_modules" in o or o == "out" for o in opened)
    assert walked(False, **skip, installed="true") == inside | installed
    assert walked(True, **skip) == inside | {"node_modules/p/v.mk": False, "out/d.epd": False}
    assert walked(True, **skip, installed="true") == inside | installed | {"node_modules/p/v.mk": False, "out/d.epd": False}
    assert walked(False, vendor="only") == {p: True for p in ("node_modules/p/package.json", "node_modules/p/deep/package.json", "node_modules/p/v.mk", "node_modules/@s/q/package.json")}


def test_partitions_follow_the_tree(tmp_path):
    write(tmp_path, {f"src/d{i}/e{j}/f.txt": "x" for i in range(6) for j in range(6)})
    for parts in (1, 4, 20, 1000):
        reader = tree.TreeReader({"path": str(tmp_path), "partitions": str(parts)})
        split = reader.partitions()
        rows = [r for p in split for batch in reader.read(p) for r in batch.to_pylist()]
        assert sorted(r["path"] for r in rows if not r["is_dir"]) == sorted(f"src/d{i}/e{j}/f.txt" for i in range(6) for j in range(6))
        assert len(split) >= min(parts, 44)


def test_one_folder_is_read_by_many_tasks(spark, tmp_path):
    """A flat folder is listed by one task, and its texts are read by as many as it has files and bytes for; a file that can't be read has null text."""
    write(tmp_path, {f"m{i}.py": f"import m{i}" for i in range(300)} | {"c.c": "x\n" * 100, "notes.txt": "no parser reads it"})
    (tmp_path / "gone.py").symlink_to(tmp_path / "m1.py")
    listing = tree.list_tree(spark, str(tmp_path), "demo")
    assert listing.rdd.getNumPartitions() == 1
    (tmp_path / "gone.py").unlink()
    files = tree.with_texts(listing, str(tmp_path))
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    texts = {r.path: r.text for r in files.collect()}
    assert len(texts) == 302 and texts["m7.py"] == "import m7" and texts["c.c"] == "x\n" * 50 and texts["notes.txt"] is None


LOCK = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1", "dev": True, "dependencies": {"b": {"version": "2", "dependencies": {"c": {}}}}}, "d": {"version": "3"}}}


def test_npm_version_1_and_install_metadata(spark):
    files = table(
        spark,
        {
            "p/package-lock.json": json.dumps(LOCK),
            "p/node_modules/a/package.json": '{"license": {"type": "MIT"}, "author": {"name": "A"}, "maintainers": ["x", {"name": "y"}], "repository": {"url": "u"}, "homepage": "h"}',
            "p/node_modules/d/package.json": '{"licenses": [{"type": "ISC"}], "author": "D", "repository": "r"}',
            "q/package-lock.json": "[]",
        },
    )
    found = {r.name: r for r in scan(files).components.collect()}
    assert {n: (r.version, r.is_dev, r.is_direct) for n, r in found.items()} == {"a": ("1", True, True), "b": ("2", False, False), "c": ("unknown", False, False), "d": ("3", False, True)}
    assert (found["a"].license, found["a"].author, found["a"].maintainers, found["a"].repository_url, found["a"].homepage_url) == ("MIT", "A", ["x", "y"], "u", "h")
    assert (found["d"].license, found["d"].author, found["d"].repository_url, found["b"].license) == ("ISC", "D", "r", None)


@pytest.mark.parametrize(
    "text,arch,want",
    [
        ("A_VERSION ?= 1\nB_LIB_VER := 2 # c\nC_VER=3\n# D_VERSION = 4\n", None, {"A_VERSION": "1", "B_LIB_VER": "2", "C_VER": "3"}),
        ("A_VERSION = 1\nifeq ($(ARCH),x)\nA_VERSION = 2\nelse\nB_VERSION = 3\nendif\n", None, {}),
        ("ifeq ($(ARCH),x)\nA_VERSION = 2\nendif\nA_VERSION = 1\n", None, {"A_VERSION": "1"}),
        ("A_VERSION = 1\nifeq ($(ARCH),x)\nA_VERSION = 2\nendif\nA_VERSION = $(B)\n", None, {"A_VERSION": "1"}),
        ("A_VERSION = 1\nifeq ($(ARCH),x)\nA_VERSION = 2\nelse\nA_VERSION = 3\nendif\n", "x", {"A_VERSION": "2"}),
        ("ifeq ($(ARCH),x)\nifeq ($(filter $(ARCH), y z), $(ARCH))\nA_VERSION = 2\nelse\nA_VERSION = 3\nendif\nelse\nA_VERSION = 4\nendif\n", "x", {"A_VERSION": "3"}),
        ("ifeq ($(ARCH),y)\nifeq ($(ARCH),x)\nA_VERSION = 2\nelse\nA_VERSION = 3\nendif\nendif\n", "x", {}),
        ("M_VERSION = q\nifeq (q,$(M_VERSION))\nA_VER = 1\nendif\nifeq (strange)\nB_VER = 1\nendif\n", "x", {"M_VERSION": "q", "A_VER": "1"}),
    ],
)
def test_makefile_variables(text, arch, want):
    assert manifests.mk_versions(text, arch) == want


def test_makefile_libraries_and_linked_versions(spark, tmp_path):
    write(
        tmp_path,
        {
            ".git/HEAD": "x",
            "app/Makefile": "LIBS = -lz -lfoo -lbar -lnone\n",
            "cfg/a.mk": "ZLIB_VERSION = 1.2\nFOO_PATCH_VERSION = 9\nGCC_VERSION = 8\nX_TOOLCHAIN_VER = 1\n",
            "cfg/b.mk": "ZLIB_VERSION = 1.3\n",
            "lib/libfoo.so.4.5.6": b"\x7fELF",
            "usr/lib/deep/libbar.so": b"\x01\x02abc version 7.8.9 x\x00",
            "elsewhere/libnone.so.1.0": b"",
        },
    )
    found = scan_tree(spark, str(tmp_path), "demo").components
    versions = {(r.ecosystem, r.name): (r.version, r.source_file) for r in found.collect()}
    assert versions["system", "z"][0] == "1.3" and versions["system", "z"][1].endswith("[version from .mk file: 1.3]")
    assert versions["system", "foo"][0] == "4.5.6" and versions["system", "bar"][0] == "7.8.9" and versions["system", "none"][0] == "unspecified"
    assert versions["BUILD-CONFIG", "zlib"][0] == "1.3" and not {"gcc", "x_toolchain", "foo_patch", "foo"} & {n for e, n in versions if e == "BUILD-CONFIG"}


def elf(name):
    """A 64-bit file with a dynamic section that names it."""
    names = b"\0" + name.encode() + b"\0"
    head, at = 64 + 2 * 56, 64 + 2 * 56 + len(names)
    dynamic = struct.pack("<qQqQqQ", 5, head, 14, 1, 0, 0)
    program = struct.pack("<IIQQQQQQ", 1, 4, 0, 0, 0, at + len(dynamic), at + len(dynamic), 1) + struct.pack("<IIQQQQQQ", 2, 4, at, at, at, len(dynamic), len(dynamic), 1)
    return b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 64, 0, 0, 64, 56, 2, 0, 0, 0) + program + names + dynamic


def test_sonames(tmp_path):
    assert native.soname(elf("libq.so.2.7")) == "libq.so.2.7" and native.soname(b"text") is None
    write(tmp_path, {"libq.so": elf("libq.so.2.7"), "libr.so": elf("libr.so") + b"\0about 3.2.1\0", "cut.so": elf("libq.so.2.7")[:100]})
    assert [native.so_version(str(tmp_path / f)) for f in ("libq.so", "libr.so", "cut.so")] == ["2.7", "3.2.1", None]


def index(entries):
    out = b"DIRC" + struct.pack(">II", 2, len(entries))
    for path, mode, sha in entries:
        entry = struct.pack(">10I", 0, 0, 0, 0, 0, 0, mode, 0, 0, 0) + bytes.fromhex(sha) + struct.pack(">H", len(path)) + path.encode()
        out += entry + b"\0" * (8 - len(entry) % 8)
    return out


def test_submodule_commits(spark, tmp_path):
    write(
        tmp_path,
        {
            ".gitmodules": '[submodule "s"]\n\tpath = libs/s\n\turl = https://github.com/o/s.git\n[submodule "odd"]\n\tpath = odd\n\turl = ../odd\n',
            ".git/index": index([("a.txt", 0o100644, "11" * 20), ("libs/s", 0o160000, "ab" * 20)]),
            "libs/s/.git": "gitdir: ../../.git/modules/s",
            "libs/s/.gitmodules": '[submodule "t"]\n\tpath = t\n\turl = git@github.com:g/t.git\n',
            ".git/modules/s/index": index([("t", 0o160000, "cd" * 20)]),
        },
    )
    found = {r.name: (r.version, r.repository_url) for r in scan_tree(spark, str(tmp_path), "demo").components.where("ecosystem = 'git-submodule'").collect()}
    assert found == {"o/s": ("ab" * 20, "https://github.com/o/s.git"), "odd": ("uninitialized", "../odd"), "g/t": ("cd" * 20, "git@github.com:g/t.git")}


ROS = {
    "a/package.xml": '<package><name>pa</name><version>0.1</version><maintainer email="m@x">Me</maintainer><depend>my-dep</depend><depend>shared</depend><test_depend>gtest_x</test_depend></package>',
    "a/setup.py": "setup(version='9', install_requires=['My_Dep>=2', 'only-python==1'])",
    "b/package.xml": "<package><name>pb</name><depend>shared</depend></package>",
    "b/setup.py": "setup(version='4')",
    "c/package.xml": "<package><name>none</name><depend>lost</depend></package>",
}


def test_ros_merge_and_documents(spark):
    found = scan(table(spark, ROS), imports=False)
    versions = {(r.ecosystem, r.name): r for r in found.components.collect()}
    assert versions["ros", "my-dep"].version == ">=2" and versions["ros", "shared"].version == "unspecified" and versions["ros", "pa"].maintainers == ["Me <m@x>"]
    packages = {r.package: r for r in found.ros.collect()}
    assert {p: r.version for p, r in packages.items()} == {"pa": "0.1", "pb": "4"}
    assert {d.name for d in packages["pa"].dependencies} >= {"my-dep", "shared", "gtest_x", "only-python"} and [d.name for d in packages["pb"].dependencies] == ["shared"]
    s = json.loads(bom.spdx_ros(found.ros, "2024-01-01T00:00:00Z").first().document)
    shared = [p for p in s["packages"] if p["name"] == "shared"]
    assert len(shared) == 1 and len(s["documentDescribes"]) == 2
    assert sum(r["relatedSpdxElement"] == shared[0]["SPDXID"] and r["relationshipType"] == "DEPENDS_ON" for r in s["relationships"]) == 2
    known = spark.createDataFrame([("python3-shared", "7", "u"), ("ros-jazzy-lost", "8", None)], "name string, version string, repository_url string")
    got = {r.name: (r.version, r.repository_url) for r in reconcile.resolve_ros_versions(found.components, known, "jazzy").where("ecosystem = 'ros'").collect()}
    assert got["shared"] == ("7", "u") and got["lost"] == ("8", None) and got["my-dep"] == (">=2", None)


def test_pip_report(spark):
    item = lambda n, v, *r: {"metadata": {"name": n, "version": v, "requires_dist": list(r)}}
    files = table(spark, {"requirements.txt": "Big.Lib==2\n", "pip-report.json": json.dumps({"install": [item("big-lib", "2", "child[x]>=1; y", "other"), item("child", "5"), item("Big_Lib", "3")]})})
    found = scan(files, imports=False)
    rows = {r.name: (r.version, r.is_direct, r.source) for r in manifests.components(files, False).where("source_file like '%transitive%'").collect()}
    assert rows == {"big-lib": ("2", True, "Manifest"), "child": ("5", False, "LockFile")}
    assert {(r.parent_id, r.child_name) for r in found.edges.collect()} == {("big-lib@2", "child"), ("big-lib@2", "other")}


def test_vendored_libraries(spark):
    files = table(
        spark,
        {
            "3rd_party/one/CMakeLists.txt": 'cmake_minimum_required(VERSION 3)\nproject("one" VERSION 1.2.3 LANGUAGES C)',
            "x/3rdparty/two/CMakeLists.txt": 'set(TWO_MAJOR_VERSION "4")\nset(TWO_MINOR_VERSION 5)\n',
            "3rd_party/three/CMakeLists.txt": "set(T_VERSION_MAJOR 6)",
            "3rd_party/plain/CMakeLists.txt": "add_library(plain)",
            "3rd_party/four/library.properties": "name=four\nversion=7.8\n",
            "3rd_party/five/five.c": None,
            "3rd_party/minizip-ng/a.h": "",
            "3rd_party/docs/a.c": "",
            "3rd_party/my_test/a.c": "",
            "3rd_party/empty/readme": "",
            "build/3rd_party/six/a.c": "",
        },
    )
    found = {r.name: r.version for r in manifests.vendored_libraries(files).collect()}
    assert found == {"one": "1.2.3", "two": "4.5", "three": "6", "plain": "unspecified", "four": "7.8", "five": "unspecified", "minizip": "unspecified"}


def test_autosar(spark):
    epd = "<A><ECUC-MODULE-DEF UUID='1'><SHORT-NAME>Adc</SHORT-NAME><X><REVISION-LABEL>4.2.0</REVISION-LABEL><REVISION-LABEL>9</REVISION-LABEL></X></ECUC-MODULE-DEF></A>"
    files = {
        "m/a.arxml": "<R><BSW-MODULE-DESCRIPTION><SHORT-NAME>Adc</SHORT-NAME></BSW-MODULE-DESCRIPTION><SERVICE-SW-COMPONENT-TYPE UUID='x'><SHORT-NAME>Svc</SHORT-NAME><P><SHORT-NAME>Port</SHORT-NAME></P></SERVICE-SW-COMPONENT-TYPE></R>",
        "m/a.epd": epd,
        "m/Gpt/Gpt.c": "/*\n * SW Version : 1.7.0\n */\n",
        "m/Late/x.h": "\n" * 60 + " * SW Version : 2\n",
        "Makefile": "L = -lGpt -lLate -lother\n",
    }
    got = {(r.ecosystem, r.name): r.version for r in scan(table(spark, files), modules=spark.createDataFrame([("svc", "Services", "CP")], "name string, layer string, platform string")).components.collect()}
    assert got == {("autosar", "Adc"): "4.2.0", ("autosar", "Svc"): "unspecified", ("autosar", "Gpt"): "1.7.0", ("system", "Late"): "unspecified", ("system", "other"): "unspecified"}
    trees = {"dir": {"SWC/x.txt": ""}, "var": {"sub/CMakeLists.txt": "set(AR_VERSION 4)"}, "deep": {"a/b/Makefile": "AR_VERSION = 4"}, "part": {"Makefile": "MY_AR_VERSIONS = 4", "bsw/x": ""}}
    every = [(p, path, t) for p, f in trees.items() for path, t in f.items()]
    assert {r.project for r in autosar.projects(spark.createDataFrame(every, FILES)).collect()} == {"dir", "var"}
    suppliers = spark.createDataFrame([("svc", "x"), ("Svc", "Big Co")], "key string, value string")
    scanned = scan(table(spark, files), modules=spark.createDataFrame([("Svc", "Services", "CP")], "name string, layer string, platform string")).components
    s = json.loads(bom.spdx(scanned, "2024-01-01T00:00:00Z", suppliers).first().document)
    refs = {p["name"]: [r["referenceLocator"] for r in p.get("externalRefs", []) if r["referenceType"] == "autosar-supplier"] for p in s["packages"]}
    assert refs["Svc"] == ["autosar:supplier=Big%20Co"] and refs["Adc"] == []


def test_component_dirs(spark):
    dirs = spark.createDataFrame([("p", d) for d in ("src/foo", "src/libbar", "src/LibBaz", "src/x", "other/foo")], "project string, path string")
    asked = spark.createDataFrame([("p", "src", n) for n in ("foo", "bar", "baz", "X", "gone")], "project string, parent string, name string")
    assert {r.name: r.dir for r in reconcile.component_dirs(asked, dirs).collect()} == {"foo": "src/foo", "bar": "src/libbar", "baz": "src/LibBaz", "X": "src/x", "gone": None}


def test_repository_roots(spark):
    files = table(spark, {"a/.git/HEAD": "", "a/b/package.json": "", "c/CMakeLists.txt": "", "c/d/Cargo.toml": ""})
    asked = spark.createDataFrame([("demo", d) for d in ("a/b/x", "a", "c/d/e", "c", "z", "")], "project string, dir string")
    assert {r.dir: r.repo for r in tree.repository_roots(files, asked).collect()} == {"a/b/x": "a", "a": "a", "c/d/e": "c/d", "c": "c", "z": "", "": ""}


def test_console_and_corrected_roots(spark):
    lock = {"packages": {"": {}, "node_modules/a": {"version": "1", "dependencies": {"b": "1"}}, "node_modules/b": {"version": "2", "dependencies": {"c": "1"}}, "node_modules/c": {"version": "3", "dev": True}, "node_modules/d": {"version": "4", "dev": True}}}
    found = scan(table(spark, {"package-lock.json": json.dumps(lock)}))
    assert {r.name: r.is_direct_graph for r in corrected(found).collect()} == {"a": True, "b": False, "c": False, "d": True}
    text = bom.console(found.components, "2024-01-01T00:00:00Z", found.edges).first().document
    assert "Dependencies:     4 total (1 direct, 2 transitive, 2 dev)" in text and "NPM (4 packages)" in text
    assert "  a@1\n    b@2\n      c@3" in text and "NPM: Development Dependencies\n  d@4" in text and "NPM: Other Transitive Dependencies\n  b@2" in text
    flat = bom.console(found.components, "2024-01-01T00:00:00Z", found.edges, "flat").first().document
    assert "  c @ 3 [dev]" in flat and "b@2" not in flat
