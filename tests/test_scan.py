import json

import pytest
from pyspark.sql import functions as F

from stocklens.plans.scan import scan
from stocklens.plans.tables import stored
from stocklens.sinks import bom
from stocklens.sources import manifests, tree

FILES = {
    "package.json": '{"dependencies": {"left-pad": "^1.0.0", "@a/b": "2"}, "devDependencies": {"jest": "29"}}',
    "sub/package-lock.json": json.dumps({"packages": {"": {}, "node_modules/x": {"version": "1.2", "integrity": "sha512-AA==", "dependencies": {"y": "1"}}, "node_modules/x/node_modules/y": {"version": "3"}}}),
    "yarn.lock": '"@s/p@^1.0.0":\n  version "1.0.1"\nq@1, q@2:\n  version "2.0.0"\n',
    "Cargo.toml": '[dependencies]\nserde = "1"\ntokio = { version = "1.2", features = ["full"] }\n',
    "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.9"\nchecksum = "ab"\ndependencies = ["serde_derive"]\n',
    "requirements.txt": "# c\nnumpy==1.26.0\nscipy>=1 # c\nrequests[socks]\n-r other.txt\n",
    "setup.py": "setup(install_requires=['six>=1.0'], extras_require={'dev': ['tox'], 'gui': ['qtpy']})",
    "p/poetry.lock": '[[package]]\nname = "attrs"\nversion = "23.1"\ncategory = "dev"\nfiles = [{hash = "sha256:ff"}]\n[package.dependencies]\nzope = "*"\n',
    "p/pyproject.toml": '[tool.poetry.dependencies]\nhidden = "1"\n',
    "q/pyproject.toml": '[project]\ndependencies = ["flask>=2"]\n',
    "Pipfile.lock": '{"default": {"idna": {"version": "==3.4", "index": "pypi", "hashes": ["sha256:cc"]}}, "develop": {"black": {"version": "==23"}}}',
    "go.mod": "module m\nrequire example.com/one v1.0.0\nrequire (\n\t// note here\n\texample.com/two v2.0.0 // indirect\n)\n",
    "Gemfile": "gem 'rails', '~> 7'\n gem \"puma\"\n",
    "composer.json": '{"require": {"php": ">=8", "ext-json": "*", "a/b": "^1"}, "require-dev": {"c/d": "2"}}',
    "pom.xml": "<project/>",
    "build.gradle": "// implementation 'no:no:1'\nimplementation 'g:a:1.0'\ntestImplementation group: 'h', name: 'b', version: '2'\nimplementation platform('p:bom:3')\n",
    "package.xml": "<package><name>me</name><version>0.1</version><license>BSD</license><depend>rclcpp</depend><test_depend>gtest_x</test_depend></package>",
    "CMakeLists.txt": 'FetchContent_Declare(fmt GIT_REPOSITORY https://github.com/f/fmt.git GIT_TAG 9.1.0)\nExternalProject_Add(zz URL "https://x.org/zz-1.2.3.tar.gz")\nFetchContent_Declare(v GIT_REPOSITORY ${URL})\n',
    "conanfile.txt": "[requires]\nboost/[1.80]\n[tool_requires]\ncmake/3.2\n",
    "r/conanfile.py": "class A:\n    requires = ['zlib/1.2.13']\n    def build(self):\n        self.test_requires('gtest/1.14')\n",
    "conan2/conan.lock": '{"requires": ["fmt/9.1#rev1%1"], "build_requires": ["ninja/1.11"]}',
    "vcpkg.json": '{"dependencies": ["zlib", {"name": "curl", "version>=": "8.0", "host": true}], "overrides": [{"name": "zlib", "version": "1.3"}]}',
    ".gitmodules": '[submodule "s"]\n\tpath = libs/s\n\turl = https://github.com/o/s.git\n[submodule "t"]\n\tpath = t\n',
    "auto/configure.ac": "AC_CHECK_LIB([m], [cos])\nPKG_CHECK_MODULES([G], [glib-2.0 >= 2.50 gio-2.0])\n",
    "auto/Makefile": "LIBS = -lhidden\n",
    "c/Makefile": "LIBS = -lz -lcrypto\nX = $(shell pkg-config --libs libfoo)\n",
    "c/foo.pc": "Name: foo\nVersion: 1.5\n",
    "c/v.mk": "FOO_BAR_VERSION := 1.4\nifeq ($(A),b)\nBAZ_VERSION = 2\nendif\n",
    "lib/library.json": '{"name": "esp", "version": "3", "license": "MIT"}',
    "meson.build": "dependency('glib', version: '>=2.0')\ncc.find_library('dl')\nsubproject('inner')\n",
    "subprojects/w.wrap": "[wrap-file]\ndirectory = w-1.9\nsource_url = https://x.org/w.tar.gz\n",
    "WORKSPACE": 'http_archive(name = "absl", urls = ["https://x.org/absl-2023.1.tar.gz"], sha256 = "aa")\n',
    "MODULE.bazel": 'bazel_dep(name = "rules_cc", version = "0.0.9")\nbazel_dep(name = "noversion")\n',
    "src/a.py": "import os\nimport numpy\nfrom . import b\nfrom yaml.nodes import x\n",
    "src/b.ts": "import a from 'react'\nimport './local'\nconst fs = require('fs'); const l = require('@x/y/z')\n",
    "src/c.go": 'import (\n\t"fmt"\n\t"github.com/o/r"\n)\n',
    "vendor/package.json": '{"dependencies": {"vendored": "1"}}',
    "bad/package.json": "{not json",
    "bad/Cargo.toml": "[[[",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("demo", p, t) for p, t in FILES.items()] + [("demo", "empty.mk", None)], "project string, path string, text string")


@pytest.fixture(scope="module")
def parsed(files):
    kept = tree.suppress_siblings(tree.filter_entries(files)).where("text is not null").withColumn("kind", manifests.kind_of(F.col("path")))
    return {(r.ecosystem, r.name, r.version) for r in manifests.components(stored(kept, "kind")).select("ecosystem", "name", "version").collect()}


@pytest.mark.parametrize(
    "row",
    [
        ("npm", "left-pad", "^1.0.0"), ("npm", "jest", "29"), ("npm", "x", "1.2"), ("npm", "y", "3"), ("npm", "@s/p", "1.0.1"), ("npm", "q", "2.0.0"),
        ("cargo", "tokio", "1.2"), ("cargo", "serde", "1.0.9"), ("pip", "numpy", "1.26.0"), ("pip", "scipy", "unspecified"), ("pip", "requests", "unspecified"),
        ("pip", "six", ">=1.0"), ("pip", "tox", "unspecified"), ("pip", "attrs", "23.1"), ("pip", "flask", ">=2"), ("pip", "idna", "3.4"), ("go", "example.com/one", "v1.0.0"), ("go", "example.com/two", "v2.0.0"),
        ("rubygems", "rails", "~> 7"), ("rubygems", "puma", "unspecified"), ("composer", "a/b", "^1"), ("maven", "g:a", "1.0"), ("maven", "h:b", "2"), ("maven", "p:bom", "3"),
        ("ros", "me", "0.1"), ("ros", "rclcpp", "unspecified"), ("cmake", "fmt", "9.1.0"), ("cmake", "zz", "1.2.3"), ("conan", "boost", "1.80"), ("conan", "zlib", "1.2.13"), ("conan", "gtest", "1.14"), ("conan", "fmt", "9.1"),
        ("vcpkg", "zlib", "1.3"), ("vcpkg", "curl", "8.0"), ("git-submodule", "o/s", "uninitialized"), ("autotools", "m", "unspecified"), ("pkg-config", "glib-2.0", "2.50"), ("pkg-config", "gio-2.0", "unspecified"),
        ("system", "z", "unspecified"), ("pkg-config", "libfoo", "unspecified"), ("pkg-config", "foo", "1.5"), ("BUILD-CONFIG", "foo_bar", "1.4"), ("vendored", "esp", "3"),
        ("meson", "glib", "2.0"), ("system", "dl", "unspecified"), ("meson-subproject", "inner", "subproject"), ("meson-wrap", "w", "1.9"), ("bazel", "absl", "2023.1"), ("bazel-bzlmod", "rules_cc", "0.0.9"),
        ("pip", "numpy", "detected"), ("pip", "yaml", "detected"), ("npm", "react", "detected"), ("npm", "@x/y", "detected"), ("go", "github.com/o/r", "detected"),
    ],
)
def test_found(parsed, row):
    assert row in parsed


def test_left_out(parsed):
    names = {n for _, n, _ in parsed}
    assert not names & {"hidden", "vendored", "php", "ext-json", "no:no", "v", "t", "baz", "noversion", "os", "fs", "fmt.go", "//", "qtpy", ""}


def test_edges(files):
    found = {(r.parent_id, r.child_name) for r in manifests.edges(files).collect()}
    assert found == {("x@1.2", "y"), ("serde@1.0.9", "serde_derive"), ("attrs@23.1", "zope")}


def test_scan_and_documents(spark, files):
    found = stored(scan(files.unionByName(files.withColumn("project", F.lit("other")))).components)
    one = {(r.ecosystem, r.name, r.version) for r in found.where("project = 'demo'").collect()}
    assert one == {(r.ecosystem, r.name, r.version) for r in found.where("project = 'other'").collect()}
    assert ("pip", "numpy", "1.26.0") in one and ("pip", "numpy", "detected") not in one
    assert {r.scope for r in found.where("name = 'jest'").collect()} == {"Development"}
    documents = {name: {r.project: r.document for r in make(found, "2024-01-01T00:00:00Z").collect()} for name, make in bom.FORMATS.items()}
    s, c = json.loads(documents["spdx"]["demo"]), json.loads(documents["cyclonedx"]["demo"])
    assert len(s["packages"]) - 1 == len(c["components"]) == len(one) == len(c["dependencies"][0]["dependsOn"])  # the project itself is a package of SPDX
    assert s["documentDescribes"] == ["SPDXRef-Package-root-demo"] and sum(r["relationshipType"] == "CONTAINS" for r in s["relationships"]) == len(one)
    assert next(p for p in s["packages"] if p["name"] == "rails")["externalRefs"][0]["referenceLocator"] == "pkg:gem/rails@~> 7"
    assert "PackageName: rails" in documents["spdx-tv"]["demo"] and "| rails |" in documents["markdown"]["demo"]


def test_tree(spark, tmp_path):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "src" / "loop").symlink_to(tmp_path / "src")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    rows = tree.read_tree(spark, str(tmp_path), "demo").where("not is_dir").select("path", "text").collect()
    assert {r.path: r.text for r in rows} == FILES


def test_large_files(spark, tmp_path):
    """Lock files and manifests above 1 MiB are read whole and suppress their manifests; only imports have the cap."""
    many = range(12_000)
    texts = {
        "a/package-lock.json": json.dumps({"packages": {f"node_modules/n{i}": {"version": "1.0", "integrity": "sha512-" + "A" * 40, "dependencies": {"y": "1"}} for i in many}}),
        "b/yarn.lock": "".join(f'y{i}@^1.0.0:\n  version "1.0.1"\n  resolved "https://registry.yarnpkg.com/y{i}/-/y{i}-1.0.1.tgz#0123456789"\n\n' for i in many),
        "c/poetry.lock": "".join(f'[[package]]\nname = "t{i}"\nversion = "2.0"\nfiles = [{{hash = "sha256:{"f" * 64}"}}]\n\n' for i in many),
        "c/pyproject.toml": '[tool.poetry.dependencies]\nhidden = "1"\n',
        "d/big.py": "import bigimport\n" + "#" * (1 << 20),
        "d/setup.py": "import bigsetup\nsetup(install_requires=['six>=1.0'])\n" + "#" * (1 << 20),
        "d/data.bin": "0" * (2 << 20),
    }
    for p, t in texts.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
        assert len(t) > 1 << 20 or p == "c/pyproject.toml"
    files = tree.read_tree(spark, str(tmp_path), "demo")
    assert {r.path for r in files.where("not is_dir and text is null").collect()} == {"d/big.py", "d/data.bin"}
    found = scan(files)
    names = {r.name for r in found.components.select("name").collect()}
    assert {f"{c}{i}" for c in "nyt" for i in many} <= names and "six" in names
    assert not names & {"hidden", "bigimport", "bigsetup"}
    assert found.edges.count() == len(many)


def test_vendor_modes(files):
    assert {r.path for r in tree.filter_entries(files, "only").collect()} == {"vendor/package.json"}
    assert tree.filter_entries(files, "include", ["src"]).where("path like 'src/%'").count() == 0
    with pytest.raises(ValueError):
        tree.filter_entries(files, "some")


def test_streaming_merge(spark, files, tmp_path):
    from stocklens.streaming.manifests import current, follow

    files.where("path = 'package.json'").write.parquet(str(tmp_path / "in"))
    follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {r.name for r in current(spark, str(tmp_path / "out")).collect()} == {"left-pad", "@a/b", "jest"}
