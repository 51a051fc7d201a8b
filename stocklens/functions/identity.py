"""Package URLs, CPE names, download places and other strings derived from a component; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import contains_any, version_known

#: Parts of URLs that aren't repositories, ecosystems with their package-URL types, and suppliers by ecosystem.
ARCHIVE_PARTS = ["/releases/download/", "/archive/", "/download/"]
ARCHIVE_ENDS = [".tar.gz", ".tgz", ".zip", ".tar.bz2", ".tar.xz"]
PAGE_PARTS = ["/tree/", "/blob/", "/raw/", "/commit/", "/commits/", "/issues/", "/pull/", "/pulls/", "/merge_requests/", "/compare/", "/releases/", "/tags/"]
PLAIN_TYPES = {"npm": "npm", "npm (dev)": "npm", "cargo": "cargo", "pip": "pypi", "go": "golang", "rubygems": "gem", "composer": "composer", "maven": "maven", "ros": "ros", "vcpkg": "vcpkg", "conan": "conan"}
TYPED = ["pkg-config", "autotools", "system", "autosar", "vendored", "micropython", "meson", "meson-subproject"]
SUPPLIERS = {"npm": "npmjs", "pip": "pypi", "cargo": "crates.io", "go": "go modules", "ros": "ROS", "php": "packagist", "ruby": "rubygems"}


def _ends(c: Column, ends: list[str]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | c.endswith(e)
    return out


def is_git_url(url: Column) -> Column:
    """True if a URL is that of a repository rather than of an archive or a page in one."""
    u = F.trim(url)
    bare = F.rtrim(F.regexp_replace(u, "^(https://)*(http://)*", ""), F.lit("/"))
    parts = F.split(bare, "/")
    last = F.element_at(parts, -1)
    web = u.startswith("http://") | u.startswith("https://")
    return (
        F.when(u.startswith("git@") | u.endswith(".git"), True)
        .when(contains_any(u, ARCHIVE_PARTS) | _ends(u, ARCHIVE_ENDS), False)
        .when(~web | contains_any(bare, PAGE_PARTS) | (F.size(parts) < 3), False)
        .when(last.contains(".") & ~_ends(last, [".git", ".io"]), False)
        .otherwise(F.size(parts) <= 5)
    )


def host_type(host: Column) -> Column:
    low = F.lower(host)
    return F.when(low.contains("github.com") | (low == "github"), "github").when(low.contains("gitlab"), "gitlab").when(low.contains("bitbucket"), "bitbucket").otherwise("generic")


def git_parts(url: Column) -> Column:
    """struct(host_type, owner, repo) of an ssh or http(s) repository URL; owner keeps nested groups. Null if it is neither."""
    u = F.regexp_replace(F.trim(url), r"(\.git)+$", "")
    ssh, web = F.split(u, ":"), F.split(F.regexp_replace(u, "^(https://)*(http://)*", ""), "/")
    path = F.split(F.get(ssh, F.lit(1)), "/")
    told = lambda host, owner, repo: F.struct(host_type(host).alias("host_type"), F.array_join(owner, "/").alias("owner"), repo.alias("repo"))
    by_ssh = F.when((F.size(ssh) == 2) & (F.size(path) >= 2), told(F.regexp_replace(F.get(ssh, F.lit(0)), "^(git@)+", ""), F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.get(path, F.size(path) - 1)))
    by_web = F.when(F.size(web) >= 3, told(F.get(web, F.lit(0)), F.slice(web, F.lit(2), F.greatest(F.size(web) - 2, F.lit(0))), F.get(web, F.size(web) - 1)))
    return F.when(u.startswith("git@"), by_ssh).when(u.startswith("http://") | u.startswith("https://"), by_web)


def huggingface_parts(url: Column) -> Column:
    """struct(namespace, name) of a model's page or file; null for datasets, spaces and other places."""
    clean = F.rtrim(F.regexp_replace(url, r"(?s)[?#].*$", ""), F.lit("/"))
    path = F.regexp_extract(clean, r"^(?:https?://huggingface\.co/|hf://)(.*)$", 1)
    parts = F.split(path, "/")
    ok = (path != "") & (F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).isin("datasets", "spaces")
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("namespace"), F.get(parts, F.lit(1)).alias("name")))


def _with_version(base: Column, version: Column, suffix: str = "") -> Column:
    return F.concat(base, F.when(version_known(version), F.concat(F.lit("@"), version)).otherwise(""), F.lit(suffix))


def purl(name: Column, version: Column, ecosystem: Column, repository_url: Column) -> Column:
    """Package URL; the version is left out where it is unknown, and nothing is percent-encoded."""
    git = git_parts(repository_url)
    repo = lambda: F.concat(F.lit("pkg:"), git["host_type"], F.lit("/"), git["owner"], F.lit("/"), git["repo"])
    generic = F.concat(F.lit("pkg:generic/"), name)
    is_git = F.coalesce(is_git_url(repository_url), F.lit(False)) & git.isNotNull()
    hub = F.when(repository_url.contains("huggingface.co"), huggingface_parts(repository_url))
    hub_url = F.concat(F.lit("pkg:huggingface/"), hub["namespace"], F.lit("/"), hub["name"])
    out = F.lit("generic")
    for eco, kind in PLAIN_TYPES.items():
        out = F.when(ecosystem == eco, F.lit(kind)).otherwise(out)
    value = _with_version(F.concat(F.lit("pkg:"), out, F.lit("/"), name), version)
    for eco in TYPED:
        value = F.when(ecosystem == eco, _with_version(generic, version, f"?type={eco}")).otherwise(value)
    for ecos, kind in ((["meson-wrap"], "meson-wrap"), (["bazel", "bazel-bzlmod"], "bazel")):
        value = F.when(ecosystem.isin(ecos), F.when(is_git, _with_version(repo(), version, f"?type={kind}")).otherwise(_with_version(generic, version, f"?type={kind}"))).otherwise(value)
    value = F.when(ecosystem == "cmake", F.when(is_git, _with_version(repo(), version)).otherwise(_with_version(generic, version))).otherwise(value)
    value = F.when(ecosystem == "git-submodule", F.when(git.isNotNull(), _with_version(repo(), version)).otherwise(_with_version(generic, version))).otherwise(value)
    value = F.when(ecosystem == "gguf", F.when(hub.isNotNull(), _with_version(hub_url, version)).otherwise(_with_version(generic, version, "?type=gguf"))).otherwise(value)
    own = F.when(name.contains("/"), _with_version(F.concat(F.lit("pkg:huggingface/"), name), version)).otherwise(_with_version(generic, version, "?type=safetensors"))
    return F.when(ecosystem == "safetensors", F.when(hub.isNotNull(), _with_version(hub_url, version)).otherwise(own)).otherwise(value)


def _under(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("_"))


def cpe_vendor(name: Column, ecosystem: Column) -> Column:
    parts = F.split(name, "/")
    scope = F.regexp_replace(F.get(parts, F.lit(0)), "^@+", "")
    return (
        F.when((ecosystem == "npm") & name.startswith("@"), _under(scope))
        .when(ecosystem == "npm", "npm")
        .when(ecosystem == "cargo", "rust")
        .when(ecosystem == "pip", "python")
        .when(ecosystem == "rubygems", "ruby")
        .when(ecosystem == "composer", _under(F.get(parts, F.lit(0))))
        .when(ecosystem == "go", _under(F.coalesce(F.get(parts, F.lit(1)), F.lit("go"))))
        .otherwise(_under(ecosystem))
    )


def cpe_product(name: Column) -> Column:
    parts = F.split(name, "/")
    part = F.when(name.startswith("@"), F.coalesce(F.get(parts, F.lit(1)), name)).otherwise(F.element_at(parts, -1))
    return F.replace(_under(part), F.lit("."), F.lit("_"))


def cpe_version(version: Column) -> Column:
    return _under(F.regexp_replace(version, "^\\^*~*(>=)*(<=)*>*<*=*", ""))


def cpe23(name: Column, version: Column, ecosystem: Column) -> Column:
    """CPE 2.3 name; null where the version is unknown."""
    return F.when(version_known(version), F.concat(F.lit("cpe:2.3:a:"), cpe_vendor(name, ecosystem), F.lit(":"), cpe_product(name), F.lit(":"), cpe_version(version), F.lit(":*:*:*:*:*:*:*")))


def download_location(name: Column, version: Column, ecosystem: Column, repository_url: Column) -> Column:
    last = F.element_at(F.split(name, "/"), -1)
    none = F.lit("NOASSERTION")
    place = (
        F.when(ecosystem == "npm", F.concat(F.lit("https://registry.npmjs.org/"), name, F.lit("/-/"), last, F.lit("-"), version, F.lit(".tgz")))
        .when(ecosystem == "pip", F.concat(F.lit("https://pypi.org/project/"), name, F.lit("/"), version, F.lit("/")))
        .when(ecosystem == "cargo", F.concat(F.lit("https://crates.io/api/v1/crates/"), name, F.lit("/"), version, F.lit("/download")))
        .when(ecosystem.isin("go", "ros"), F.coalesce(repository_url, none))
        .when(ecosystem == "php", F.concat(F.lit("https://packagist.org/packages/"), name))
        .when(ecosystem == "ruby", F.concat(F.lit("https://rubygems.org/gems/"), name))
        .otherwise(none)
    )
    return F.when(version_known(version), place).otherwise(none)


def supplier(ecosystem: Column) -> Column:
    out = F.lit(None).cast("string")
    for eco, org in SUPPLIERS.items():
        out = F.when(ecosystem == eco, f"Organization: {org}").otherwise(out)
    return out


def originator(author: Column) -> Column:
    org = author.contains("Team") | author.contains("Foundation") | author.contains("Inc")
    person = author.contains("@") | author.contains("<") | ~org
    return F.when(author.startswith("Person:") | author.startswith("Organization:"), author).when(person, F.concat(F.lit("Person: "), author)).otherwise(F.concat(F.lit("Organization: "), author))


def spdx_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9.-]", "-")


def version_info(version: Column) -> Column:
    return F.when(version_known(version), version).otherwise("NOASSERTION")


def spdx_purpose(scope: Column, is_model: Column) -> Column:
    return F.when(is_model | scope.isin("Build", "Test", "Development"), "OTHER").otherwise("LIBRARY")


def python_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "_")


def python_root(module: Column) -> Column:
    return F.get(F.split(module, r"\."), F.lit(0))


def js_root(module: Column) -> Column:
    parts = F.split(module, "/")
    return F.when(module.startswith("@") & (F.size(parts) >= 2), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.when(module.startswith("@"), module).otherwise(F.get(parts, F.lit(0))))


def source_info(extractor: Column, path: Column, compact: bool = False) -> Column:
    return F.concat(extractor, F.lit(":"), path) if compact else F.concat(F.lit("Identified by the "), extractor, F.lit(" extractor from "), path)
