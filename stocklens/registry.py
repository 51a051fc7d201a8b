"""Named queries over the driver's tables and their SQL equivalents.

The tables hold no manifests, so each query applies an operator to a projection of them. The projections are given twice, as
DataFrame code here and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_branches, registry_documents, registry_files
from .functions import dictionaries, identity
from .operators import classify, graph, reconcile, stats
from .plans.tables import stored
from .schema import as_components, version_known

ECOSYSTEMS = {"STANDARD": "npm", "ECONOMY": "system", "MEDIUM": "BUILD-CONFIG", "SMALL": "VENDORED", "LARGE": "pkg-config", "PROMO": "autosar"}
SOURCES = {"A": "LockFile", "N": "Manifest", "R": "ImportScan"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def choose(column, table: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components made of line items and their parts."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    base = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("lib"), base)).when(F.col("p_size") % 11 == 0, F.upper(base)).when(F.col("p_size") % 13 == 0, F.concat(base, F.lit("-dev"))).otherwise(base)
    version = F.when(F.col("p_size") % 5 == 0, "unspecified").otherwise(F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("p_size").cast("string")))
    order = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 10, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    folder = F.when(F.col("l_suppkey") % 5 == 0, "/src/tests/").when(F.col("l_suppkey") % 5 == 1, "/src/tools/").when(F.col("l_suppkey") % 5 == 2, "/src/build/").otherwise("/src/main/")
    return as_components(
        rows,
        name=name,
        version=version,
        ecosystem=choose(F.col("p_type"), ECOSYSTEMS),
        source=choose(F.col("l_returnflag"), SOURCES),
        is_dev=F.col("l_linestatus") == "F",
        is_direct=F.col("l_linenumber") <= 3,
        source_file=F.concat(folder, order),
    )


COMP_SQL = """
comp0 as (
  select replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '')) as base, p_size, p_type, l_returnflag, l_linestatus, l_linenumber, l_suppkey,
    lpad(l_orderkey::varchar, 10, '0') || '/' || lpad(l_linenumber::varchar, 10, '0') || '/' || lpad(l_partkey::varchar, 10, '0') || '/' || lpad(l_suppkey::varchar, 10, '0') as place
  from lineitem join part on l_partkey = p_partkey),
comp as (
  select case when p_size % 7 = 0 then 'lib' || base when p_size % 11 = 0 then upper(base) when p_size % 13 = 0 then base || '-dev' else base end as name,
    case when p_size % 5 = 0 then 'unspecified' else l_linenumber::varchar || '.' || p_size::varchar end as version,
    case p_type when 'STANDARD' then 'npm' when 'ECONOMY' then 'system' when 'MEDIUM' then 'BUILD-CONFIG' when 'SMALL' then 'VENDORED' when 'LARGE' then 'pkg-config' else 'autosar' end as ecosystem,
    case l_returnflag when 'A' then 3 when 'N' then 2 else 1 end as source_rank,
    l_linestatus = 'F' as is_dev, l_linenumber <= 3 as is_direct,
    case l_suppkey % 5 when 0 then '/src/tests/' when 1 then '/src/tools/' when 2 then '/src/build/' else '/src/main/' end || place as source_file
  from comp0),
dedup as (
  select * from comp qualify row_number() over (partition by name, version, ecosystem order by source_rank desc, source_file) = 1)"""
CHAIN_SQL = f"""{COMP_SQL},
ranked as (select d.* from dedup d where not exists (select 1 from dedup o where o.name = d.name and o.ecosystem = d.ecosystem and o.source_rank > d.source_rank)),
versioned as (select * from ranked r where version <> 'unspecified' or not exists (select 1 from ranked o where o.name = r.name and o.ecosystem = r.ecosystem and o.version <> 'unspecified')),
step1 as (select * from versioned where ecosystem <> 'BUILD-CONFIG' or name not in (select name from versioned where ecosystem = 'system')),
step2 as (select * from step1 where ecosystem <> 'VENDORED' or name not in (select name from step1 where ecosystem = 'BUILD-CONFIG')),
step3 as (select * from step2 where ecosystem <> 'system' or lower(name) not in (select lower(name) from step2 where ecosystem = 'pkg-config')),
chain as (select * from step3 where ecosystem <> 'system' or name not in (select name from step3 where ecosystem = 'autosar'))"""


def sql_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _tool_case(entries, form: str) -> str:
    """SQL that gives the first matching entry of a name list."""
    tests = {"tool": "low = '{e}' or starts_with(low, '{e}-') or starts_with(low, '{e}_')", "c": "low in ('{e}', 'lib{e}')", "lib": "low = '{e}' or starts_with(low, 'lib{e}') or starts_with(low, '{e}-')"}[form]
    return "case " + " ".join(f"when {tests.format(e=e)} then '{e}'" for e in entries) + " end"


def _any(column: str, parts) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in parts) + ")"


CLASSIFY_SQL = f"""{CHAIN_SQL},
named as (
  select *, lower(name) as low, lower(ecosystem) as eco, lower(source_file) as place from chain),
entries as (
  select *, {_tool_case(classify.TEST_FRAMEWORKS, "tool")} as t1, {_tool_case(classify.BUILD_TOOLS, "tool")} as t2, {_tool_case(classify.DEV_TOOLS, "tool")} as t3,
    {_tool_case(classify.SANITIZERS, "tool")} as t4, {_tool_case(classify.C_LIBRARIES, "c")} as t5, {_tool_case(classify.RUNTIME_LIBRARIES, "lib")} as t6 from named),
ruled as (
  select *, case
    when eco = 'npm' and is_dev then 'Development|1|package.json devDependencies'
    when eco in ('meson-wrap', 'meson-subproject') then 'Build|0.8|Meson build dependency'
    when eco = 'git-submodule' then 'Provided|0.7|Source code submodule'
    when eco = 'vendored' then 'Runtime|0.9|Vendored 3rd-party library'
    when eco = 'build-config' then 'Build|0.6|BUILD-CONFIG package - Build dependency pending link analysis'
    when t1 is not null then 'Test|1|Test framework: ' || t1
    when t2 is not null then 'Build|1|Build tool: ' || t2
    when t3 is not null then 'Development|1|Development tool: ' || t3
    when t4 is not null then 'Development|1|Sanitizer tool: ' || t4
    when t5 is not null then 'Provided|1|Standard C library: ' || t5
    when t6 is not null then 'Runtime|0.9|Known runtime library: ' || t6
    when ends_with(low, '-dev') or ends_with(low, '-devel') then 'Development|0.7|Package name ends with -dev/-devel'
    when starts_with(low, 'test-') or ends_with(low, '-test') then 'Test|0.7|Package name contains ''test'''
    when {_any("place", classify.TEST_DIRS[:3])} then 'Test|0.7|Found in test directory'
    when ecosystem <> 'BUILD-CONFIG' and {_any("place", classify.BUILD_DIRS[:6])} then 'Build|0.7|Found in build directory'
    when {_any("place", classify.DEV_DIRS[:6])} then 'Development|0.7|Found in development directory'
    else 'Runtime|0.3|Default (no match)' end as told from entries),
classified as (
  select name, version, ecosystem, source_rank, is_dev, is_direct, source_file, split_part(told, '|', 1) as scope, split_part(told, '|', 2)::double as scope_confidence, split_part(told, '|', 3) as scope_reason from ruled)"""

KEYS = ["name", "version", "ecosystem", "source_rank", "is_dev", "is_direct", "source_file"]
SCOPED = [*KEYS, "scope", "scope_confidence", "scope_reason"]


def classified(spark, sf_dir) -> DataFrame:
    return classify.classify(reconcile.reconcile(comp(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read three times, so it is written once.
    return reconcile.refine_by_links(stored(classified(spark, sf_dir))).select(SCOPED)


# Nodes and edges: a heap-shaped tree over part keys, with some edges back to the top that make cycles.
def graph_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    label = lambda k: F.concat(F.lit("p"), k.cast("string"))
    nodes = as_components(parts, name=label(key), version=F.col("p_size").cast("string"), ecosystem=F.lit("npm"), is_direct=key <= 3, ordinal=key)
    above = parts.select(key.alias("child"), F.expr("p_partkey div 4").alias("k")).where("k > 0")
    back = parts.where("p_partkey % 97 = 0").select(F.lit(1).cast("long").alias("child"), key.alias("k"))
    found = above.unionByName(back).join(parts.select(key.alias("k"), F.col("p_size").cast("string").alias("v")), "k")
    edges = found.select(F.lit("x").alias("project"), F.concat(label(F.col("k")), F.lit("@"), F.col("v")).alias("parent_id"), label(F.col("child")).alias("child_name"), F.col("child").cast("int").alias("ord"))
    return nodes, edges


GRAPH_SQL = """
nodes as (select p_partkey as k, 'p' || p_partkey as name, 'p' || p_partkey || '@' || p_size as id, p_partkey <= 3 as is_direct from part),
links as (select p_partkey // 4 as parent, p_partkey as child from part where p_partkey // 4 > 0 union all select p_partkey, 1 from part where p_partkey % 97 = 0),
resolved as (select a.id as parent, b.id as child, min(l.child)::int as ord from links l join nodes a on a.k = l.parent join nodes b on b.k = l.child group by all)"""


def unfolded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph_tables(spark, sf_dir)
    resolved = graph.resolve_edges(nodes, edges)
    roots = graph.node_ids(nodes).where("is_direct").select(F.col("id").alias("root"))
    return graph.unfold(roots, resolved), resolved


def graph_chains(spark, sf_dir) -> DataFrame:
    """All chains, of any length."""
    nodes, edges = graph_tables(spark, sf_dir)
    ids = graph.node_ids(nodes)
    roots = ids.where("is_direct").select(F.col("id").alias("root"))
    return graph.all_chains(ids.select(F.col("id").alias("target")), roots, graph.resolve_edges(nodes, edges), text=True).withColumnRenamed("path", "chain")


def graph_chains_to(spark, sf_dir) -> DataFrame:
    """Chains to every hundredth node."""
    nodes, edges = graph_tables(spark, sf_dir)
    ids = graph.node_ids(nodes)
    targets, roots = ids.where("ordinal % 100 = 0").select(F.col("id").alias("target")), ids.where("is_direct").select(F.col("id").alias("root"))
    return graph.chains_to(targets, roots, graph.resolve_edges(nodes, edges), text=True).withColumnRenamed("path", "chain")


UNFOLD_SQL = f"""with recursive {GRAPH_SQL},
tree(root, node, depth, path, cyclic) as (
  select id, id, 0, [id], false from nodes where is_direct
  union all
  select t.root, r.child, t.depth + 1, list_append(t.path, r.child), list_contains(t.path, r.child) from tree t join resolved r on r.parent = t.node where t.depth < 5 and not t.cyclic)"""


# Chains have no depth, so their paths are unfolded until none grows.
CHAINS_SQL = UNFOLD_SQL.replace(" where t.depth < 5 and not t.cyclic", " where not t.cyclic")


def pages(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    git = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("git@github.com:group/"), F.col("page_id").cast("string"), F.lit(".git"))).when(F.col("page_id") % 4 == 1, F.concat(F.col("url"), F.lit("/archive/x.tar.gz"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://gitlab.com/a/b/r"), F.col("page_id").cast("string"), F.lit(".git"))).otherwise(F.col("url"))
    return p.select("page_id", git.alias("repository_url"))


PAGES_SQL = """
repos as (select page_id, case page_id % 4 when 0 then 'git@github.com:group/' || page_id || '.git' when 1 then url || '/archive/x.tar.gz' when 2 then 'https://gitlab.com/a/b/r' || page_id || '.git' else url end as repository_url from pages)"""


def git_urls(spark, sf_dir):
    g = identity.git_parts(F.col("repository_url"))
    return pages(spark, sf_dir).select("page_id", identity.is_git_url(F.col("repository_url")).alias("is_git"), g["host_type"].alias("host_type"), g["owner"].alias("owner"), g["repo"].alias("repo"))


GIT_SQL = f"""with {PAGES_SQL},
bare as (select *, regexp_replace(repository_url, '^https?://', '') as rest, regexp_replace(repository_url, '\\.git$', '') as cut from repos),
parts as (select *, string_split(rtrim(rest, '/'), '/') as p, string_split(regexp_replace(cut, '^https?://', ''), '/') as w, string_split(split_part(cut, ':', 2), '/') as s from bare)
select page_id,
  case when starts_with(repository_url, 'git@') or ends_with(repository_url, '.git') then true
    when contains(repository_url, '/archive/') or ends_with(repository_url, '.tar.gz') then false
    when len(p) < 3 then false when contains(p[-1], '.') and not ends_with(p[-1], '.io') then false else len(p) <= 5 end as is_git,
  case when starts_with(repository_url, 'git@') then 'github' when len(w) < 3 then null when contains(lower(w[1]), 'gitlab') then 'gitlab' else 'generic' end as host_type,
  case when starts_with(repository_url, 'git@') then array_to_string(s[:len(s) - 1], '/') when len(w) >= 3 then array_to_string(w[2:len(w) - 1], '/') end as owner,
  case when starts_with(repository_url, 'git@') then s[-1] when len(w) >= 3 then w[-1] end as repo
from parts"""


def licenses(spark, sf_dir):
    found = F.regexp_extract("text", r"(Apache License, Version 2\.0|MIT License)", 1)
    docs = read(spark, sf_dir, "documents").select("doc_id", found.alias("found")).where("found <> ''")
    spelt = F.when(F.col("found") == "MIT License", "MIT").otherwise(F.col("found"))
    lic = dictionaries.ros_license(spelt)
    return docs.select("doc_id", lic.alias("license"), dictionaries.is_known_spdx(lic).alias("known"), dictionaries.model_license(F.lower(lic)).alias("normalised"))


LICENSES_SQL = """
select doc_id, case when contains(x, 'MIT') then 'MIT' else 'Apache-2.0' end as license, true as known, case when contains(x, 'MIT') then 'MIT' else 'Apache-2.0' end as normalised
from (select doc_id, regexp_extract(text, '(Apache License, Version 2\\.0|MIT License)', 1) as x from documents) where x <> ''"""


def autosar(spark, sf_dir):
    """Components joined to a dictionary of modules, case-insensitively."""
    modules = read(spark, sf_dir, "part").where("p_size % 17 = 0").select(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("name")).distinct().select("name", F.lit("Services").alias("layer"), F.lit("CP").alias("platform"))
    got = classify.classify_autosar(reconcile.dedup_priority(comp(spark, sf_dir)), modules)
    return got.select("name", "version", "ecosystem", F.col("autosar.module_name").alias("module"), F.col("autosar.layer").alias("layer"))


AUTOSAR_SQL = f"""with {COMP_SQL},
modules as (select distinct replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '')) as module from part where p_size % 17 = 0)
select name, version, case when module is null then ecosystem else 'autosar' end as ecosystem, module, case when module is not null then 'Services' end as layer
from dedup left join modules on lower(name) = lower(module)"""


def supplier_lookup(spark, sf_dir):
    """Suppliers with the region of their nation, from small dictionaries; nations of one region have no entry and take the default."""
    regions = read(spark, sf_dir, "region")
    names = read(spark, sf_dir, "nation").where("n_regionkey <> 0").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("r_name").alias("value"))
    return reconcile.lookup(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, F.col("s_nationkey"), "supplier", "NOASSERTION")


SUPPLIER_SQL = """
select s_suppkey, s_nationkey, coalesce(r_name, 'NOASSERTION') as supplier
from supplier left join (nation join region on n_regionkey = r_regionkey and n_regionkey <> 0) on s_nationkey = n_nationkey"""


def versions(spark, sf_dir):
    """'unspecified' versions filled from two tables of candidates, makefile variables before shared objects."""
    c = reconcile.dedup_priority(comp(spark, sf_dir))
    src = comp(spark, sf_dir).where("version <> 'unspecified'")
    of = lambda eco: src.where(F.col("ecosystem") == eco).groupBy(F.col("name").alias("candidate")).agg(F.max("version").alias("version"))
    return reconcile.resolve_versions(c, reconcile.library_candidates(F.col("name")), of("BUILD-CONFIG"), of("pkg-config")).select("name", "version", "ecosystem", "source_rank")


VERSIONS_SQL = f"""with {COMP_SQL},
names as (select distinct name from dedup where version = 'unspecified'),
bases as (select name, regexp_replace(name, '^(lib)+', '') as base from names),
candidates as (select distinct name, unnest([name, base, 'lib' || base]) as c from bases where base <> ''),
placed as (select name, c, row_number() over (partition by name order by c) as pos from candidates),
known as (
  select name as c, max(version) as found, 0 as src from comp where version <> 'unspecified' and ecosystem = 'BUILD-CONFIG' group by name
  union all select name, max(version), 1 from comp where version <> 'unspecified' and ecosystem = 'pkg-config' group by name),
best as (select name, found from placed join known using (c) qualify row_number() over (partition by name order by pos, src) = 1)
select d.name, case when d.version = 'unspecified' then coalesce(found, d.version) else d.version end as version, ecosystem, source_rank
from dedup d left join best b on b.name = d.name"""


def sibling_suppression(spark, sf_dir):
    """Documents without a label: the anti-join by which a lock file keeps its manifest from being read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def event_scopes(spark, sf_dir):
    scope = choose(F.col("event_type"), {"view": "Runtime", "click": "Build", "error": "Test", "signup": "Development", "purchase": "Optional"})
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf_dir, "events").select(scope.alias("scope"), (k / F.lit(100.0)).alias("scope_confidence"), k.alias("k"))


EVENTS_SQL = """
scopes as (select case event_type when 'view' then 'Runtime' when 'click' then 'Build' when 'error' then 'Test' when 'signup' then 'Development' else 'Optional' end as scope, (json_extract(props, '$.k')::int) / 100.0 as scope_confidence from events)"""


def names_and_ids(spark, sf_dir):
    c = reconcile.dedup_priority(comp(spark, sf_dir))
    name, version, eco = F.col("name"), F.col("version"), F.col("ecosystem")
    return c.select(
        "name", "version", "ecosystem",
        identity.purl(name, version, eco, F.lit(None).cast("string")).alias("purl"),
        identity.cpe23(name, version, eco).alias("cpe"),
        identity.download_location(name, version, eco, F.lit(None).cast("string")).alias("download"),
        identity.supplier(eco).alias("supplier"),
        identity.spdx_id(name).alias("spdx_id"),
        identity.python_name(name).alias("python_name"),
        version_known(version).alias("known"),
    )


IDENTITY_SQL = f"""with {COMP_SQL}, d as (select *, version <> 'unspecified' as known, replace(replace(name, '-', '_'), '.', '_') as product from dedup)
select name, version, ecosystem,
  case when ecosystem = 'npm' then 'pkg:npm/' || name || case when known then '@' || version else '' end
    when ecosystem in ('BUILD-CONFIG', 'VENDORED') then 'pkg:generic/' || name || case when known then '@' || version else '' end
    else 'pkg:generic/' || name || case when known then '@' || version else '' end || '?type=' || ecosystem end as purl,
  case when known then 'cpe:2.3:a:' || replace(ecosystem, '-', '_') || ':' || product || ':' || replace(version, '-', '_') || ':*:*:*:*:*:*:*' end as cpe,
  case when known and ecosystem = 'npm' then 'https://registry.npmjs.org/' || name || '/-/' || name || '-' || version || '.tgz' else 'NOASSERTION' end as download,
  case when ecosystem = 'npm' then 'Organization: npmjs' end as supplier,
  regexp_replace(name, '[^A-Za-z0-9.-]', '-', 'g') as spdx_id, regexp_replace(lower(name), '[-_.]+', '_', 'g') as python_name, known
from d"""


def hrefs(spark, sf_dir):
    """Link targets of pages: extract, explode, distinct, minus in-page ones."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("href")).where("href <> '' and not startswith(href, '#')")


LINK_SQL = """, linked as (select distinct unnest([name, base, 'lib' || base]) as c from (select name, regexp_replace(name, '^(lib)+', '') as base from classified where ecosystem = 'system')),
asked as (select distinct name from (select name, unnest([name, base, 'lib' || base]) as c from (select name, regexp_replace(name, '^(lib)+', '') as base from classified where ecosystem = 'BUILD-CONFIG' and scope = 'Build')) where c in (select c from linked)),
refined as (select name, version, ecosystem, source_rank, is_dev, is_direct, source_file,
  case when hit then 'Runtime' else scope end as scope, case when hit then 0.9 else scope_confidence end as scope_confidence, case when hit then 'BUILD-CONFIG linked at runtime (matched SYSTEM lib)' else scope_reason end as scope_reason
  from (select *, ecosystem = 'BUILD-CONFIG' and scope = 'Build' and name in (select name from asked) as hit from classified))"""

_comp_cols = ", ".join(KEYS)
QUERIES = {
    "dedup_priority": lambda s, d: reconcile.dedup_priority(comp(s, d)).select(KEYS),
    "dedup_imports": lambda s, d: reconcile.dedup_imports(comp(s, d).where("source_rank = 1")).select(KEYS),
    "suppress_sources": lambda s, d: reconcile.suppress_unspecified(reconcile.suppress_lower_sources(reconcile.dedup_priority(comp(s, d)))).select(KEYS),
    "suppress_chain": lambda s, d: reconcile.reconcile(comp(s, d)).select(KEYS),
    "classify_scope": lambda s, d: classified(s, d).select(SCOPED),
    "link_refinement": flagship,
    "production_filter": lambda s, d: classify.filter_scopes(classified(s, d), production=True).select(SCOPED),
    "scope_filter": lambda s, d: classify.filter_scopes(classified(s, d), "dev, BUILD").select(SCOPED),
    "scope_statistics": lambda s, d: stats.scope_statistics(classified(s, d)),
    "scope_percentages": lambda s, d: stats.scope_percentages(classified(s, d)),
    "event_scope_statistics": lambda s, d: stats.scope_statistics(event_scopes(s, d)),
    "direct_counts": lambda s, d: stats.direct_counts(reconcile.reconcile(comp(s, d))),
    "ecosystem_counts": lambda s, d: stats.ecosystem_counts(reconcile.reconcile(comp(s, d))),
    "ecosystem_counts_stdout": lambda s, d: stats.ecosystem_counts(reconcile.reconcile(comp(s, d)), "stdout"),
    "ecosystem_list": lambda s, d: stats.ecosystems(comp(s, d)),
    "distinct_packages": lambda s, d: stats.distinct_packages(comp(s, d)),
    "shared_dependencies": lambda s, d: stats.shared_dependencies(comp(s, d).select(F.col("source_file").alias("package"), "name", "version", "is_dev")),
    "grouped_list": lambda s, d: graph.grouped_list(reconcile.reconcile(comp(s, d))),
    "identity": names_and_ids,
    "git_urls": git_urls,
    "licenses": licenses,
    "autosar_lookup": autosar,
    "supplier_lookup": supplier_lookup,
    "version_resolution": versions,
    "sibling_suppression": sibling_suppression,
    "href_extract": hrefs,
    "graph_edges": lambda s, d: graph.resolve_edges(*graph_tables(s, d)),
    "graph_roots": lambda s, d: (lambda n, e: graph.correct_roots(n, graph.resolve_edges(n, e)).select("id", "is_direct", "is_direct_graph"))(*graph_tables(s, d)),
    "graph_unfold": lambda s, d: unfolded(s, d)[0].select("root", "node", "depth", F.concat_ws(">", "path").alias("path"), "cyclic"),
    "graph_tree": lambda s, d: graph.tree_lines(*unfolded(s, d)).select("root", F.concat_ws(">", "path").alias("path"), "depth", "line"),
    "graph_chains": graph_chains,
    "graph_chains_to": graph_chains_to,
}
QUERIES |= registry_branches.QUERIES | registry_files.QUERIES | registry_documents.QUERIES
_scoped_cols = ", ".join(SCOPED)
_counts = ", ".join(f"count(*) filter (scope = '{s}') as {s.lower()}_count" for s in stats.SCOPES)
ORACLES = {
    "dedup_priority": f"with {COMP_SQL} select {_comp_cols} from dedup",
    "dedup_imports": f"with {COMP_SQL} select {_comp_cols} from comp where source_rank = 1 qualify row_number() over (partition by name, ecosystem order by source_file) = 1",
    "suppress_sources": f"with {CHAIN_SQL} select {_comp_cols} from versioned",
    "suppress_chain": f"with {CHAIN_SQL} select {_comp_cols} from chain",
    "classify_scope": f"with {CLASSIFY_SQL} select {_scoped_cols} from classified",
    "link_refinement": f"with {CLASSIFY_SQL}{LINK_SQL} select {_scoped_cols} from refined",
    "production_filter": f"with {CLASSIFY_SQL} select {_scoped_cols} from classified where scope in ('Runtime', 'Optional')",
    "scope_filter": f"with {CLASSIFY_SQL} select {_scoped_cols} from classified where scope in ('Development', 'Build')",
    "scope_statistics": f"with {CLASSIFY_SQL} select {_counts}, count(*) as total, round(coalesce(avg(scope_confidence), 0), 6) as average_confidence from classified",
    "scope_percentages": f"with {CLASSIFY_SQL} select scope, count(*) as count, round(100.0 * count(*) / (select count(*) from classified), 1)::double as percentage from classified group by scope",
    "event_scope_statistics": f"with {EVENTS_SQL} select {_counts}, count(*) as total, round(coalesce(avg(scope_confidence), 0), 6)::double as average_confidence from scopes",
    "direct_counts": f"with {CHAIN_SQL} select count(*) as total, count(*) filter (is_direct and not is_dev) as direct, count(*) filter (not is_direct) as transitive, count(*) filter (is_dev) as dev from chain",
    "ecosystem_counts": f"with {CHAIN_SQL} select ecosystem, count(*) as total, count(*) filter (is_direct and not is_dev) as direct, count(*) filter (not is_direct) as transitive from chain group by ecosystem",
    "ecosystem_counts_stdout": f"with {CHAIN_SQL} select ecosystem, count(*) as total, count(*) filter (is_direct) as direct, count(*) filter (not is_direct) as transitive from chain group by ecosystem",
    "ecosystem_list": f"with {COMP_SQL} select list_sort(list(distinct ecosystem)) as ecosystems from comp",
    "distinct_packages": f"with {COMP_SQL} select count(distinct (name, version)) as packages from comp",
    "shared_dependencies": f"with {COMP_SQL} select name, version, bool_and(is_dev) as is_dev, count(distinct source_file) as used_by from comp group by name, version",
    "grouped_list": f"with {CHAIN_SQL} select case when not is_direct then 3 when is_dev then 2 else 1 end as list, name, version, ecosystem from chain",
    "identity": IDENTITY_SQL,
    "git_urls": GIT_SQL,
    "licenses": LICENSES_SQL,
    "autosar_lookup": AUTOSAR_SQL,
    "supplier_lookup": SUPPLIER_SQL,
    "version_resolution": VERSIONS_SQL,
    "sibling_suppression": "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)",
    "href_extract": "select page_id, href from (select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) where href <> '' and not starts_with(href, '#')",
    "graph_edges": f"with {GRAPH_SQL} select * from resolved",
    "graph_roots": f"with {GRAPH_SQL} select id, is_direct, id not in (select child from resolved) as is_direct_graph from nodes",
    "graph_unfold": f"{UNFOLD_SQL} select root, node, depth, array_to_string(path, '>') as path, cyclic from tree",
    "graph_tree": f"{UNFOLD_SQL}, below as (select parent, count(*) as n from resolved group by parent) select root, array_to_string(path, '>') as path, depth, repeat('  ', depth) || node || case when cyclic then ' (cycle)' when depth = 5 and n > 0 then ' (' || n || ' more)' else '' end as line from tree left join below on parent = node",
    "graph_chains": f"{CHAINS_SQL} select id as target, coalesce(array_to_string(path, ' -> '), id) as chain from nodes left join tree on node = id and not cyclic",
    "graph_chains_to": f"{CHAINS_SQL} select id as target, coalesce(array_to_string(path, ' -> '), id) as chain from nodes left join tree on node = id and not cyclic where k % 100 = 0",
}
ORACLES |= registry_branches.ORACLES | registry_files.ORACLES | registry_documents.ORACLES
