"""Queries over what the documents say: components made of parts are written as SPDX, CycloneDX and report, and read back; their SQL reads the part table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry_files import BASE_SQL, base
from .schema import as_components
from .sinks import bom, report

WHEN = "2024-01-01T00:00:00Z"
ECOSYSTEMS = ["npm", "cargo", "pip"]
PURL_TYPES = ["npm", "cargo", "pypi"]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rows = F.col("k"), base(spark, sf_dir)
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names)).cast("int") + 1)
    return as_components(
        rows, ecosystem=pick(ECOSYSTEMS), version=F.when(k % 10 == 7, "unspecified").otherwise(F.col("version")), is_dev=k % 4 == 0, is_direct=k % 2 == 0, scope=pick(["Runtime", "Build", "Test", "Development", "Provided"]), scope_confidence=F.lit(0.5),
        license=F.when(k % 6 == 0, "MIT").when(k % 6 == 1, "Own terms"), checksum_sha256=F.when(k % 5 == 0, F.sha2("name", 256)), source_file=F.lit("f"), ordinal=k,
    )


SQL = f"""{BASE_SQL},
comp as (
  select k, project, name, ['npm', 'cargo', 'pip'][k % 3 + 1] as ecosystem, ['npm', 'cargo', 'pypi'][k % 3 + 1] as kind, case when k % 10 = 7 then 'unspecified' else version end as version, k % 4 = 0 as is_dev, k % 2 = 0 as is_direct,
    ['Runtime', 'Build', 'Test', 'Development', 'Provided'][k % 5 + 1] as scope, case when k % 6 = 0 then 'MIT' when k % 6 = 1 then 'Own terms' end as license, case when k % 5 = 0 then sha256(name) end as sha from base),
named as (select *, 'pkg:' || kind || '/' || name || case when k % 10 = 7 then '' else '@' || version end as purl from comp)"""


def spdx_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and what contains them, read back from the JSON of an SPDX document's fragments."""
    made = bom.spdx_fragments(components(spark, sf_dir), WHEN)
    package = "name string, SPDXID string, versionInfo string, licenseDeclared string, primaryPackagePurpose string, checksums array<struct<algorithm string, checksumValue string>>, externalRefs array<struct<referenceType string, referenceLocator string>>"
    read = lambda part, schema: made.where(F.col("part") == part).select("project", F.from_json(F.substring("text", 2, 1 << 24), schema).alias("j")).select("project", "j.*")
    purl = F.get(F.filter("externalRefs", lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]
    packages = read(1, package).select("project", "SPDXID", "name", F.col("versionInfo").alias("version"), F.col("licenseDeclared").alias("license"), F.col("primaryPackagePurpose").alias("purpose"), F.get("checksums", F.lit(0))["checksumValue"].alias("sha"), purl.alias("purl"))
    links = read(3, "spdxElementId string, relationshipType string, relatedSpdxElement string")
    held = links.select("project", F.col("relatedSpdxElement").alias("SPDXID"), F.concat_ws(" ", "spdxElementId", "relationshipType").alias("held_by"))
    return packages.join(held, ["project", "SPDXID"]).drop("SPDXID")


SPDX_SQL = f"""with {SQL}
select project, name, case when version = 'unspecified' then 'NOASSERTION' else version end as version, coalesce(license, 'NOASSERTION') as license,
  case when scope in ('Runtime', 'Provided') then 'LIBRARY' else 'OTHER' end as purpose, sha, purl, 'SPDXRef-Package-root-' || project || ' CONTAINS' as held_by from named"""


def cyclonedx_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, and whether the root depends on them, read back from the JSON of a CycloneDX document's fragments."""
    made = bom.cyclonedx_fragments(components(spark, sf_dir), WHEN)
    schema = "name string, version string, scope string, purl string, `bom-ref` string, licenses array<struct<license struct<id string, name string>>>, hashes array<struct<alg string, content string>>, properties array<struct<name string, value string>>"
    read = made.where("part = 1").select("project", F.from_json("text", schema).alias("j"))
    prop = lambda key: F.get(F.filter("j.properties", lambda p: p["name"] == f"{bom.TOOL}:{key}"), F.lit(0))["value"]
    given = F.get("j.licenses", F.lit(0))["license"]
    rows = read.select("project", F.col("j.bom-ref").alias("ref"), "j.name", "j.version", "j.scope", "j.purl", given["id"].alias("license_id"), given["name"].alias("license_name"), F.get("j.hashes", F.lit(0))["content"].alias("sha"), prop("is_dev").alias("is_dev"), prop("is_direct").alias("is_direct"))
    needed = made.where("part = 3").select("project", F.get_json_object(F.concat(F.lit('{"r":'), "text", F.lit("}")), "$.r").alias("ref"), F.lit(True).alias("needed"))
    return rows.join(needed, ["project", "ref"], "left")


CYCLONEDX_SQL = f"""with {SQL}
select project, ecosystem || ':' || name || '@' || version as ref, name, nullif(version, 'unspecified') as version, case when scope in ('Runtime', 'Provided') then 'required' else 'optional' end as scope, purl, case when license = 'MIT' then license end as license_id,
  case when license <> 'MIT' then license end as license_name, sha, is_dev::varchar as is_dev, is_direct::varchar as is_direct, true as needed from named"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows of packages, counts and totals, without edges."""
    found = report.rows(components(spark, sf_dir), WHEN, style="flat").where("role in ('ecosystem', 'counts_stdout', 'counts_markdown', 'item', 'scope') or name = 'Dependencies'")
    return found.select("project", "group", "role", "name", F.replace("text", F.lit("\x1f"), F.lit("|")).alias("text")).where("name <> 'Avg Confidence'")


_scopes = ", ".join(f"('{s}')" for s in ("Runtime", "Build", "Test", "Development", "Optional", "Provided"))
REPORT_SQL = f"""with {SQL}, scopes(scope) as (values {_scopes})
select project, ecosystem as "group", 'item' as role, name, concat_ws('|', name, version, scope, case when is_direct then 'direct' else 'transitive' end, case when is_dev then 'dev' else '' end) as text from named
union all select project, ecosystem, 'ecosystem', '', upper(ecosystem) || ' (' || count(*) || ' packages)' from named group by project, ecosystem
union all select project, ecosystem, 'counts_stdout', '', count(*) filter (is_direct) || ' direct, ' || count(*) filter (not is_direct) || ' transitive, ' || count(*) filter (is_dev) || ' dev' from named group by project, ecosystem
union all select project, ecosystem, 'counts_markdown', '', count(*) filter (is_direct and not is_dev) || ' direct, ' || count(*) filter (not is_direct) || ' transitive, ' || count(*) filter (is_dev) || ' dev' from named group by project, ecosystem
union all select project, '', 'field', 'Dependencies', count(*) || ' total (' || count(*) filter (is_direct and not is_dev) || ' direct, ' || count(*) filter (not is_direct) || ' transitive, ' || count(*) filter (is_dev) || ' dev)' from named group by project
union all select project, '', 'scope', s.scope, count(*) filter (c.scope = s.scope) || ' (' || round(100.0 * count(*) filter (c.scope = s.scope) / count(*), 0)::int || '%)' from named c, scopes s group by project, s.scope"""


QUERIES = {"spdx_fields": spdx_fields, "cyclonedx_fields": cyclonedx_fields, "report_lines": report_lines}
ORACLES = {"spdx_fields": SPDX_SQL, "cyclonedx_fields": CYCLONEDX_SQL, "report_lines": REPORT_SQL}
