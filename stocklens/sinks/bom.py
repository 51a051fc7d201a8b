"""Bills of materials: SPDX 2.3 as JSON and tag-value, and CycloneDX 1.5, each also for ROS packages.

Documents are made of fragments (documents.py), a row for each package, component and relationship, so that a project of any size is written
by many tasks. Functions named after a format give (project, document) with each document as one string. Ids come from content, so that
a scan of the same files gives the same documents; the time is given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, models
from ..functions.dictionaries import is_known_spdx
from ..operators.reconcile import lookup
from ..schema import version_known
from . import report
from .documents import assembled, fragment, together, write_files

NONE = "NOASSERTION"
TOOL = "stocklens"
LICENSE_LIST = "3.21"  # version of the SPDX licence list that the dictionaries follow


def _or_none(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE))


def _id(kind: str = "Package") -> Column:
    """An SPDX id of a component: readable, and with a hash of the raw key, since names that differ may become one in SPDX's letters."""
    raw = F.concat_ws("-", "ecosystem", "name", "version")
    return F.concat(F.lit(f"SPDXRef-{kind}-"), identity.spdx_id(raw), F.lit("-"), F.substring(F.sha2(F.concat_ws("\n", "ecosystem", "name", "version"), 256), 1, 8))


def _full(c: Column) -> Column:
    """Null for an empty array: JSON leaves it out."""
    return F.when(F.size(c) > 0, c)


def _purl() -> Column:
    return identity.purl(F.col("name"), F.col("version"), F.col("ecosystem"), F.col("repository_url"))


def with_suppliers(components: DataFrame, suppliers: DataFrame | None) -> DataFrame:
    """components with autosar_supplier: what a table (key, value) says of an AUTOSAR module's name, else NOASSERTION; null for other rows."""
    if suppliers is None:
        return components.withColumn("autosar_supplier", F.when(F.col("autosar").isNotNull(), NONE))
    found = lookup(components, suppliers, F.col("name"), "autosar_supplier", NONE)
    return found.withColumn("autosar_supplier", F.when(F.col("autosar").isNotNull(), F.col("autosar_supplier")))


def _sub_info(sub: Column) -> Column:
    """What is known of a sub-model, as 'key=value' parts."""
    part = lambda key: F.when(sub[key].isNotNull(), F.concat(F.lit(f"{key}="), sub[key].cast("string")))
    return F.concat_ws("; ", *(part(k) for k in ("modality", "model_type", "num_hidden_layers", "hidden_size", "num_attention_heads", "num_key_value_heads", "max_position_embeddings", "vocab_size", "dtype", "intermediate_size", "patch_size")))


def _model_info() -> list[Column]:
    """What is known of a model, as 'key=value' parts; null for what isn't."""
    part = lambda f, value: F.when(value.isNotNull(), F.concat(F.lit(f"{f}="), value))
    return [part(f, F.col(f"ai.{f}").cast("string")) for f in MODEL_PROPERTIES if f != "prompt_template"]


def _package(spdx_id: Column, name: Column, **given: Column) -> Column:
    """An SPDX package; fields that aren't given are NOASSERTION or left out."""
    none = F.lit(None)
    refs = "array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>"
    of = lambda key, default: given.get(key, default)
    return F.struct(
        spdx_id.alias("SPDXID"),
        name.alias("name"),
        of("version", F.lit(NONE)).alias("versionInfo"),
        of("supplier", none).cast("string").alias("supplier"),
        of("originator", none).cast("string").alias("originator"),
        of("download", F.lit(NONE)).alias("downloadLocation"),
        F.lit(False).alias("filesAnalyzed"),
        F.lit(NONE).alias("licenseConcluded"),
        of("license", F.lit(NONE)).alias("licenseDeclared"),
        F.lit(NONE).alias("copyrightText"),
        of("homepage", none).cast("string").alias("homepage"),
        of("source", none).cast("string").alias("sourceInfo"),
        of("purpose", none).cast("string").alias("primaryPackagePurpose"),
        of("checksums", none).cast("array<struct<algorithm:string,checksumValue:string>>").alias("checksums"),
        of("refs", none).cast(refs).alias("externalRefs"),
    )


def _component_package(spdx_id: Column) -> Column:
    """The SPDX package of a component row, which may have the column autosar_supplier."""
    name, version, eco = F.col("name"), F.col("version"), F.col("ecosystem")
    ref = lambda category, kind, value: F.when(value.isNotNull(), F.struct(F.lit(category).alias("referenceCategory"), F.lit(kind).alias("referenceType"), value.alias("referenceLocator")))
    digest = lambda algorithm, value: F.when(value.isNotNull(), F.struct(F.lit(algorithm).alias("algorithm"), value.alias("checksumValue")))
    supplied = F.concat(F.lit("autosar:supplier="), F.replace("autosar_supplier", F.lit(" "), F.lit("%20")))
    return _package(
        spdx_id,
        name,
        version=identity.version_info(version),
        supplier=identity.supplier(eco),
        originator=identity.originator(F.col("author")),
        download=identity.download_location(name, version, eco, F.col("repository_url")),
        license=_or_none(F.col("license")),
        homepage=F.col("homepage_url"),
        source=F.concat_ws("; ", "source_file", *_model_info()),
        purpose=identity.spdx_purpose(F.col("scope"), F.col("ai").isNotNull()),
        checksums=_full(F.array_compact(F.array(digest("SHA256", F.col("checksum_sha256")), digest("SHA512", F.col("checksum_sha512"))))),
        refs=F.array_compact(F.array(ref("PACKAGE-MANAGER", "purl", _purl()), ref("SECURITY", "cpe23Type", identity.cpe23(name, version, eco)), ref("OTHER", "autosar-supplier", supplied))),
    )


def spdx_packages(components: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """project, name, package, parts: the SPDX package of each component, and those of a model's parts."""
    rows = with_suppliers(components, suppliers).withColumn("_id", _id())
    parts = F.transform(F.col("ai.sub_models"), lambda s, i: _package(F.concat("_id", F.lit("-sub-"), i.cast("string")), F.coalesce(s["model_type"], s["modality"]), source=_sub_info(s), purpose=F.lit("LIBRARY")))
    return rows.select(F.coalesce("project", F.lit("project")).alias("project"), "name", _component_package(F.col("_id")).alias("package"), F.coalesce(parts, F.filter(F.array(_package(F.lit(""), F.lit(""))), lambda p: F.lit(False))).alias("parts"))


def _relation(a: Column, kind: str, b: Column) -> Column:
    return F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))


def _content(rows: DataFrame, text: Column) -> DataFrame:
    """(project, content): a hash of a project's texts, whatever their order."""
    number = F.xxhash64(text)
    digest = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(number.cast("decimal(38,0)")).cast("string"), F.bit_xor(number).cast("string"))
    return rows.groupBy("project").agg(F.sha2(digest, 256).alias("content"))


def _open(document: Column) -> Column:
    """The JSON of a struct without its closing brace."""
    text = F.to_json(document)
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _spdx_head(created: str, *more: Column) -> Column:
    return _open(
        F.struct(
            F.lit("SPDX-2.3").alias("spdxVersion"),
            F.lit("CC0-1.0").alias("dataLicense"),
            F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
            F.col("project").alias("name"),
            F.concat(F.lit("https://spdx.org/spdxdocs/"), identity.spdx_id(F.col("project")), F.lit("-"), F.substring("content", 1, 32)).alias("documentNamespace"),
            F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {TOOL}")).alias("creators"), F.lit(LICENSE_LIST).alias("licenseListVersion")).alias("creationInfo"),
            *more,
        )
    )


def _main_id() -> Column:
    safe = identity.spdx_id(F.col("project"))
    return F.concat(F.lit("SPDXRef-Package-root-"), F.when(safe == "", "package").otherwise(safe))


COMMA = ","


def spdx_fragments(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    """The document describes one package, the project, which contains each component; models contain their parts. created is an RFC 3339 time in UTC."""
    rows = spdx_packages(components, suppliers)
    every = rows.select("project", F.explode(F.concat(F.array("package"), "parts")).alias("p"))
    heads = _content(every, F.to_json("p"))
    main, document = _main_id(), F.lit("SPDXRef-DOCUMENT")
    head = F.concat(_spdx_head(created, F.array(main).alias("documentDescribes")), F.lit(',"packages":['), F.to_json(_package(main, F.col("project"))))
    contains = F.concat(F.array(_relation(main, "CONTAINS", F.col("package.SPDXID"))), F.transform("parts", lambda p: _relation(F.col("package.SPDXID"), "CONTAINS", p["SPDXID"])))
    links = rows.select("project", F.explode(contains).alias("r"))
    return together(
        fragment(heads, 0, head),
        fragment(every, 1, F.concat(F.lit(","), F.to_json("p")), F.concat_ws("\n", "p.name", "p.SPDXID")),
        fragment(heads, 2, F.concat(F.lit('],"relationships":['), F.to_json(_relation(document, "DESCRIBES", main)))),
        fragment(links, 3, F.concat(F.lit(","), F.to_json("r")), F.concat_ws("\n", "r.spdxElementId", "r.relatedSpdxElement")),
        fragment(heads, 4, F.lit("]}")),
    )


def spdx(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    return assembled(spdx_fragments(components, created, suppliers))


def _shared(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ROS packages with _pkg, what they use: a row for each use, and one for each (name, version, ecosystem), which is for development only if all its uses are."""
    used = packages.select("project", "_pkg", F.explode("dependencies").alias("d"))
    uses = used.select(F.col("project").alias("_project"), "_pkg", "d.*").drop("project").withColumnRenamed("_project", "project").withColumn("autosar_supplier", F.lit(None).cast("string"))
    columns = [c for c in uses.columns if c not in ("_pkg", "project", "name", "version", "ecosystem", "is_dev")]
    first = F.min_by(F.struct(*columns), F.struct("is_dev", "source_path", "ordinal"))
    one = uses.groupBy("project", "name", "version", "ecosystem").agg(F.bool_and("is_dev").alias("is_dev"), first.alias("_one"))
    return uses, one.select("project", "name", "version", "ecosystem", "is_dev", *(F.col(f"_one.{c}").alias(c) for c in columns))


def spdx_ros_fragments(packages: DataFrame, created: str) -> DataFrame:
    """ROS packages (manifests.ros_packages): each is described and depends on what it names; a dependency that several share is one package."""
    raw = F.concat_ws("-", "package", "version", "source_path")
    keyed = packages.withColumn("_pkg", F.concat(F.lit("SPDXRef-ROSPackage-"), identity.spdx_id(raw), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8)))
    locator = F.concat(F.lit("pkg:ros/"), "package", F.lit("@"), "version")
    purl = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), locator.alias("referenceLocator")))
    own = keyed.select("project", _package(F.col("_pkg"), F.col("package"), version=F.col("version"), purpose=F.lit("LIBRARY"), refs=purl).alias("p"))
    uses, shared = _shared(keyed)
    every = own.unionByName(shared.select("project", _component_package(_id("Dep")).alias("p")))
    links = uses.select("project", _relation(F.col("_pkg"), "DEPENDS_ON", _id("Dep")).alias("r")).distinct()
    heads, document = _content(every, F.to_json("p")), F.lit("SPDXRef-DOCUMENT")
    place = F.concat_ws("\n", "p.name", "p.SPDXID")
    return together(
        fragment(heads, 0, F.concat(_spdx_head(created), F.lit(',"documentDescribes":['))),
        fragment(own, 1, F.concat(F.lit('"'), "p.SPDXID", F.lit('"')), place, COMMA),
        fragment(heads, 2, F.lit('],"packages":[')),
        fragment(every, 3, F.to_json("p"), place, COMMA),
        fragment(heads, 4, F.lit('],"relationships":[')),
        fragment(own.select("project", "p", _relation(document, "DESCRIBES", F.col("p.SPDXID")).alias("r")), 5, F.to_json("r"), F.concat(F.lit("0"), place), COMMA),
        fragment(links, 5, F.to_json("r"), F.concat_ws("\n", F.lit("1"), "r.spdxElementId", "r.relatedSpdxElement"), COMMA),
        fragment(heads, 6, F.lit("]}")),
    )


def spdx_ros(packages: DataFrame, created: str) -> DataFrame:
    return assembled(spdx_ros_fragments(packages, created))


def spdx_tag_value_fragments(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    """The SPDX tag-value form; null values leave their line out."""
    line = lambda tag, value: F.concat(F.lit(f"{tag}: "), value)

    def body(p):
        checksums = F.concat_ws("\n", F.transform(p["checksums"], lambda c: F.concat(F.lit("PackageChecksum: "), c["algorithm"], F.lit(": "), c["checksumValue"])))
        refs = F.concat_ws("\n", F.transform(p["externalRefs"], lambda r: F.concat_ws(" ", F.lit("ExternalRef:"), r["referenceCategory"], r["referenceType"], r["referenceLocator"])))
        fields = [("PackageName", "name"), ("SPDXID", "SPDXID"), ("PackageVersion", "versionInfo"), ("PackageSupplier", "supplier"), ("PackageOriginator", "originator"), ("PackageDownloadLocation", "downloadLocation")]
        more = [("PackageLicenseConcluded", "licenseConcluded"), ("PackageLicenseDeclared", "licenseDeclared"), ("PackageCopyrightText", "copyrightText"), ("PackageSourceInfo", "sourceInfo"), ("PrimaryPackagePurpose", "primaryPackagePurpose")]
        parts = [*(line(t, p[f]) for t, f in fields), F.lit("FilesAnalyzed: false"), F.nullif(checksums, F.lit("")), *(line(t, p[f]) for t, f in more), F.nullif(refs, F.lit(""))]
        return F.concat_ws("\n", *parts)

    rows = spdx_packages(components, suppliers)
    every = rows.select("project", F.explode(F.concat(F.array("package"), "parts")).alias("p"))
    heads, main = rows.select("project").distinct(), _main_id()
    head = F.concat_ws("\n", F.lit("SPDXVersion: SPDX-2.3"), F.lit("DataLicense: CC0-1.0"), F.lit("SPDXID: SPDXRef-DOCUMENT"), line("DocumentName", F.col("project")), line("DocumentNamespace", F.concat(F.lit("https://spdx.org/spdxdocs/"), identity.spdx_id(F.col("project")))), F.lit(f"Creator: Tool: {TOOL}"), F.lit(f"Created: {created}"))
    return together(
        fragment(heads, 0, F.concat(head, F.lit("\n\n"), body(_package(main, F.col("project"))))),
        fragment(every, 1, F.concat(F.lit("\n\n"), body(F.col("p"))), F.concat_ws("\n", "p.name", "p.SPDXID")),
        fragment(heads, 2, F.concat(F.lit("\n\nRelationship: SPDXRef-DOCUMENT DESCRIBES "), main)),
        fragment(rows, 3, F.concat(F.lit("\nRelationship: "), main, F.lit(" CONTAINS "), F.col("package.SPDXID")), F.col("package.SPDXID")),
        fragment(heads, 4, F.lit("\n")),
    )


def spdx_tag_value(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    return assembled(spdx_tag_value_fragments(components, created, suppliers))


#: Properties of a model in a CycloneDX component: the fields of the AI struct that have one, lists joined by commas.
MODEL_PROPERTIES = ["architecture", "model_type", "quantization", "parameter_count", "computed_parameter_count", "size_label", "tensor_count", "shard_count", "total_size_bytes", "safetensors_format", "torch_dtype", "transformers_version", "vocab_size", "num_hidden_layers", "hidden_size", "num_attention_heads", "context_length", "model_max_length", "finetune", "model_name", "pipeline_tag", "quantized_by", "prompt_template", "adapter_type", "has_vision", "has_audio", "has_video", "is_adapter", "hash_skipped"]


def _bom_ref() -> Column:
    return F.concat_ws("@", F.concat_ws(":", "ecosystem", "name"), "version")


def _cyclonedx_component() -> Column:
    """The CycloneDX component of a component row with autosar_supplier; models hold their parts and a model card."""
    known = version_known(F.col("version"))
    digest = lambda algorithm, value: F.when(value.isNotNull(), F.struct(F.lit(algorithm).alias("alg"), value.alias("content")))
    given = is_known_spdx(F.col("license"))
    one = F.struct(F.struct(F.when(given, F.col("license")).alias("id"), F.when(~given, F.col("license")).alias("name")).alias("license"))
    prop = lambda key, value: F.when(value.isNotNull(), F.struct(F.lit(f"{TOOL}:{key}").alias("name"), value.alias("value")))
    link = lambda kind, url: F.when(url.isNotNull(), F.struct(F.lit(kind).alias("type"), url.alias("url")))
    ai = F.col("ai")
    told = [prop(f"ai:{f}", F.col(f"ai.{f}").cast("string")) for f in MODEL_PROPERTIES] + [prop(f"ai:{f}", F.nullif(F.array_join(F.col(f"ai.{f}"), ","), F.lit(""))) for f in ("tags", "languages", "datasets")]
    bases = F.transform("ai.base_models", lambda b, i: F.struct(F.concat(F.lit(f"{TOOL}:ai:base_model."), i.cast("string")).alias("name"), F.coalesce(b["name"], b["repo_url"], b["url"]).alias("value")))
    warnings = F.transform(models.integrity_warnings(ai), lambda w: F.struct(F.lit(f"{TOOL}:ai:integrity_warning").alias("name"), w.alias("value")))
    model = F.when(ai.isNotNull(), F.concat(F.array_compact(F.array(*told)), F.coalesce(bases, F.slice(warnings, 1, 0)), warnings))
    parts = F.transform("ai.sub_models", lambda s: F.struct(F.lit("machine-learning-model").alias("type"), F.concat(_bom_ref(), F.lit("#"), s["modality"]).alias("bom-ref"), F.coalesce(s["model_type"], s["modality"]).alias("name"), _sub_info(s).alias("description")))
    datasets = F.transform("ai.datasets", lambda d: F.struct(F.lit("dataset").alias("type"), d.alias("name")))
    parameters = F.struct(F.col("ai.pipeline_tag").alias("task"), F.col("ai.model_type").alias("architectureFamily"), F.col("ai.architecture").alias("modelArchitecture"), _full(datasets).alias("datasets"))
    component = F.struct(
        F.when(F.col("ai").isNotNull(), "machine-learning-model").otherwise("library").alias("type"),
        _bom_ref().alias("bom-ref"),
        F.col("name"),
        F.when(known, F.col("version")).alias("version"),
        F.when(F.col("scope").isin("Runtime", "Provided"), "required").otherwise("optional").alias("scope"),
        F.when(F.col("license").isNotNull(), F.array(one)).alias("licenses"),
        _purl().alias("purl"),
        identity.cpe23(F.col("name"), F.col("version"), F.col("ecosystem")).alias("cpe"),
        _full(F.array_compact(F.array(digest("SHA-256", F.col("checksum_sha256")), digest("SHA-512", F.col("checksum_sha512"))))).alias("hashes"),
        _full(F.array_compact(F.array(link("vcs", F.col("repository_url")), link("website", F.col("homepage_url"))))).alias("externalReferences"),
        F.when(ai.isNotNull(), F.struct(parameters.alias("modelParameters"))).alias("modelCard"),
        _full(parts).alias("components"),
        F.array_compact(F.array(prop("ecosystem", F.col("ecosystem")), prop("scope", F.col("scope")), prop("source", F.col("source_file")), prop("is_dev", F.col("is_dev").cast("string")), prop("is_direct", F.col("is_direct").cast("string")), prop("autosar:supplier", F.col("autosar_supplier")))).alias("properties"),
    )
    return component.withField("properties", F.concat(component["properties"], F.coalesce(model, F.slice(component["properties"], 1, 0))))


def _cyclonedx_head(created: str) -> Column:
    part = lambda a, n: F.substring("content", a, n)
    serial = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)))
    root = F.struct(F.lit("application").alias("type"), _root().alias("bom-ref"), F.col("project").alias("name"))
    metadata = F.struct(F.lit(created).alias("timestamp"), F.array(F.struct(F.lit(TOOL).alias("name"))).alias("tools"), root.alias("component"))
    head = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"), metadata.alias("metadata"))
    return F.concat(_open(head), F.lit(',"components":['))


def _root() -> Column:
    return F.concat(F.lit("root:"), F.col("project"))


def _text(value: Column) -> Column:
    """A string as JSON."""
    pair = F.to_json(F.struct(value.alias("v")))
    return F.substring(pair, F.lit(6), F.length(pair) - 6)


def cyclonedx_fragments(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    """The root depends on every component; components have no links of their own."""
    rows = with_suppliers(components, suppliers).withColumn("project", F.coalesce("project", F.lit("project")))
    rows = rows.select("project", "name", _bom_ref().alias("_ref"), F.to_json(_cyclonedx_component()).alias("_json"))
    heads, place = _content(rows, F.col("_ref")), F.concat_ws("\n", "name", "_ref")
    return together(
        fragment(heads, 0, _cyclonedx_head(created)),
        fragment(rows, 1, F.col("_json"), place, COMMA),
        fragment(heads, 2, F.concat(F.lit('],"dependencies":[{"ref":'), _text(_root()), F.lit(',"dependsOn":['))),
        fragment(rows, 3, _text(F.col("_ref")), place, COMMA),
        fragment(heads, 4, F.lit("]}]}")),
    )


def cyclonedx(components: DataFrame, created: str, suppliers: DataFrame | None = None) -> DataFrame:
    return assembled(cyclonedx_fragments(components, created, suppliers))


def cyclonedx_ros_fragments(packages: DataFrame, created: str) -> DataFrame:
    """ROS packages as applications that the root depends on, each with links to what it needs. A dependency that several share is one component, marked for development only where all its uses are."""
    keyed = packages.withColumn("_pkg", F.concat(F.lit("ros-package:"), F.concat_ws("@", "package", "version"), F.lit("#"), "source_path"))
    purl = F.concat(F.lit("pkg:ros/"), "package", F.lit("@"), "version")
    own = keyed.select("project", F.col("_pkg").alias("_ref"), F.to_json(F.struct(F.lit("application").alias("type"), F.col("_pkg").alias("bom-ref"), F.col("package").alias("name"), "version", purl.alias("purl"))).alias("_json"))
    uses, shared = _shared(keyed)
    every = own.unionByName(shared.select("project", _bom_ref().alias("_ref"), F.to_json(_cyclonedx_component()).alias("_json")))
    links = uses.select("project", "_pkg", _bom_ref().alias("_ref")).groupBy("project", "_pkg").agg(F.array_join(F.transform(F.array_sort(F.collect_set("_ref")), _text), ",").alias("_needs"))
    linked = own.join(links.withColumnRenamed("_pkg", "_ref"), ["project", "_ref"], "left")
    heads, ref = _content(every, F.col("_json")), F.col("_ref")
    return together(
        fragment(heads, 0, _cyclonedx_head(created)),
        fragment(every, 1, F.col("_json"), ref, COMMA),
        fragment(heads, 2, F.concat(F.lit('],"dependencies":[{"ref":'), _text(_root()), F.lit(',"dependsOn":['))),
        fragment(own, 3, _text(ref), ref, COMMA),
        fragment(heads, 4, F.lit("]}")),
        fragment(linked, 5, F.concat(F.lit(',{"ref":'), _text(ref), F.lit(',"dependsOn":['), F.coalesce("_needs", F.lit("")), F.lit("]}")), ref),
        fragment(heads, 6, F.lit("]}")),
    )


def cyclonedx_ros(packages: DataFrame, created: str) -> DataFrame:
    return assembled(cyclonedx_ros_fragments(packages, created))


def markdown(components: DataFrame, created: str, summary_only: bool = False, edges: DataFrame | None = None, style: str = "tree") -> DataFrame:
    """(project, document): the report in Markdown; of a large project better written by write()."""
    return assembled(report.markdown_fragments(components, created, edges, style, summary_only))


def console(components: DataFrame, created: str, edges: DataFrame | None = None, style: str = "tree", summary_only: bool = False) -> DataFrame:
    """(project, document): the report as plain text."""
    return assembled(report.console_fragments(components, created, edges, style, summary_only))


FORMATS = {"spdx": spdx, "spdx-tv": spdx_tag_value, "cyclonedx": cyclonedx, "markdown": markdown}
#: Endings of the files of a project.
ENDINGS = {"spdx": "_spdx.json", "spdx-tv": "_spdx.spdx", "cyclonedx": "_cyclonedx.json", "markdown": "_report.md"}


def write(components: DataFrame, path: str, created: str, formats: list[str] | None = None, suppliers: DataFrame | None = None, edges: DataFrame | None = None, ros: DataFrame | None = None) -> None:
    """Files <project>_spdx.json, _spdx.spdx, _cyclonedx.json and _report.md below path, which all executors see; all formats unless some are named.

    Projects with ROS packages (ros) get the ROS form of SPDX JSON and CycloneDX, which lists those and what they need, instead of the flat one.
    """
    flat = components if ros is None else components.join(ros.select("project").distinct(), "project", "left_anti")
    for name in formats or FORMATS:
        if name == "spdx":
            made = spdx_fragments(flat, created, suppliers) if ros is None else spdx_fragments(flat, created, suppliers).unionByName(spdx_ros_fragments(ros, created))
        elif name == "cyclonedx":
            made = cyclonedx_fragments(flat, created, suppliers) if ros is None else cyclonedx_fragments(flat, created, suppliers).unionByName(cyclonedx_ros_fragments(ros, created))
        else:
            made = spdx_tag_value_fragments(components, created, suppliers) if name == "spdx-tv" else report.markdown_fragments(components, created, edges)
        write_files(made, path, ENDINGS[name])
