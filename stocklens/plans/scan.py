"""From files to reconciled, classified components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, graph, reconcile
from ..sources import autosar, manifests, models, native, tree
from .tables import stored

KEYS = ("project", "name", "version", "ecosystem")
#: Kinds of files beside those of manifests.kind_of().
HEADS, DEFINITIONS, DIRECTORY, OTHER = "heads", "definitions", "directory", "other"
#: Kinds whose rows may have a directory of their own beside the build file.
C_BUILD = [r"CMakeLists\.txt|.*\.cmake", r".*\.pc", r"configure\.(?:ac|in)", r"Makefile\.am", "[Mm]akefile"]


@dataclass
class Scan:
    components: DataFrame
    edges: DataFrame
    ros: DataFrame  # packages of package.xml files with what they need, in no project without such files
    errors: DataFrame  # project, path, parser, reason: files that their parser could not read

    @property
    def unresolved(self) -> DataFrame:
        """Edges whose child is no component's name."""
        return graph.unresolved_edges(self.components, self.edges, ("project",))


def tagged(files: DataFrame, vendor: str, excludes: list[str]) -> DataFrame:
    """project, path, length, is_dir, inside, text and kind of files (project, path, text), whatever else they have."""
    path, is_dir = F.col("path"), F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False)
    other = F.when(is_dir, DIRECTORY).when(path.rlike(r"\.[ch]$"), HEADS).when(path.endswith(".epd"), DEFINITIONS).otherwise(OTHER)
    length = F.col("length") if "length" in files.columns else F.octet_length("text").cast("long")
    kind = F.when(is_dir, DIRECTORY).otherwise(F.coalesce(manifests.kind_of(path), other))
    return files.select("project", "path", length.alias("length"), is_dir.alias("is_dir"), tree.inside(vendor, excludes).alias("inside"), "text", kind.alias("kind"))


def told() -> list[Column]:
    """What a scan asks of its files as a whole, so that it joins no tables that would be empty."""
    path = F.col("path")
    any_of = lambda condition, name: F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)
    return [
        F.collect_set("kind").alias("kinds"),
        any_of(path.rlike(tree.INSTALLED), "installed"),
        any_of(F.col("inside") & (autosar.in_tree(F.col("is_dir")) | autosar.in_build_file()), "autosar"),
        any_of(path.rlike(r"\.(?:gguf|safetensors)$|(?:^|/)model\.safetensors\.index\.json$"), "models"),
    ]


def linked_versions(components: DataFrame, files: DataFrame, root: str | None, arch: str | None) -> DataFrame:
    """Rows of Makefiles without a version take it from the .mk files, else from the shared objects, of the repository that the Makefile lies in."""
    makefile = tree.name_of(F.col("source_path")).isin(tree.MAKEFILES)
    open_rows = F.coalesce(makefile & (F.col("version") == "unspecified"), F.lit(False))
    asked = components.where(open_rows).withColumn("dir", tree.dir_of(F.col("source_path")))
    placed = tree.repository_roots(files.select("project", "path"), asked)
    repos = placed.select("project", "repo").distinct()
    inside = lambda rows: rows.withColumn("repo", F.explode(tree.ancestors(tree.dir_of(F.col("path"))))).join(repos, ["project", "repo"], "left_semi")
    mk = inside(manifests.mk_libraries(files.where((F.col("kind") == r".*\.mk") & F.col("text").isNotNull()), arch)).groupBy("project", "repo", F.col("name").alias("candidate")).agg(F.max_by("version", "path").alias("version"))
    known, notes = [mk], [".mk file"]
    if root is not None:
        objects = inside(files.drop("text").where(tree.name_of(F.col("path")).rlike(r"\.so$|\.so\.")))
        known.append(native.shared_objects(objects, root, F.col("repo")).withColumnRenamed("name", "candidate"))
        notes.append(".so file")
    filled = reconcile.resolve_versions(placed, reconcile.linked_candidates(F.col("name")), *known, within=("project", "repo"), notes=notes)
    return components.where(~open_rows).unionByName(filled.select(components.columns))


def component_folders(components: DataFrame, files: DataFrame) -> DataFrame:
    """components with component_dir: the folder of a vendored library, or the one that bears the name of a row of a C build system beside its build file."""
    kind, place = manifests.kind_of(F.col("source_path")), tree.dir_of(F.col("source_path"))
    directories = files.where((F.col("kind") == DIRECTORY) & F.col("inside")).select("project", "path")
    keyed = components.withColumn("parent", F.when(kind.isin(C_BUILD), place))
    found = reconcile.component_dirs(keyed, directories)
    vendored = F.when(F.col("ecosystem") == "VENDORED", F.when(tree.name_of(F.col("source_path")).isin("CMakeLists.txt", "library.properties"), place).otherwise(F.col("source_path")))
    return found.select(*components.columns, F.coalesce(vendored, "dir").alias("component_dir"))


def autosar_modules(components: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """classify_autosar() of the rows of AUTOSAR projects only."""
    own = autosar.projects(files.where("inside"))
    return classify.classify_autosar(components.join(own, "project", "left_semi"), modules).unionByName(components.join(own, "project", "left_anti"))


def scan(
    files: DataFrame,
    vendor: str = "include",
    excludes: list[str] = (),
    imports: bool = True,
    scopes: str | None = None,
    production: bool = False,
    root: str | None = None,
    arch: str | None = None,
    metadata: DataFrame | None = None,
    modules: DataFrame | None = None,
    ros_versions: DataFrame | None = None,
    distro: str = "jazzy",
    max_hash_gb: int = 0,
    submodule_depth: int = manifests.SUBMODULE_DEPTH,
    errors: Observation | None = None,
) -> Scan:
    """Components and edges of a table of files (project, path, text). Projects are reconciled apart from each other: their name is part of every key.

    With root, a folder that all executors see, and a listing from read_tree(), models, shared objects and commits of submodules are read
    there. Tables that may be given: metadata of registries (fill_registry_metadata), AUTOSAR modules (classify_autosar), and versions
    of a ROS distribution (resolve_ros_versions). errors is handed to parse_errors().

    The order is: parsing, versions from companions, deduplication, classification, AUTOSAR modules, the scope filter, ROS versions. Version
    tables (.mk, .epd, headers), submodules and vendored libraries are read outside the vendor mode too.
    """
    if vendor not in ("skip", "include", "only"):
        raise ValueError(f"unknown vendor mode: {vendor}")
    # Written once, by kind, so that each parser opens its own files only; what there is is learnt on the way.
    asked = Observation()
    files = stored(tagged(files, vendor, excludes).observe(asked, *told()), "kind")
    seen = asked.get
    kinds = set(seen["kinds"] or ())
    of = lambda *names: files.where(F.col("kind").isin(*names))
    silenced = tree.silenced(of(*manifests.SILENCED, *manifests.SILENCING).where("inside")) if kinds & set(manifests.SILENCING) else None
    vendored = tree.filter_entries(files, "include", excludes)
    found = manifests.components(files, imports, arch, vendored, kinds, silenced, submodule_depth)
    if root is not None and seen["models"]:
        found = found.unionByName(models.model_components(files.where("inside"), root, max_hash_gb))
    if root is not None and r"\.gitmodules" in kinds:
        modules_files = of(r"\.gitmodules")
        found = manifests.with_commits(found, modules_files, native.submodule_commits(modules_files, root))
    found = stored(found)
    raw = reconcile.resolve_ros_versions(found, ros_versions, distro) if ros_versions is not None else found
    ros = manifests.ros_packages(of(r"package\.xml", r"setup\.py").where("inside"), raw)
    if seen["installed"]:
        found = manifests.with_install_metadata(found, of(r"package\.json"))
    if "[Mm]akefile" in kinds:
        found = linked_versions(found, files, root, arch)
    if seen["autosar"]:
        found = autosar.with_versions(found, of(HEADS, DEFINITIONS), autosar.projects(files.where("inside")))
    if metadata is not None:
        found = reconcile.fill_registry_metadata(found, metadata)
    per_project = reconcile.suppress_unspecified(reconcile.suppress_lower_sources(reconcile.dedup_priority(found, KEYS), ("project", "name", "ecosystem")), ("project", "name", "ecosystem"))
    chained = reconcile.suppress_across_ecosystems(per_project, ("project",))
    classified = classify.classify(chained)
    if {r".*\.mk", "[Mm]akefile"} <= kinds or {r".*\.mk", r"meson\.build"} <= kinds:  # rows of BUILD-CONFIG and of system libraries
        classified = reconcile.refine_by_links(stored(classified), ("project",))
    if modules is not None and seen["autosar"]:
        classified = autosar_modules(classified, files, modules)
    scoped = classify.filter_scopes(classified, scopes, production)
    if ros_versions is not None and r"package\.xml" in kinds:
        scoped = reconcile.resolve_ros_versions(scoped, ros_versions, distro)
    if kinds & {*C_BUILD, HEADS}:
        scoped = component_folders(scoped, files)
    else:
        scoped = scoped.withColumn("component_dir", F.lit(None).cast("string"))
    within = files.where("inside")
    return Scan(scoped, manifests.edges(within, kinds), ros, manifests.parse_errors(within, kinds, errors))


def scan_tree(spark: SparkSession, root: str, project: str | None = None, vendor: str = "include", excludes: list[str] = (), installed: bool = True, companions: bool = True, **options) -> Scan:
    """scan() of the tree below root. Directories that vendor and excludes leave out are gone through for version tables, submodules and vendored libraries only, unless companions is false, and for the package.json of installed packages, unless installed is false."""
    return scan(tree.read_tree(spark, root, project, vendor, excludes, installed, companions), vendor, excludes, root=root, **options)


def corrected(found: Scan) -> DataFrame:
    """Components with is_direct_graph: the graph's word on which are direct, beside the manifests' own."""
    return graph.correct_roots(found.components, graph.resolve_edges(found.components, found.edges, ("project",)), ("project",))
