"""The report of a scan: rows of one model, made once from graph-corrected components, and written as plain text or as Markdown.

A row is (project, part, group, block, n, role, name, text): parts are the summary, the ecosystems, the models and the appendix; a group is an
ecosystem or a model; blocks of a group and rows of a block follow by number. What a role looks like is the writers' affair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.models import clipped, size_label_count
from ..operators import graph, stats
from ..operators.stats import SCOPES
from .documents import fragment, together

SUMMARY, ECOSYSTEMS, MODELS, APPENDIX = range(4)
TITLE, COUNTS, LISTED, TREE, DEV_TREE, OTHER_TREE = 0, 1, 2, 3, 4, 6
DISPLAY = 80  # characters of a prompt template that are shown
RULE = "=" * 51


def _corrected(components: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Components whose is_direct is the graph's word, and the resolved edges."""
    c = components.withColumn("project", F.coalesce("project", F.lit("project")))
    if edges is None:
        edges = c.limit(0).select("project", F.lit("").alias("parent_id"), F.lit("").alias("child_name"), F.lit(0).alias("ord"))
    resolved = graph.resolve_edges(c, edges.withColumn("project", F.coalesce("project", F.lit("project"))), ("project",))
    return graph.correct_roots(c, resolved, ("project",)).withColumn("is_direct", F.col("is_direct_graph")), resolved


def _rows(frame: DataFrame, part: int, block: Column | int, role: str, n: Column | int = 0, group: Column | str = "", name: Column | str = "") -> DataFrame:
    """Rows of the model; frame has project and text."""
    col = lambda value: value if isinstance(value, Column) else F.lit(value)
    return frame.select("project", F.lit(part).alias("part"), col(group).alias("group"), col(block).alias("block"), col(n).cast("long").alias("n"), F.lit(role).alias("role"), col(name).alias("name"), F.col("text").cast("string").alias("text"))


def summary_rows(c: DataFrame, created: str) -> DataFrame:
    """Totals, ecosystems, shares of scopes and the mean confidence."""
    direct, percent = F.col("is_direct") & ~F.col("is_dev"), lambda n: F.concat(F.round(100 * n / F.count(F.lit(1)), 0).cast("int").cast("string"), F.lit("%)"))
    text = lambda c: c.cast("string")
    totals = F.concat(text(F.count(F.lit(1))), F.lit(" total ("), text(F.count_if(direct)), F.lit(" direct, "), text(F.count_if(~F.col("is_direct"))), F.lit(" transitive, "), text(F.count_if("is_dev")), F.lit(" dev)"))
    every = F.array_sort(F.collect_set("ecosystem"))
    fields = [("Project", F.first("project")), ("Generated At", F.lit(created)), ("Dependencies", totals), ("Ecosystems", F.concat(text(F.size(every)), F.lit(" ("), F.array_join(every, ", "), F.lit(")")))]
    scopes = [(s, F.concat(text(F.count_if(F.col("scope") == s)), F.lit(" ("), percent(F.count_if(F.col("scope") == s)))) for s in SCOPES]
    scopes.append(("Avg Confidence", F.concat(F.format_number(100 * F.avg("scope_confidence"), 1), F.lit("%"))))
    lists = {"field": fields, "scope": scopes}
    made = c.groupBy("project").agg(*(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("text")) for k, v in some)).alias(role) for role, some in lists.items()))
    title = made.select("project", F.lit("SBOM SUMMARY").alias("text"))
    flat = lambda role: made.select("project", F.posexplode(role).alias("n", "f")).select("project", "n", "f.name", "f.text")
    return reduce(DataFrame.unionByName, [_rows(title, SUMMARY, 0, "title"), _rows(flat("field"), SUMMARY, 1, "field", F.col("n"), name=F.col("name")), _rows(title.withColumn("text", F.lit("Dependency Scopes:")), SUMMARY, 2, "heading"), _rows(flat("scope"), SUMMARY, 3, "scope", F.col("n"), name=F.col("name"))])


def ecosystem_rows(c: DataFrame) -> list[DataFrame]:
    """Title, counts (a row for each way of counting) and the list of distinct packages of each ecosystem."""
    eco = F.col("ecosystem")
    titles = c.groupBy("project", "ecosystem").agg(F.concat(F.upper("ecosystem"), F.lit(" ("), F.count(F.lit(1)).cast("string"), F.lit(" packages)")).alias("text"))
    line = F.concat_ws(", ", F.concat("direct", F.lit(" direct")), F.concat("transitive", F.lit(" transitive")), F.concat("dev", F.lit(" dev")))
    counts = [_rows(stats.ecosystem_counts(c, mode, ("project",)).withColumn("text", line), ECOSYSTEMS, COUNTS, f"counts_{mode}", group=eco) for mode in ("stdout", "markdown")]
    place = F.row_number().over(Window.partitionBy("project", "ecosystem").orderBy("name", "version"))
    listed = c.withColumn("n", place).withColumn("text", F.concat_ws("\x1f", "name", "version", "scope", F.when(F.col("is_direct"), "direct").otherwise("transitive"), F.when(F.col("is_dev"), "dev").otherwise("")))
    return [_rows(titles, ECOSYSTEMS, TITLE, "ecosystem", group=eco), *counts, _rows(listed, ECOSYSTEMS, LISTED, "item", F.col("n"), eco, F.col("name"))]


def tree_rows(c: DataFrame, resolved: DataFrame) -> list[DataFrame]:
    """Trees of direct rows that are no development ones, and for the appendix those of direct development rows and of rows that only others need, with their titles."""
    nodes = graph.node_ids(c).select("project", "ecosystem", F.col("id").alias("root"), "is_direct", "is_dev").groupBy("project", "root").agg(F.min(F.struct("ecosystem", "is_direct", "is_dev")).alias("r")).select("project", "root", "r.*")
    lines = graph.tree_lines(graph.unfold(nodes, resolved, within=("project",)), resolved, within=("project",)).join(nodes, ["project", "root"])
    numbered = lines.withColumn("block", F.when(~F.col("is_direct"), OTHER_TREE).when(F.col("is_dev"), DEV_TREE).otherwise(TREE))
    numbered = numbered.withColumn("n", F.row_number().over(Window.partitionBy("project", "ecosystem", "block").orderBy("path"))).withColumn("text", F.col("line"))
    appendix = numbered.where(F.col("block") > TREE)
    heads = appendix.select("project", "ecosystem", "block").distinct().withColumn("text", F.concat(F.upper("ecosystem"), F.when(F.col("block") == DEV_TREE, ": Development Dependencies").otherwise(": Other Transitive Dependencies")))
    block, eco = F.col("block"), F.col("ecosystem")
    return [_rows(numbered.where(F.col("block") == TREE), ECOSYSTEMS, block, "tree", F.col("n"), eco), _rows(appendix, APPENDIX, block, "tree", F.col("n"), eco), _rows(heads, APPENDIX, block, "heading", 0, eco)]


def model_fields() -> list[tuple[str, Column]]:
    """What the report tells of a model, in order; null for what isn't known."""
    ai = F.col("ai")
    declared, computed, expected = ai["parameter_count"], ai["computed_parameter_count"], size_label_count(ai["size_label"])
    words = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    count = F.when(computed.isNull(), None).when(declared.isNull(), "No declared count: computed only").when(declared == computed, "PASSED: declared matches computed").otherwise(words("MISMATCH: declared ", declared, ", computed ", computed))
    off = (computed < F.floor(expected * 0.95)) | (computed > F.floor(expected * 1.05))
    label = F.when(off, words("MISMATCH: '", ai["size_label"], "' (~", expected, " params), computed ", computed)).when(~off, words("PASSED: '", ai["size_label"], "' consistent with computed ", computed))
    bases = F.array_join(F.transform(ai["base_models"], lambda b: F.concat(F.coalesce(b["name"], F.lit("unknown")), F.coalesce(F.concat(F.lit(" by "), b["organization"]), F.lit("")), F.coalesce(F.concat(F.lit(" ("), b["repo_url"], F.lit(")")), F.lit("")))), "; ")
    kinds = F.array_compact(F.array(F.lit("text"), *(F.when(ai[f"has_{k}"], k) for k in ("vision", "audio", "video"))))
    sub = lambda s: F.concat_ws(", ", F.coalesce(s["model_type"], F.lit("-")), *(F.when(s[k].isNotNull(), F.concat(F.lit(f"{k}="), s[k].cast("string"))) for k in ("num_hidden_layers", "hidden_size", "num_attention_heads", "dtype", "vocab_size", "max_position_embeddings", "patch_size", "default_output_length", "conv_kernel_size", "output_proj_dims")))
    subs = F.array_join(F.transform(ai["sub_models"], lambda s: F.concat(s["modality"], F.lit(": "), sub(s))), "; ")
    plain = lambda **fields: [(k.replace("_", " "), ai[v]) for k, v in fields.items()]
    return [
        ("Ecosystem", F.when(F.col("ecosystem") == "safetensors", "Safetensors (HuggingFace)").otherwise("GGUF")),
        *plain(Architecture="architecture", Quantization="quantization", Size_Label="size_label"),
        ("Parameters (declared)", declared),
        ("Parameters (computed from tensors)", computed),
        ("Integrity Check (parameter_count)", count),
        ("Integrity Check (size_label)", label),
        *plain(Tensor_Count="tensor_count", Shard_Count="shard_count"),
        ("Total Size", F.concat(F.format_string("%.2f", ai["total_size_bytes"] / F.lit(float(1 << 30))), F.lit(" GB"))),
        *plain(Torch_Dtype="torch_dtype", Transformers_Version="transformers_version", Vocab_Size="vocab_size"),
        ("License", F.col("license")),
        ("Author", F.col("author")),
        ("Base Models", F.nullif(bases, F.lit(""))),
        *plain(Description="description", Model_Type="model_type", Hidden_Layers="num_hidden_layers", Hidden_Size="hidden_size", Attention_Heads="num_attention_heads", Context_Window="context_length"),
        ("Modalities", F.when(F.size(kinds) > 1, F.array_join(kinds, ", "))),
        ("Sub-Models", F.nullif(subs, F.lit(""))),
        *plain(Processor_Class="processor_class", Image_Processor="image_processor_type", Audio_Extractor="audio_feature_extractor_type", Video_Processor="video_processor_type", Generation_Temp="generation_temperature"),
        ("Generation Top-K", ai["generation_top_k"]),
        ("Generation Top-P", ai["generation_top_p"]),
        *plain(Pipeline_Tag="pipeline_tag", Quantized_By="quantized_by"),
        ("Prompt Template", clipped(F.regexp_replace(ai["prompt_template"], r"\s*\n\s*", " "), DISPLAY)),
        ("Adapter", F.when(ai["is_adapter"], F.coalesce(ai["adapter_type"], F.lit("yes")))),
    ]


def model_rows(c: DataFrame) -> list[DataFrame]:
    models = c.where("ai is not null").withColumn("group", F.concat_ws("\n", "name", "version", "source_path"))
    fields = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("name"), v.cast("string").alias("text"))) for k, v in model_fields()))
    told = models.select("project", "group", F.posexplode(fields).alias("n", "f")).where("f is not null").select("project", "group", "n", "f.name", "f.text")
    return [_rows(models.withColumn("text", F.col("name")), MODELS, 0, "model", group=F.col("group")), _rows(told, MODELS, 1, "fact", F.col("n"), F.col("group"), F.col("name"))]


def rows(components: DataFrame, created: str, edges: DataFrame | None = None, style: str = "tree", summary_only: bool = False) -> DataFrame:
    """The report's rows. style 'flat' leaves the trees out; edges (project, parent_id, child_name, ord) of a scan correct which rows are direct; trees go to graph.MAX_DEPTH levels."""
    c, resolved = _corrected(components, edges)
    parts = [summary_rows(c, created)]
    if not summary_only:
        parts += [*ecosystem_rows(c), *model_rows(c)]
        if style != "flat":
            parts += tree_rows(c, resolved)
    return reduce(DataFrame.unionByName, parts)


def _key() -> Column:
    return F.concat_ws("\x1f", "group", F.lpad(F.col("block").cast("string"), 2, "0"), F.lpad(F.col("n").cast("string"), 12, "0"), "role")


def _item(i: int) -> Column:
    return F.get(F.split("text", "\x1f", -1), F.lit(i))


def console_fragments(components: DataFrame, created: str, edges: DataFrame | None = None, style: str = "tree", summary_only: bool = False) -> DataFrame:
    """The report as plain text: a line for each row."""
    role = lambda r: F.col("role") == r
    found = rows(components, created, edges, style, summary_only).where("role <> 'counts_markdown'")
    line = (
        F.when(role("title"), F.concat(F.lit(f"{RULE}\n"), "text", F.lit(f"\n{RULE}")))
        .when(role("field"), F.concat(F.rpad(F.concat("name", F.lit(":")), 18, " "), "text"))
        .when(role("scope"), F.concat(F.lit("  "), F.rpad(F.concat("name", F.lit(":")), 16, " "), "text"))
        .when(role("item"), F.concat(F.lit("  "), _item(0), F.lit(" @ "), _item(1), F.when(_item(4) == "dev", " [dev]").otherwise("")))
        .when(role("tree"), F.concat(F.lit("  "), "text"))
        .when(role("model"), F.concat(F.lit("MODEL "), "text"))
        .when(role("fact"), F.concat(F.lit("  "), "name", F.lit(": "), "text"))
        .otherwise(F.col("text"))
    )
    lines = found.select("project", F.lit(0).alias("part"), F.concat(F.col("part").cast("string"), F.lit("\x1f"), _key()).alias("key"), line.alias("text"), F.lit("\n").alias("glue"))
    return together(lines, fragment(lines.where("key like '0%'").select("project").distinct(), 1, F.lit("\n")))


def markdown_fragments(components: DataFrame, created: str, edges: DataFrame | None = None, style: str = "tree", summary_only: bool = False) -> DataFrame:
    """The report in Markdown: tables for packages and models, fences around trees."""
    role = lambda r: F.col("role") == r
    found = rows(components, created, edges, style, summary_only).where("role <> 'counts_stdout'")
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = (
        F.when(role("title"), F.concat(F.lit("# Bill of materials: "), "project", F.lit("\n\n## Summary\n")))
        .when(role("field"), F.concat(F.lit("- **"), "name", F.lit(":** "), "text"))
        .when(role("scope"), F.concat(F.lit("- Scope "), "name", F.lit(": "), "text"))
        .when(role("heading") & (F.col("part") == SUMMARY), F.lit(""))
        .when(role("ecosystem"), F.concat(F.lit("\n## "), "text"))
        .when(role("counts_markdown"), F.concat(F.lit("\n"), "text", F.lit("\n\n| Name | Version | Ecosystem | Scope | Kind |\n| --- | --- | --- | --- | --- |")))
        .when(role("item"), F.concat(F.lit("| "), F.concat_ws(" | ", cell(_item(0)), cell(identity.version_info(_item(1))), "group", _item(2), F.concat_ws(", ", _item(3), F.nullif(_item(4), F.lit("")))), F.lit(" |")))
        .when(role("heading"), F.concat(F.lit("\n## "), "text"))
        .when(role("model"), F.concat(F.lit("\n## Model: "), "text", F.lit("\n\n| Field | Value |\n| --- | --- |")))
        .when(role("fact"), F.concat(F.lit("| **"), "name", F.lit("** | "), cell(F.col("text")), F.lit(" |")))
        .when(role("tree") & (F.col("n") == 1), F.concat(F.lit("\n```\n"), "text"))
        .otherwise(F.col("text"))
    )
    lines = found.select("project", F.lit(0).alias("part"), F.concat(F.col("part").cast("string"), F.lit("\x1f"), _key()).alias("key"), line.alias("text"), F.lit("\n").alias("glue"))
    # A fence's end stands after the last line of its block.
    ends = found.where(role("tree")).select("project", "part", "group", "block").distinct().select("project", F.lit(0).alias("_p"), F.concat_ws("\x1f", F.col("part").cast("string"), "group", F.lpad(F.col("block").cast("string"), 2, "0"), F.lit("999999999999")).alias("key"), F.lit("```").alias("text"), F.lit("\n").alias("glue")).withColumnRenamed("_p", "part")
    return together(lines, ends, fragment(lines.where("key like '0%'").select("project").distinct(), 1, F.lit("\n")))
