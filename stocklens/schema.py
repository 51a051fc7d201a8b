"""The component relation and the helpers that every operator shares."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUB_MODEL = "struct<modality string, model_type string, num_hidden_layers long, hidden_size long, num_attention_heads long, num_key_value_heads long, max_position_embeddings long, vocab_size long, dtype string, intermediate_size long, patch_size long, default_output_length long, conv_kernel_size long, output_proj_dims long>"
AI = (
    "struct<format string, architecture string, model_type string, quantization string, parameter_count decimal(20,0), computed_parameter_count decimal(20,0), size_label string, "
    "tensor_count long, shard_count long, total_size_bytes long, gguf_version int, safetensors_format string, torch_dtype string, transformers_version string, vocab_size long, "
    "num_hidden_layers long, hidden_size long, num_attention_heads long, context_length long, model_max_length long, processor_class string, image_seq_length long, audio_seq_length long, "
    "image_processor_type string, audio_feature_extractor_type string, audio_sampling_rate long, video_processor_type string, video_num_frames long, has_vision boolean, has_audio boolean, "
    "has_video boolean, vision_model_type string, audio_model_type string, generation_temperature double, generation_top_k long, generation_top_p double, model_name string, pipeline_tag string, "
    "quantized_by string, prompt_template string, description string, organization string, basename string, finetune string, source_url string, source_repo_url string, license_name string, "
    "license_link string, tags array<string>, languages array<string>, datasets array<string>, "
    f"base_models array<struct<name string, author string, version string, organization string, url string, repo_url string>>, sub_models array<{SUB_MODEL}>, "
    "is_adapter boolean, adapter_type string, hash_skipped string>"
)
COMPONENTS = (
    "name string, version string, ecosystem string, source string, source_rank int, is_dev boolean, is_direct boolean, license string, "
    "author string, maintainers array<string>, repository_url string, homepage_url string, source_file string, source_path string, "
    f"checksum_sha256 string, checksum_sha512 string, scope string, scope_confidence double, scope_reason string, ai {AI}, "
    "autosar struct<module_name string, layer string, platform string>, project string, ordinal long"
)
EDGES = "project string, parent_id string, child_name string, ord int"
RANKS = {"LockFile": 3, "Manifest": 2, "ImportScan": 1}
#: Versions that mean "none known".
SENTINELS = ["unspecified", "unknown", "detected"]


def columns(ddl: str = COMPONENTS) -> list[tuple[str, str]]:
    """(name, type) of a list of columns, in order; those of a component unless others are given."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<" or ch == "(") - (ch == ">" or ch == ")")
        if ch == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append((name, kind))
            part = ""
        else:
            part += ch
    return out


def as_components(rows: DataFrame, **values: Column) -> DataFrame:
    """rows in the component schema: given columns by name, columns of rows of that name, defaults for the rest."""
    defaults = {"version": F.lit("unspecified"), "source": F.lit("Manifest"), "is_dev": F.lit(False), "is_direct": F.lit(True), "scope": F.lit("Runtime"), "scope_confidence": F.lit(0.0), "ordinal": F.lit(0).cast("long")}
    picked = {}
    for name, kind in columns():
        value = values.get(name)
        if value is None:
            value = F.col(name) if name in rows.columns else defaults.get(name, F.lit(None))
        picked[name] = value.cast(kind)
    if "source_rank" not in values and "source_rank" not in rows.columns:
        picked["source_rank"] = source_rank(picked["source"])
    return rows.select(*(v.alias(k) for k, v in picked.items()))


def source_rank(source: Column) -> Column:
    rank = F.lit(0)
    for name, value in RANKS.items():
        rank = F.when(source == name, value).otherwise(rank)
    return rank.cast("int")


def version_known(version: Column) -> Column:
    """False for sentinel versions and unexpanded make variables."""
    return ~version.isin(*SENTINELS) & ~version.contains("$(")


def contains_any(value: Column, parts: list[str]) -> Column:
    """One pattern for all parts: a chain of contains() would be copied with every filter that is pushed down."""
    return value.rlike("|".join(map(re.escape, parts)))
