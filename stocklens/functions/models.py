"""Fields of model companions: schemas, front matter, clamps, sub-models and integrity checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AI, SUB_MODEL, columns
from .dictionaries import size_label_count

TEMPLATE = 512  # characters kept of a prompt template
MAX_LENGTH = 2**32 - 1
_SUB = SUB_MODEL.removeprefix("struct<modality string, ").removesuffix(">")
COMPANION_SCHEMAS = {
    "config.json": f"_name_or_path string, architectures array<string>, model_type string, torch_dtype string, dtype string, transformers_version string, vocab_size long, num_hidden_layers long, hidden_size long, num_attention_heads long, max_position_embeddings long, text_config struct<{_SUB}>, vision_config struct<{_SUB}>, audio_config struct<{_SUB}>",
    "generation_config.json": "temperature double, top_k long, top_p double",
    "tokenizer_config.json": "processor_class string, model_max_length double, _name_or_path string",
    "preprocessor_config.json": "processor_class string, image_seq_length long, audio_seq_length long, image_processor struct<image_processor_type string, image_seq_length long>, feature_extractor struct<feature_extractor_type string, sampling_rate long>, video_processor struct<video_processor_type string, num_frames long>",
    "adapter_config.json": "peft_type string, base_model_name_or_path string",
}
#: Fields that a sub-model of each modality takes from its configuration.
SUB_FIELDS = {
    "text": ["model_type", "num_hidden_layers", "hidden_size", "num_attention_heads", "num_key_value_heads", "max_position_embeddings", "vocab_size", "dtype", "intermediate_size"],
    "vision": ["model_type", "num_hidden_layers", "hidden_size", "num_attention_heads", "num_key_value_heads", "max_position_embeddings", "dtype", "intermediate_size", "patch_size", "default_output_length"],
    "audio": ["model_type", "num_hidden_layers", "hidden_size", "num_attention_heads", "num_key_value_heads", "dtype", "intermediate_size", "conv_kernel_size", "output_proj_dims"],
}


def front_matter(readme: Column) -> Column:
    """The block between the '---' lines that a text starts with; null where there is none."""
    plain = F.replace(readme, F.lit("\r\n"), F.lit("\n"))
    return F.nullif(F.regexp_extract(plain, r"(?s)\A---\n(.*?)\n---", 1), F.lit(""))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+#.*$", "")), r"""^(['"])(.*)\1$""", "$2")


def entry(block: Column, key: str) -> Column:
    """A scalar of a flat YAML block: plain, quoted, or an indented block after | or >."""
    folded = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*[|>][-+]?[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z)|\n)+)", 1)
    line = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\s\[|>-][^\n]*)$", 1)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(folded, r"(?m)^[ \t]+", "")), F.lit("")), F.nullif(_bare(line), F.lit("")))


def entries(block: Column, key: str) -> Column:
    """A list of a flat YAML block: items on lines of their own, or between brackets; a scalar is a list of one where the key allows both."""
    lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|\z))+)", 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    items = F.when(lines != "", F.transform(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+([^\n]*)$"), F.lit(1)), _bare)).otherwise(F.transform(F.split(inline, ","), _bare))
    return F.filter(items, lambda x: x != "")


def card(block: Column) -> Column:
    """The fields of a model card's front matter."""
    base = F.when(F.size(entries(block, "base_model")) > 0, entries(block, "base_model")).otherwise(F.array_compact(F.array(entry(block, "base_model"))))
    scalars = [entry(block, k).alias(k) for k in ("license", "model_creator", "model_name", "pipeline_tag", "quantized_by", "prompt_template")]
    return F.when(block.isNotNull(), F.struct(*scalars, base.alias("base_model"), *(entries(block, k).alias(k) for k in ("tags", "language", "datasets"))))


def clipped(text: Column, most: int = TEMPLATE) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def max_length(value: Column) -> Column:
    """A length as a long; null where it is negative, not finite or above 32 bits."""
    return F.when((value >= 0) & (value <= MAX_LENGTH) & ~F.isnan(value), F.floor(value).cast("long"))


def sub_models(config: Column) -> Column:
    """Text, vision and audio parts of a model that has a text part and another one; else none."""
    names = columns(f"modality string, {_SUB}")

    def part(modality):
        given = config[f"{modality}_config"]
        values = {"modality": F.lit(modality)} | {k: given[k] for k in SUB_FIELDS[modality]}
        return F.when(given.isNotNull(), F.struct(*((values[n] if n in values else F.lit(None)).cast(kind).alias(n) for n, kind in names)))

    both = config["text_config"].isNotNull() & (config["vision_config"].isNotNull() | config["audio_config"].isNotNull())
    return F.when(both, F.array_compact(F.array(*map(part, SUB_FIELDS))))


def as_ai(values: dict[str, Column]) -> Column:
    """The AI struct of the component schema with these fields; others are null."""
    names = columns(AI.removeprefix("struct<").removesuffix(">"))
    unknown = set(values) - {n for n, _ in names}
    if unknown:
        raise ValueError(f"not in the schema: {unknown}")
    return F.struct(*((values[n] if n in values else F.lit(None)).cast(kind).alias(n) for n, kind in names))


def integrity_warnings(ai: Column) -> Column:
    """What does not fit together: a declared parameter count other than the computed one, a size label more than 5 % off it."""
    declared, computed = ai["parameter_count"], ai["computed_parameter_count"]
    expected = size_label_count(ai["size_label"])
    count = F.when(declared != computed, F.concat(F.lit("declared parameter_count ("), declared.cast("string"), F.lit(") != computed from tensors ("), computed.cast("string"), F.lit(")")))
    off = (computed < F.floor(expected * 0.95)) | (computed > F.floor(expected * 1.05))
    label = F.when(off, F.concat(F.lit("size_label '"), ai["size_label"], F.lit("' (~"), expected.cast("string"), F.lit(" params) != computed from tensors ("), computed.cast("string"), F.lit(")")))
    return F.array_compact(F.array(count, label))
