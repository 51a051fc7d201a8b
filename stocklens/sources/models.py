"""Model files: headers and digests are decoded where the files lie, and companion files fill the gaps, in columns.

Only what has no SQL form is Python: the binary headers and the streamed SHA-256 of a file, row by row over a listing. One model is a
.gguf file, or a directory with .safetensors files, of which one header is read and one file hashed, however many shards there are.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions.dictionaries import file_quantization, model_license, quantization
from ..functions.identity import source_info
from ..schema import AI, as_components
from .tree import dir_of, name_of

#: Bounds of what is read.
HEADER_BYTES = 50 << 20
SAFETENSORS_HEADER_BYTES = 100 << 20
KEYS, ARRAY, SKIPPED_ARRAY, DIMENSIONS, DEPTH, BASE_MODELS = 100_000, 1_000_000, 100_000_000, 16, 4, 64
U64 = 2**64 - 1
#: Struct codes of the scalar types of a GGUF value by type number; 8 is a string, 9 an array.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
INDEX = "model.safetensors.index.json"
COMPANIONS = ["config.json", "generation_config.json", "tokenizer_config.json", "preprocessor_config.json", "adapter_config.json"]
READMES = ["README.md", "readme.md", "Readme.md"]
HEADS = "project string, path string, size long, version int, tensor_count long, computed decimal(20,0), format string, text map<string,string>, lists map<string,array<string>>, sha256 string, skipped string"


class Header:
    """Little-endian values of a stream, up to HEADER_BYTES of it."""

    def __init__(self, stream):
        self.stream, self.left = stream, HEADER_BYTES

    def take(self, n: int) -> bytes:
        self.left -= n
        data = self.stream.read(n) if self.left >= 0 else b""
        if len(data) < n:
            raise EOFError
        return data

    def number(self, code: str):
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def string(self) -> str:
        return self.take(self.number("Q")).decode("utf-8", "replace")

    def value(self, kind: int, keep: bool, depth: int = 0):
        """A value; of what is not to be kept only the bytes are passed over."""
        if depth > DEPTH:
            raise ValueError("arrays too deep")
        if kind == 8:
            return self.string()
        if kind != 9:
            return self.number(SCALARS[kind])
        inner, count = self.number("I"), self.number("Q")
        if count > (ARRAY if keep else SKIPPED_ARRAY):
            raise ValueError("array too long")
        if inner in SCALARS and not keep:
            left = count * struct.calcsize("<" + SCALARS[inner])
            while left:
                left -= len(self.take(min(left, 1 << 16)))
            return None
        found = (self.value(inner, keep, depth + 1) for _ in range(count))
        return list(found) if keep else [None for _ in found][:0]


def gguf_facts(stream) -> dict:
    """Facts of a GGUF header of version 2 or 3; a cut one gives what precedes the cut, and no computed count."""
    h = Header(stream)
    if h.take(4) != b"GGUF":
        raise ValueError("not a GGUF file")
    version = h.number("I")
    if version not in (2, 3):
        raise ValueError(f"GGUF version {version}")
    width = "Q" if version == 3 else "I"
    tensors, keys = h.number(width), h.number(width)
    text, lists = {}, {}
    try:
        for _ in range(min(keys, KEYS)):
            key = h.string()
            value = h.value(h.number("I"), key.startswith("general."))
            if not key.startswith("general."):
                continue
            if isinstance(value, list):
                if all(isinstance(v, str) for v in value):
                    lists[key] = value
            else:
                text[key] = value if isinstance(value, str) else str(value).lower()
    except (EOFError, ValueError, KeyError):
        pass
    total, seen = 0, 0
    try:
        for seen in range(tensors + 1):
            if seen == tensors:
                break
            h.string()
            dims, count = h.number("I"), 1
            if dims > DIMENSIONS:
                raise ValueError("too many dimensions")
            for _ in range(dims):
                count = min(U64, count * h.number("Q"))
            h.take(12)  # type and offset
            total = min(U64, total + count)
    except (EOFError, ValueError):
        pass
    return {"version": version, "tensor_count": min(tensors, 2**63 - 1), "computed": Decimal(total) if seen == tensors else None, "text": text, "lists": lists}


def safetensors_facts(stream) -> dict:
    """Format and number of tensors of a safetensors header."""
    size = struct.unpack("<Q", stream.read(8))[0]
    if not 0 < size <= SAFETENSORS_HEADER_BYTES:
        raise ValueError("header size out of range")
    header = json.loads(stream.read(size))
    kind = (header.pop("__metadata__", None) or {}).get("format")
    return {"format": kind, "tensor_count": len(header)}


def digest(path: str, size: int, most: int) -> tuple[str | None, str | None]:
    """SHA-256 of a file read in blocks, or why there is none; most = 0 means no limit."""
    if most and size > most:
        return None, f"file size ({size / (1 << 30):.1f} GB) exceeds the limit"
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest(), None
    except OSError as e:
        return None, f"I/O error: {e}"


def heads(wanted: DataFrame, root: str, max_hash_bytes: int = 0) -> DataFrame:
    """HEADS of files (project, path, length, hashed boolean) below root, a folder that all executors see. Headers that can't be decoded leave their fields null."""

    def run(batches):
        schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("version", pa.int32()), ("tensor_count", pa.int64()), ("computed", pa.decimal128(20, 0)), ("format", pa.string()), ("text", pa.map_(pa.string(), pa.string())), ("lists", pa.map_(pa.string(), pa.list_(pa.string()))), ("sha256", pa.string()), ("skipped", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                at = os.path.join(root, row["path"])
                made = {"project": row["project"], "path": row["path"], "size": row["length"], "text": {}, "lists": {}}
                try:
                    if not row["path"].endswith(".json"):
                        with open(at, "rb") as f:
                            made |= gguf_facts(f) if row["path"].endswith(".gguf") else safetensors_facts(f)
                except (OSError, EOFError, ValueError, KeyError, struct.error, AttributeError, TypeError):
                    pass
                if row["hashed"]:
                    made["sha256"], made["skipped"] = digest(at, row["length"], max_hash_bytes)
                made["text"], made["lists"] = list(made["text"].items()), list(made["lists"].items())
                yield pa.RecordBatch.from_pylist([made], schema=schema)

    return wanted.select("project", "path", "length", "hashed").mapInArrow(run, HEADS)


def companions(files: DataFrame) -> DataFrame:
    """One row for each directory with companion files: project, dir, a column of parsed fields for each of them, and the README's front matter."""
    named = files.where("text is not null").withColumn("_n", name_of(F.col("path"))).where(F.col("_n").isin([*COMPANIONS, *READMES]))
    text = lambda n: F.max(F.when(F.col("_n") == n, F.col("text")))
    readme = F.coalesce(*map(text, READMES))
    parsed = [F.from_json(text(n), M.COMPANION_SCHEMAS[n]).alias(n.removesuffix(".json")) for n in COMPANIONS]
    found = named.groupBy("project", dir_of(F.col("path")).alias("dir")).agg(*parsed, M.front_matter(readme).alias("block"), text("adapter_config.json").isNotNull().alias("adapter"))
    return found.withColumn("card", M.card(F.col("block"))).drop("block")


def _merged(given: dict[str, Column], safetensors: bool) -> Column:
    """The AI struct: what the binary says, else its companions in the order of their columns."""
    config, text = F.col("config"), F.col("config.text_config")
    tokenizer, pre, card = F.col("tokenizer_config"), F.col("preprocessor_config"), F.col("card")
    lists = lambda own, more: F.concat(own, F.array_except(F.coalesce(more, F.array().cast("array<string>")), own))
    none = F.array().cast("array<string>")
    own = lambda name: F.coalesce(given.get(name, none), none)
    base = lambda urls: F.transform(urls, lambda u: F.struct(*(F.lit(None).cast("string").alias(n) for n in ("name", "author", "version", "organization", "url")), u.alias("repo_url")))
    named = given.get("base_models", base(none))
    by_card, by_adapter = F.coalesce(card["base_model"], none), F.coalesce(F.array_compact(F.array(F.col("adapter_config.base_model_name_or_path"))), none)
    processors = (pre["processor_class"], tokenizer["processor_class"]) if safetensors else (tokenizer["processor_class"], pre["processor_class"])
    values = {
        "architecture": F.coalesce(given.get("architecture", F.lit(None)), F.get(config["architectures"], F.lit(0)), config["model_type"]),
        "model_type": config["model_type"],
        "torch_dtype": F.coalesce(config["torch_dtype"], config["dtype"], text["dtype"]),
        "transformers_version": config["transformers_version"],
        "vocab_size": F.coalesce(config["vocab_size"], text["vocab_size"]) if safetensors else text["vocab_size"],
        "num_hidden_layers": F.coalesce(text["num_hidden_layers"], config["num_hidden_layers"]),
        "hidden_size": F.coalesce(text["hidden_size"], config["hidden_size"]),
        "num_attention_heads": F.coalesce(text["num_attention_heads"], config["num_attention_heads"]),
        "context_length": F.coalesce(text["max_position_embeddings"], config["max_position_embeddings"]),
        "model_max_length": M.max_length(tokenizer["model_max_length"]),
        "processor_class": F.coalesce(*processors),
        "image_seq_length": F.coalesce(pre["image_seq_length"], pre["image_processor"]["image_seq_length"]),
        "audio_seq_length": pre["audio_seq_length"],
        "image_processor_type": pre["image_processor"]["image_processor_type"],
        "audio_feature_extractor_type": pre["feature_extractor"]["feature_extractor_type"],
        "audio_sampling_rate": pre["feature_extractor"]["sampling_rate"],
        "video_processor_type": pre["video_processor"]["video_processor_type"],
        "video_num_frames": pre["video_processor"]["num_frames"],
        "has_vision": F.when(config["vision_config"].isNotNull(), True),
        "has_audio": F.when(config["audio_config"].isNotNull(), True),
        "has_video": F.when(pre["video_processor"].isNotNull(), True),
        "vision_model_type": config["vision_config"]["model_type"],
        "audio_model_type": config["audio_config"]["model_type"],
        "generation_temperature": F.col("generation_config.temperature"),
        "generation_top_k": F.col("generation_config.top_k"),
        "generation_top_p": F.col("generation_config.top_p"),
        "model_name": card["model_name"],
        "pipeline_tag": card["pipeline_tag"],
        "quantized_by": card["quantized_by"],
        "prompt_template": M.clipped(card["prompt_template"]),
        "tags": lists(own("tags"), card["tags"]),
        "languages": lists(own("languages"), card["language"]),
        "datasets": lists(own("datasets"), card["datasets"]),
        "base_models": F.when(F.size(named) > 0, named).when(F.size(by_card) > 0, base(by_card)).otherwise(base(by_adapter)),
        "sub_models": M.sub_models(config),
        "is_adapter": F.when(F.col("adapter"), True),
        "adapter_type": F.col("adapter_config.peft_type"),
    }
    return M.as_ai(values | {k: v for k, v in given.items() if k not in values}).cast(AI)


def gguf(files: DataFrame, root: str, max_hash_bytes: int = 0) -> DataFrame:
    """Components of all .gguf files of a listing (project, path, length, text)."""
    wanted = files.where(F.col("path").endswith(".gguf")).withColumn("hashed", F.lit(True))
    rows = heads(wanted, root, max_hash_bytes).where("version is not null").withColumn("dir", dir_of(F.col("path"))).join(companions(files), ["project", "dir"], "left")
    of = lambda key: F.col("text")[f"general.{key}"]
    stem = F.regexp_replace(name_of(F.col("path")), r"\.gguf$", "")
    quant = F.coalesce(F.when(of("file_type").isNotNull(), quantization(of("file_type").try_cast("int"))), file_quantization(stem))
    fields = ["name", "author", "version", "organization", "url", "repo_url"]
    count = F.least(F.coalesce(of("base_model.count").try_cast("int"), F.lit(0)), F.lit(BASE_MODELS))
    at = lambda i, f: F.try_element_at("text", F.concat(F.lit("general.base_model."), i.cast("string"), F.lit(f".{f}")))
    bases = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(*(at(i, f).alias(f) for f in fields)))
    given = {
        "format": F.lit("gguf"), "gguf_version": F.col("version"), "tensor_count": F.col("tensor_count"), "computed_parameter_count": F.col("computed"), "architecture": of("architecture"),
        "description": of("description"), "organization": of("organization"), "basename": of("basename"), "finetune": of("finetune"), "size_label": of("size_label"),
        "parameter_count": of("parameter_count").try_cast("decimal(20,0)"), "source_url": of("source.url"), "source_repo_url": of("source.repo_url"), "license_name": of("license.name"), "license_link": of("license.link"),
        "quantization": quant, "hash_skipped": F.col("skipped"), "base_models": bases, **{k: F.col("lists")[f"general.{k}"] for k in ("tags", "languages", "datasets")},
    }
    return as_components(
        rows,
        name=F.coalesce(of("name"), stem),
        version=F.coalesce(of("version"), quant, F.lit("unknown")),
        ecosystem=F.lit("gguf"),
        author=F.coalesce(of("author"), F.col("card.model_creator")),
        license=model_license(F.coalesce(of("license"), F.col("card.license"))),
        homepage_url=of("url"),
        repository_url=F.coalesce(of("repo_url"), of("source.repo_url"), of("source.url")),
        checksum_sha256=F.col("sha256"),
        source_file=source_info(F.lit("gguf/model"), F.col("path")),
        source_path=F.col("path"),
        ai=_merged(given, False),
        scope_confidence=F.lit(0.9),
        scope_reason=F.lit("AI model file"),
    )


def safetensors(files: DataFrame, root: str, max_hash_bytes: int = 0) -> DataFrame:
    """One component for each directory with .safetensors files. With an index its shards are counted and it is hashed, else the one file that stands for the model."""
    named = files.withColumns({"_n": name_of(F.col("path")), "dir": dir_of(F.col("path"))})
    shards = named.where(F.col("_n").endswith(".safetensors") | (F.col("_n") == INDEX))
    index = F.max_by(F.struct("path", "length", "text"), F.col("_n") == INDEX)
    own = ~(F.col("_n") == INDEX)
    found = shards.groupBy("project", "dir").agg(
        F.bool_or(F.col("_n") == INDEX).alias("indexed"),
        index.alias("index"),
        F.min_by(F.struct("path", "length"), F.when(own, F.struct(F.col("_n") != "model.safetensors", "path"))).alias("single"),
        F.array_sort(F.collect_set(F.when(own, F.col("_n")))).alias("present"),
    )
    weights = F.from_json(F.col("index.text"), "metadata struct<total_size long>, weight_map map<string,string>")
    found = found.withColumn("weights", F.when(F.col("indexed"), weights)).withColumn("declared", F.array_distinct(F.map_values("weights.weight_map")))
    first = F.get(F.array_sort(F.array_intersect("present", "declared")), F.lit(0))
    shard = F.when(F.col("indexed"), F.when(first.isNotNull(), F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), first))).otherwise(F.col("single.path"))
    found = found.withColumns({"header": shard, "target": F.when(F.col("indexed"), F.col("index.path")).otherwise(F.col("single.path"))})
    asked = found.select("project", F.explode(F.array_distinct(F.array_compact(F.array("header", "target")))).alias("path"), "target")
    asked = asked.join(files.select("project", "path", "length"), ["project", "path"]).withColumn("hashed", F.col("path") == F.col("target"))
    read = heads(asked, root, max_hash_bytes)
    head = read.select("project", F.col("path").alias("header"), "format", "tensor_count", "size")
    hashed = read.select("project", F.col("path").alias("target"), "sha256", "skipped")
    rows = found.join(head, ["project", "header"], "left").join(hashed, ["project", "target"], "left").join(companions(files), ["project", "dir"], "left")
    hub = F.col("tokenizer_config._name_or_path")
    name = F.coalesce(F.nullif(F.col("config._name_or_path"), F.lit("")), F.nullif(name_of(F.col("dir")), F.lit("")), F.lit("unknown-model"))
    given = {
        "format": F.lit("safetensors"), "safetensors_format": F.col("format"), "tensor_count": F.when(~F.col("indexed"), F.col("tensor_count")),
        "shard_count": F.when(~F.col("indexed"), 1).otherwise(F.nullif(F.size("declared"), F.lit(0))), "total_size_bytes": F.when(F.col("indexed"), F.col("weights.metadata.total_size")).otherwise(F.col("size")), "hash_skipped": F.col("skipped"),
    }
    return as_components(
        rows,
        name=name,
        version=F.lit("unknown"),
        ecosystem=F.lit("safetensors"),
        author=F.col("card.model_creator"),
        license=model_license(F.col("card.license")),
        repository_url=F.coalesce(F.when(hub.contains("huggingface.co"), hub), F.when(name.rlike("^[^/]+/."), F.concat(F.lit("https://huggingface.co/"), name))),
        checksum_sha256=F.col("sha256"),
        source_file=source_info(F.lit("safetensors/model"), F.col("target")),
        source_path=F.col("target"),
        ai=_merged(given, True),
        scope_confidence=F.lit(0.9),
        scope_reason=F.lit("AI model file (safetensors)"),
    )


def model_components(files: DataFrame, root: str, max_hash_gb: int = 0) -> DataFrame:
    """Components of all models of a listing (project, path, length, text) of root, which all executors see; 0 hashes files of any size."""
    return gguf(files, root, max_hash_gb << 30).unionByName(safetensors(files, root, max_hash_gb << 30))
