"""Model files: headers, companions, integrity, and what they become in the documents."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from stocklens.functions import models as M
from stocklens.plans.scan import scan_tree
from stocklens.sinks import bom
from stocklens.sources import models, tree


def string(s):
    raw = s.encode()
    return struct.pack("<Q", len(raw)) + raw


def value(v):
    if isinstance(v, str):
        return struct.pack("<I", 8) + string(v)
    if isinstance(v, list):
        return struct.pack("<IIQ", 9, 8, len(v)) + b"".join(map(string, v))
    return struct.pack("<IQ", 10, v)


def gguf(pairs, tensors, version=3, skipped=True):
    pairs = list(pairs.items()) + ([("tokenizer.ggml.scores", None)] if skipped else [])
    width = "Q" if version == 3 else "I"
    out = b"GGUF" + struct.pack(f"<I{width}{width}", version, len(tensors), len(pairs))
    for k, v in pairs:
        out += string(k) + (struct.pack("<IIQ", 9, 6, 3) + b"\0" * 12 if v is None else value(v))
    for name, dims in tensors:
        out += string(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", 0, 0)
    return out


def safetensors(tensors, form="pt"):
    head = json.dumps({"__metadata__": {"format": form}} | {t: {"dtype": "F16", "shape": [1], "data_offsets": [0, 2]} for t in tensors}).encode()
    return struct.pack("<Q", len(head)) + head + b"\0\0"


README = """---
license: mit
model_creator: 'Some One'
base_model:
- org/base
tags:
- chat
- "q"
language: [en, de]
pipeline_tag: text-generation # kind
prompt_template: |
  User: {prompt}
  Bot:
---
# Title
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("models")
    tensors = [("a", [10, 20]), ("b", [5])]
    whole = gguf({"general.name": "Tiny", "general.architecture": "llama", "general.file_type": 14, "general.size_label": "7B", "general.parameter_count": 205, "general.tags": ["own", "chat"], "general.base_model.count": 2, "general.base_model.0.name": "B0", "general.base_model.1.repo_url": "https://r/1", "general.license": "apache-2.0", "general.source.url": "https://s"}, tensors)
    files = {
        "g/tiny.gguf": whole,
        "g/config.json": json.dumps({"model_type": "llama", "architectures": ["X"], "text_config": {"model_type": "t", "hidden_size": 8, "vocab_size": 100}, "vision_config": {"model_type": "v", "patch_size": 4}, "vocab_size": 7}).encode(),
        "g/README.md": README.replace("\n", "\r\n").encode(),
        "g/tokenizer_config.json": b'{"model_max_length": 1e30, "processor_class": "P"}',
        "cut/model-Q4_K_M.gguf": whole.replace(b"Tiny", b"Tinz")[:-20],
        "cut/v2.gguf": gguf({"general.name": "Two", "general.version": "2.1"}, tensors, 2),
        "cut/no.gguf": b"NOPE" + whole[4:],
        "s/model.safetensors": safetensors(["x", "y"]),
        "s/config.json": b'{"_name_or_path": "org/model", "model_type": "bert", "dtype": "float16", "num_hidden_layers": 3, "vocab_size": 9}',
        "s/generation_config.json": b'{"temperature": 0.5, "top_k": 20}',
        "s/adapter_config.json": b'{"peft_type": "LORA", "base_model_name_or_path": "org/big"}',
        "sharded/a-2.safetensors": safetensors(["y"], "tf"),
        "sharded/a-1.safetensors": safetensors(["x"], "jax"),
        "sharded/model.safetensors.index.json": json.dumps({"metadata": {"total_size": 99}, "weight_map": {"x": "a-1.safetensors", "y": "a-2.safetensors", "z": "a-3.safetensors"}}).encode(),
        "node_modules/z/model.gguf": whole,
    }
    for p, raw in files.items():
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_bytes(raw)
    return top


@pytest.fixture(scope="module")
def found(spark, root):
    files = tree.read_tree(spark, str(root), "demo", "skip").cache()
    return {r.source_path: r for r in models.model_components(files, str(root)).collect()}


def test_gguf(found, root):
    r = found["g/tiny.gguf"]
    assert (r.name, r.version, r.ecosystem, r.license, r.author, r.repository_url) == ("Tiny", "Q4_K_M", "gguf", "Apache-2.0", "Some One", "https://s")
    assert r.checksum_sha256 == hashlib.sha256((root / "g/tiny.gguf").read_bytes()).hexdigest()
    ai = r.ai
    assert (ai.architecture, ai.tensor_count, ai.parameter_count, ai.computed_parameter_count, ai.gguf_version) == ("llama", 2, 205, 205, 3)
    assert (ai.tags, ai.languages, [b.name for b in ai.base_models], ai.base_models[1].repo_url) == (["own", "chat", "q"], ["en", "de"], ["B0", None], "https://r/1")
    assert (ai.hidden_size, ai.vocab_size, ai.model_max_length, ai.processor_class, ai.has_vision, ai.vision_model_type) == (8, 100, None, "P", True, "v")
    assert [(s.modality, s.model_type, s.patch_size) for s in ai.sub_models] == [("text", "t", None), ("vision", "v", 4)]
    assert (ai.pipeline_tag, ai.prompt_template) == ("text-generation", "User: {prompt}\nBot:")


def test_cut_and_old_headers(found):
    cut, two = found["cut/model-Q4_K_M.gguf"], found["cut/v2.gguf"]
    assert (cut.name, cut.ai.computed_parameter_count) == ("Tinz", None) and (two.name, two.version, two.ai.computed_parameter_count) == ("Two", "2.1", 205)
    assert "cut/no.gguf" not in found and not any(p.startswith("node_modules") for p in found)


def test_safetensors(found, root):
    r, s = found["s/model.safetensors"], found["sharded/model.safetensors.index.json"]
    assert (r.name, r.version, r.repository_url, r.ai.tensor_count, r.ai.shard_count, r.ai.torch_dtype, r.ai.num_hidden_layers, r.ai.vocab_size) == ("org/model", "unknown", "https://huggingface.co/org/model", 2, 1, "float16", 3, 9)
    assert (r.ai.generation_temperature, r.ai.generation_top_k, r.ai.is_adapter, r.ai.adapter_type, [b.repo_url for b in r.ai.base_models]) == (0.5, 20, True, "LORA", ["org/big"])
    assert (s.name, s.ai.shard_count, s.ai.total_size_bytes, s.ai.tensor_count, s.ai.safetensors_format) == ("sharded", 3, 99, None, "jax")
    assert s.checksum_sha256 == hashlib.sha256((root / "sharded/model.safetensors.index.json").read_bytes()).hexdigest()
    assert len([p for p in found if p.startswith("sharded")]) == 1


def test_hash_limit(root):
    path = str(root / "g/tiny.gguf")
    assert models.digest(path, 10, 5)[0] is None and "exceeds" in models.digest(path, 10, 5)[1] and models.digest(str(root / "none"), 1, 0)[0] is None


@pytest.mark.parametrize("raw", [b"", b"GGUF", b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + b"\xff" * 40, b"GGUF" + struct.pack("<IQQ", 3, 2**63, 2**63)])
def test_hostile_headers(raw):
    import io

    try:
        facts = models.gguf_facts(io.BytesIO(raw))
    except (EOFError, ValueError, struct.error):
        return
    assert facts["computed"] is None


def test_integrity_and_clamps(spark):
    rows = spark.createDataFrame([(205, 205, "205"), (100, 205, "7B"), (None, 7_100_000_000, "7B"), (None, None, "7B")], "p long, c long, label string")
    ai = M.as_ai({"parameter_count": F.col("p"), "computed_parameter_count": F.col("c"), "size_label": F.col("label")})
    got = [r[0] for r in rows.select(F.size(M.integrity_warnings(ai))).collect()]
    assert got == [0, 2, 0, 0]
    lengths = spark.createDataFrame([(512.0,), (1e30,), (-1.0,), (float("nan"),), (None,)], "v double").select(M.max_length(F.col("v"))).collect()
    assert [r[0] for r in lengths] == [512, None, None, None, None]
    assert spark.range(1).select(F.length(M.clipped(F.repeat(F.lit("é"), 600)))).first()[0] == 515


def test_documents(spark, root):
    found = scan_tree(spark, str(root), "demo").components
    assert found.where("ecosystem in ('gguf', 'safetensors')").count() == 5
    s = json.loads(bom.spdx(found, "2024-01-01T00:00:00Z").first().document)
    ids = {p["SPDXID"]: p for p in s["packages"]}
    parts = [i for i in ids if i.endswith("-sub-0") or i.endswith("-sub-1")]
    assert len(parts) == 2 and all(ids[i]["primaryPackagePurpose"] == "LIBRARY" and "modality=" in ids[i]["sourceInfo"] for i in parts)
    assert all(r["relatedSpdxElement"] in ids for r in s["relationships"])
    c = json.loads(bom.cyclonedx(found, "2024-01-01T00:00:00Z").first().document)
    tiny = next(x for x in c["components"] if x["name"] == "Tiny" and len(x.get("components", [])) == 2)
    assert tiny["type"] == "machine-learning-model" and tiny["modelCard"]["modelParameters"]["task"] == "text-generation"
    assert {"name": "stocklens:ai:quantization", "value": "Q4_K_M"} in tiny["properties"]
    assert any(p["name"] == "stocklens:ai:integrity_warning" and "7B" in p["value"] for p in tiny["properties"])
