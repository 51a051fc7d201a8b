"""Documents over many partitions, the ROS form of CycloneDX, unique ids and the report."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stocklens.schema import as_components
from stocklens.sinks import bom, documents

WHEN = "2024-01-01T00:00:00Z"


def components(spark, n, project="p"):
    rows = spark.range(n).select(F.lit(project).alias("project"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).cast("string").alias("version"), F.lit("npm").alias("ecosystem"), F.lit("f").alias("source_file"), (F.col("id") % 3 == 0).alias("is_dev"), (F.col("id") % 2 == 0).alias("is_direct"))
    return as_components(rows)


def test_large_project_in_named_files(spark, tmp_path):
    """200,000 components of one project and a few of another: four files each, joined from the runs of many tasks."""
    both = components(spark, 200_000, "big").unionByName(components(spark, 3, "a/b"))
    bom.write(both, str(tmp_path), WHEN, ["spdx", "cyclonedx"])
    assert sorted(os.listdir(tmp_path)) == ["a-b_cyclonedx.json", "a-b_spdx.json", "big_cyclonedx.json", "big_spdx.json"]
    big = json.loads((tmp_path / "big_spdx.json").read_text())
    assert len({p["SPDXID"] for p in big["packages"]}) == len(big["packages"]) == 200_001 and len(big["relationships"]) == 200_001
    flat = json.loads((tmp_path / "big_cyclonedx.json").read_text())
    assert len(flat["components"]) == len(set(flat["dependencies"][0]["dependsOn"])) == 200_000
    assert json.loads((tmp_path / "a-b_spdx.json").read_text()) == json.loads(bom.spdx(components(spark, 3, "a/b"), WHEN).first().document)


def test_all_formats_and_both_ways_are_alike(spark, tmp_path):
    some = components(spark, 25)
    bom.write(some, str(tmp_path), WHEN, ["spdx-tv", "markdown"])
    made = {name: make(some, WHEN).first().document for name, make in bom.FORMATS.items() if name in ("spdx-tv", "markdown")}
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {f"p{bom.ENDINGS[name]}": text for name, text in made.items()}


def test_names_that_one_id_would_stand_for(spark):
    rows = spark.createDataFrame([("p", n, "1", "npm") for n in ("a_b", "a-b", "a.b")], "project string, name string, version string, ecosystem string")
    s = json.loads(bom.spdx(as_components(rows), WHEN).first().document)
    assert len({p["SPDXID"] for p in s["packages"]}) == 4


@pytest.fixture(scope="module")
def ros(spark):
    one = as_components(spark.createDataFrame([("p", "gtest", "1", "ros", True), ("p", "gtest", "1", "ros", False), ("p", "mock", "2", "ros", True), ("p", "a_b", "1", "ros", False), ("p", "a-b", "1", "ros", False)], "project string, name string, version string, ecosystem string, is_dev boolean"))
    held = one.withColumn("package", F.when((F.col("name") == "gtest") & ~F.col("is_dev"), "second").otherwise("first"))
    return held.groupBy("project", "package").agg(F.collect_list(F.struct(*one.columns)).alias("dependencies")).select("project", "package", F.lit("0.1").alias("version"), F.concat("package", F.lit("/package.xml")).alias("source_path"), "dependencies")


def test_cyclonedx_of_ros_packages(ros):
    """A dependency that two packages share is one component; one use that is not for development clears its marker; the root depends on packages alone."""
    c = json.loads(bom.cyclonedx_ros(ros, WHEN).first().document)
    by = {x["name"]: x for x in c["components"]}
    dev = lambda n: next(p["value"] for p in by[n]["properties"] if p["name"].endswith(":is_dev"))
    assert len(c["components"]) == 6 and dev("gtest") == "false" and dev("mock") == "true"
    links = {d["ref"]: d["dependsOn"] for d in c["dependencies"]}
    assert sorted(links["root:p"]) == ["ros-package:first@0.1#first/package.xml", "ros-package:second@0.1#second/package.xml"]
    assert links["ros-package:second@0.1#second/package.xml"] == ["ros:gtest@1"] and "ros:gtest@1" in links["ros-package:first@0.1#first/package.xml"]
    assert set(sum(links.values(), [])) <= {x["bom-ref"] for x in c["components"]}


def test_spdx_of_ros_packages(ros):
    s = json.loads(bom.spdx_ros(ros, WHEN).first().document)
    assert len(s["packages"]) == 6 and len({p["SPDXID"] for p in s["packages"]}) == 6 and len(s["documentDescribes"]) == 2
    assert [r["relationshipType"] for r in s["relationships"]] == ["DESCRIBES"] * 2 + ["DEPENDS_ON"] * 5


def test_ros_projects_get_the_ros_form(spark, ros, tmp_path):
    bom.write(components(spark, 4).unionByName(components(spark, 2, "other")), str(tmp_path), WHEN, ["cyclonedx"], ros=ros)
    assert {f: len(json.loads((tmp_path / f).read_text())["components"]) for f in os.listdir(tmp_path)} == {"p_cyclonedx.json": 6, "other_cyclonedx.json": 2}


def test_report_counts_are_the_same_in_both_forms(spark):
    """Edges correct which rows are direct, in the totals of both; a model's facts and checks are told, its template is cut at 80."""
    some = components(spark, 10)
    ai = F.struct(*(value.cast(field.dataType).alias(field.name) if value is not None else F.lit(None).cast(field.dataType).alias(field.name) for field in some.schema["ai"].dataType for value in [{"prompt_template": F.lit("x" * 200), "parameter_count": F.lit(5), "computed_parameter_count": F.lit(6), "size_label": F.lit("7B"), "is_adapter": F.lit(True)}.get(field.name)]))
    model = some.limit(1).withColumns({"name": F.lit("model|one"), "ecosystem": F.lit("gguf"), "ai": ai, "is_direct": F.lit(True), "is_dev": F.lit(False)})
    edges = spark.createDataFrame([("p", "n0@0", "n2", 0), ("p", "n2@2", "n4", 0)], "project string, parent_id string, child_name string, ord int")
    text = bom.console(some.unionByName(model), WHEN, edges).first().document
    marked = bom.markdown(some.unionByName(model), WHEN, edges=edges).first().document
    totals = text.split("Dependencies:")[1].split("\n")[0].strip()
    assert totals == "11 total (5 direct, 2 transitive, 4 dev)" and f"**Dependencies:** {totals}" in marked
    for fact in ("Integrity Check (parameter_count)", "Integrity Check (size_label)"):
        assert f"{fact}: MISMATCH" in text and f"| **{fact}** | MISMATCH" in marked
    assert f"Prompt Template: {'x' * 80}..." in text and "Adapter: yes" in text and "MODEL model|one" in text
    assert "| n3 | 3 | npm | Runtime | direct, dev |" in marked and "```\nn0@0\n" not in text and "n2@2" in marked
    assert marked.count("```") % 2 == 0 and "## NPM: Other Transitive Dependencies" in marked
    assert bom.markdown(some, WHEN, summary_only=True).first().document.count("##") == 1


def test_runs_keep_their_glue(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("p").alias("project"), (F.col("id") % 3).cast("int").alias("part"), F.lpad(F.col("id").cast("string"), 5, "0").alias("key"), F.col("id").cast("string").alias("text"), F.lit(",").alias("glue"))
    documents.write_files(rows.repartition(7), str(tmp_path), ".txt")
    want = "".join(",".join(str(i) for i in range(1000) if i % 3 == part) for part in range(3))
    assert (tmp_path / "p.txt").read_text() == want == documents.assembled(rows).first().document
    assert os.listdir(tmp_path) == ["p.txt"]
