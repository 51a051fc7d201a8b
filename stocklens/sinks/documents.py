"""Documents made of fragments: rows that stand in an order and are joined into one file each, however many partitions hold them.

A fragment is (project, part, key, text, glue): parts follow each other by number, the fragments of a part by key, with glue between two
neighbours of one part. assembled() makes a document one string, for projects whose documents are small; write_files() writes files by a
Python data source whose tasks write runs of fragments in order, and whose commit joins the runs.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FRAGMENTS = "file string, part int, key string, text string, glue string"


def fragment(rows: DataFrame, part: int, text: Column, key: Column | None = None, glue: str = "") -> DataFrame:
    return rows.select("project", F.lit(part).alias("part"), (F.lit("") if key is None else key).alias("key"), text.alias("text"), F.lit(glue).alias("glue"))


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def assembled(fragments: DataFrame) -> DataFrame:
    """(project, document): each document as one string, gathered in one row."""
    grouped = fragments.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("part", "key", "text", "glue"))).alias("_all"))
    before = lambda x, i: F.when(F.get("_all", i - 1)["part"] == x["part"], x["glue"]).otherwise("")
    return grouped.select("project", F.array_join(F.transform("_all", lambda x, i: F.concat(before(x, i), x["text"])), "").alias("document"))


@dataclass
class Run:
    """Fragments of one file that one task has written: where they begin, the parts at both ends, and the glue of the first."""

    file: str
    start: tuple
    first: int
    last: int
    glue: str
    path: str


@dataclass
class Runs(WriterCommitMessage):
    runs: list


class DocumentWriter(DataSourceWriter):
    """Writes below options['path'], which the driver and all executors see. A task's rows come sorted by file, part and key."""

    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.scratch = f"{self.folder}/.{options['run']}"

    def write(self, rows):
        os.makedirs(self.scratch, exist_ok=True)
        runs, out = [], None
        try:
            for r in rows:
                if not runs or runs[-1].file != r.file:
                    if out:
                        out.close()
                    runs.append(Run(r.file, (r.part, r.key), r.part, r.part, r.glue, f"{self.scratch}/{uuid.uuid4().hex}"))
                    out = open(runs[-1].path, "w", encoding="utf-8", newline="")
                elif runs[-1].last == r.part:
                    out.write(r.glue)
                out.write(r.text)
                runs[-1].last = r.part
        finally:
            if out:
                out.close()
        return Runs(runs)

    def commit(self, messages):
        """Joins the runs of each file in order, one stream at a time; a file is put in place when it is whole."""
        runs = sorted((run for m in messages if m for run in m.runs), key=lambda run: (run.file, run.start))
        for i, run in enumerate(runs):
            whole, starts = f"{self.scratch}/{run.file}", i == 0 or runs[i - 1].file != run.file
            with open(whole, "wb" if starts else "ab") as out, open(run.path, "rb") as part:
                if not starts and runs[i - 1].last == run.first:
                    out.write(run.glue.encode())
                shutil.copyfileobj(part, out, 1 << 20)
            if i + 1 == len(runs) or runs[i + 1].file != run.file:
                os.replace(whole, f"{self.folder}/{run.file}")
        shutil.rmtree(self.scratch, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.scratch, ignore_errors=True)


class DocumentSource(DataSource):
    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return FRAGMENTS

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options)


def write_files(fragments: DataFrame, folder: str, ending: str) -> None:
    """One file <project><ending> for each project below folder, which all executors see; slashes in a project's name become dashes. Fragments are sorted over all partitions, and no document is gathered in a row or a task."""
    fragments.sparkSession.dataSource.register(DocumentSource)
    rows = fragments.select(F.concat(F.replace("project", F.lit("/"), F.lit("-")), F.lit(ending)).alias("file"), F.col("part").cast("int").alias("part"), "key", "text", "glue")
    ordered = rows.repartitionByRange("file", "part", "key").sortWithinPartitions("file", "part", "key", "text")
    ordered.write.format("documents").option("run", uuid.uuid4().hex).mode("append").save(folder)
