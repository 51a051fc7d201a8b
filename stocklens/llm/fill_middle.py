"""Fill-in-middle: texts are cut at zero-width boundaries between two character classes, and the middle run of units moves to the end.

A unit grammar is two neighbouring classes: a text is cut wherever a character of the first stands before one of the second. As
a lookaround pattern matches no characters, Spark's split() gives back every character of the text, in pieces that are the units. An
empty text, of which split() would make one empty piece, has no units. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"


def boundary(before: str, after: str) -> str:
    """The zero-width pattern between a character of one set and one of the other; sets as inside brackets."""
    return f"(?<=[{before}])(?=[{after}])"


#: Unit grammars. A word takes the white space before it along, and white space at the end of a text is a unit; a line takes its line feed along.
UNITS = {"word": boundary(f"^{SPACE}", SPACE), "line": boundary(r"\n", r"\x{0}-\x{10FFFF}"), "character": boundary(r"\x{0}-\x{10FFFF}", r"\x{0}-\x{10FFFF}")}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 50, 80  # per cent of texts that are transformed, and of those that lead with the suffix


def units_of(text: Column, unit: str = "word") -> Column:
    """The units of a text, in order; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS[unit], -1))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made output from. No mark starts with a part that another ends with, so marks are found even beside a '<' of the text."""
    part = lambda c, mark, n: F.split_part(c, F.lit(mark), F.lit(n))
    rest = part(output, SUFFIX, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), part(rest, MIDDLE, 2), part(rest, MIDDLE, 1))
    moved = part(output, PREFIX, 2)
    spm = F.concat(part(moved, MIDDLE, 1), part(moved, MIDDLE, 2), part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "word", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of each row of docs (doc_id, text).

    Four numbers from the hash of seed and doc_id choose both cuts, whether the text is transformed, and its form, so that a row's
    result depends on that row alone, whatever the partitions. Texts that are empty or hold a mark stay plain, with null
    lengths. Null texts count as empty; a null doc_id is hashed as an empty one; repeated rows are ordinary rows and come out
    alike; other columns are ignored, and an empty table gives no rows. A text of any length is one row and one array of its units.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("_hash"))
    number = lambda i: F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.select("doc_id", "text", units_of(F.col("text"), unit).alias("_units"), *(number(i).alias(f"_h{i + 1}") for i in range(4)))
    rows = rows.withColumn("n", F.size("_units").cast("long"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")
    cut = lambda h: (F.col(h) % (F.col("n") + 1)).cast("int")
    rows = rows.withColumns({"form": form, "_a": F.least(cut("_h1"), cut("_h2")), "_b": F.greatest(cut("_h1"), cut("_h2"))})
    run = lambda start, length: F.array_join(F.slice("_units", start, length), "")
    moved = F.col("form") != "plain"
    pieces = {"_prefix": run(F.lit(1), F.col("_a")), "_middle": run(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_suffix": run(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b"))}
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(moved, p).alias(k) for k, p in pieces.items()))
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", F.length("_prefix").cast("long").alias("prefix_chars"), F.length("_middle").cast("long").alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The units by the grammar of tokens itself, not by boundaries; the text as it was stands for what is restored.
SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
cut as (
  select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from texts),
placed as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from cut),
formed as (
  select doc_id, t, n, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from placed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from formed
"""
