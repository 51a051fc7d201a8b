import hashlib
import re

import duckdb
import pytest

from stocklens.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "word", " lead", "tail \n\t", "a  b\r\nc\x0b\x0c d ", "a <P> mark", "x<S>", "<M>", "<", "< <", "a< b<S c<P d<M e", "日本 語 x \U0001f600\U0001f600 z", "word " * 5000, "\n\n\n", "naïve line café"]


def plain_version(doc_id, text, seed=42, tokens=TOKEN.findall):
    """The transformation of one text, by the tokens themselves."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = tokens(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(spark, n=400):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(n)] + [(3, "word"), (3, "word"), (None, "some words"), (None, None)]
    return rows, spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, output string")


def key(r):
    return str(r)


def test_against_tokens(spark):
    rows, docs = rows_of(spark)
    got = fill_middle.fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [(d, *plain_version(d, t)) for d, t in rows]
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_texts_come_back(spark):
    rows, docs = rows_of(spark)
    from pyspark.sql import functions as F

    made = fill_middle.fill_in_middle(docs, rate=100, spm_rate=50)
    back = made.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=key) == sorted(((d, t or "") for d, t in rows), key=key)


@pytest.mark.parametrize("unit,tokens", [("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)), ("character", list)])
def test_other_units(spark, unit, tokens):
    rows, docs = rows_of(spark, 120)
    got = fill_middle.fill_in_middle(docs, unit, seed=7)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((d, *plain_version(d, t, 7, tokens)) for d, t in rows), key=key)


def test_empty_table_and_sql(spark, tmp_path):
    rows, docs = rows_of(spark)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = base.execute(fill_middle.SQL)
    names = [d[0] for d in found.description]
    got = fill_middle.op11_fill_in_middle(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(found.fetchall(), key=key)
