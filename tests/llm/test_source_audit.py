import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from stocklens.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_version(rows, least_docs=10):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= least_docs), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]}
            found["term"] = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[: None if part == "pair" else 10], 1)]
    return sorted(out)


def made_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß日XY") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["\U0001f600", "￮", "z"]
    rows = []
    for i in range(300):
        source = rng.choice(["a", "b", "c", "d", None])
        lean = rng.choices(words, [1 + (k % 7 == ord((source or "e")[0]) % 7) * 4 for k in range(len(words))], k=rng.randint(0, 60))
        rows.append((rng.choice([" ", "_", "1", "\n"]).join(lean), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "empty"), ("", "en", "none"), ("one two", "xx", "a"), ("one", "xx", "b"), ("é " * 30000, "en", "a")]
    return rows + rows[:20]


def test_against_plain_version_and_sql(spark, tmp_path):
    rows = made_rows()
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")
    want = plain_version(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for cells in (source_audit.CELLS, 64):
        assert sorted(map(tuple, source_audit.audit(docs, cells=cells).select(columns).collect())) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(base.execute(source_audit.SQL).fetchall()) == want


def test_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_shares_of_huge_counts():
    """Products beyond 64 bits."""
    count, total = np.array([0, 5, 10**13, 123_456_789_012]), 10**13 + 123_456_789_017
    assert source_audit.shares(count, total, 4).tolist() == [1 + 10**9 * (c + 2) // (total + 8) for c in count.tolist()]
