import re
from collections import Counter

from stocklens.llm.divergence import judge

PLAIN = "the house stands in the quiet street and that man is going to a market with bread of good taste while children play near old trees "


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_verdicts(spark):
    texts = [PLAIN * 1, "a b c\na b c\n\n \nd " * 9, None, "", " \t\n", "x" * 50_000, "#*$ %&|<> " * 30, "ü é ñ " * 10, "q\x85w \xa0e " * 12]
    texts += [" ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(PLAIN.split())) for i in range(40)]
    rows = [(i, t, "en", 1, "z") for i, t in enumerate(texts)] + [(None, PLAIN, None, 1, "z"), (3, PLAIN, "en", 1, "z")]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, words string")).collect()
    assert len(got) == len(rows)
    seen = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in enumerate(texts):
        if i != 3:
            r = seen[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
            assert not (r.base_failed and r.kept)
    assert seen[10].kept and not seen[6].kept


def test_small_languages(spark):
    """Clean documents of a language stay, however small its share is; those of one without a reference too. Odd ones of a large language go."""
    latin = PLAIN.split()
    english = [(i, " ".join(f"{w}{'abcdefghij'[(i + k) % 10]}" if k % 3 else w for k, w in enumerate(latin)), "en") for i in range(6000)]
    letters = "абвгдежзиклмнопрст"
    cyrillic = lambda n: " ".join("".join(letters[(n + k * 7 + j * 3) % 18] for j in range(3 + (n + k) % 4)) for k in range(25))
    rare = [(10_000 + i, cyrillic(i), "ru") for i in range(50)] + [(20_000 + i, cyrillic(i), "uk") for i in range(3)]
    odd = [(30_000, " ".join("#" * (k + 1) + "$%&" * (k % 5) for k in range(30)), "en")]
    got = judge(spark.createDataFrame(english + rare + odd, "doc_id long, text string, lang string"))
    assert [r.doc_id for r in got.where("not kept").collect()] == [30_000]
    # "uk" has no reference here, and none that is near.
    alone = judge(spark.createDataFrame(english[:200] + rare[50:] + odd, "doc_id long, text string, lang string"))
    assert [r.doc_id for r in alone.where("not kept").collect()] == [30_000]


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
