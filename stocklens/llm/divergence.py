"""Quality rules: Jensen-Shannon distance of character-class and common-word histograms from language references.

References are sums over the table itself: for each language, the histograms of its documents that pass the base rules. All
of it is column expressions. A document is held against every reference and keeps its smallest distance, so a wrong language
tag does no harm. One whose own language has no reference is judged by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

WINDOW = 8
#: Frequent function words of English, German, Spanish and French, each shown by one character.
COMMON = "the of and to in is that with der die und den zu ist ein nicht el los que de una por con para le les des est une dans pour qui".split()
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
#: Character classes as regular-expression sets; what is in none of them is the last class.
CLASSES = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", ".,;:'\"?()-", "#*$%&|<>!", "äöüßÄÖÜ", "éèêàçùâîôûÉÈÊÀÇ", "áíóúñÁÍÓÚÑ"]
LEAST_WORDS = 1000  # in a language's histogram, to be a reference: chance then moves a distance by less than 0.1, whatever the table's size
CLASS_GUARD, WORD_GUARD = 30, 60  # words that a document needs before a distance counts: chance alone moves a class distance by about 0.1 at 30 words
#: Of 3,286 labelled clean documents past the guards the largest distances are 0.326 and 0.272, and half of the poor ones of 60 to 100 words have 0.346 or more by
#: class. The first limit lies between; the second, at nearly twice the largest, takes texts without the languages' words.
CLASS_LIMIT, WORD_LIMIT = 0.33, 0.50


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by windows that occur twice or more; windows are hashes of WINDOW words at each position."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(order, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    new = let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(new)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, and the two histograms (arrays of counts) of each text."""
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    cut = texts.withColumn("words", text_words(F.col("t"))).withColumn("n_words", F.size("words"))
    hashes = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    codes = F.create_map(*[x for w, c in zip(COMMON, CODES, strict=True) for x in (F.lit(w), F.lit(c))])
    longest = max(map(len, COMMON))
    common = F.array_join(F.transform(F.filter(F.col("words"), lambda w: F.length(w) <= longest), lambda w: F.coalesce(F.try_element_at(codes, w), F.lit(""))), "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    cut = cut.withColumns({"windows": hashes, "common": common, "lines": lines, "bare": F.regexp_replace("t", "[a-z\\x20\\x09-\\x0D]+", "")})
    left = lambda c, inside: F.length(F.regexp_replace(c, f"[^{inside}]+", ""))
    n_chars = F.length("t")
    spaces = n_chars - F.length(F.translate("t", " \t\n\x0b\f\r", ""))
    rare = [left(F.col("bare"), c) for c in CLASSES if c not in ("a-z", r"\x20\x09-\x0D")]
    lower = n_chars - F.col("n_spaces") - F.length("bare")
    cut = cut.withColumns({"n_spaces": spaces, "rare": F.array(*rare), "n_bare": F.length("bare")}).withColumn("lower", lower)
    classes = F.concat(F.array("lower", "n_spaces"), F.col("rare"), F.array(F.col("n_bare") - F.aggregate("rare", F.lit(0), lambda a, x: a + x)))
    held = F.array(*[F.length("common") - F.length(F.replace("common", F.lit(c), F.lit(""))) for c in CODES])
    return cut.select(
        "doc_id",
        "lang",
        F.col("n_words").cast("long").alias("n_words"),
        (n_chars - F.col("n_spaces")).cast("long").alias("word_chars"),
        left(F.col("bare"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        F.concat(held, F.array(F.col("n_words") - F.length("common"))).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, for arrays of shares: 0 for equal ones, 1 for disjoint ones."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: x / F.greatest(n, F.lit(1))))


def judge(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: the base rules pass, and the least
    distances from a reference are within the limits, each as far as the text is long enough for it. Null texts have no
    words and fail. A language has a reference if its documents that pass the base rules hold LEAST_WORDS words; documents of
    other languages are kept by the base rules alone. With no reference at all, distances are null. Rows with null lang make
    no reference but are held against all. Windows are compared by 64-bit hash. Null and repeated doc_ids are ordinary rows.
    """
    found = materialize(measured(docs.select("doc_id", "text", "lang")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)]).alias(name)
    by_lang = found.where("lang is not null and not base_failed").groupBy("lang").agg(F.sum("n_words").alias("n"), sums("classes", len(CLASSES) + 1), sums("common", len(COMMON) + 1))
    # One row with an array of all languages' references: a few hundred bytes for each language.
    large = by_lang.where(F.col("n") >= LEAST_WORDS).select(F.struct("lang", shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common")).alias("r"))
    refs = materialize(large.agg(F.collect_list("r").alias("_refs")))
    nearest = lambda name: let(shares(F.col(name)), lambda p: F.array_min(F.transform("_refs", lambda r: js_distance(p, r[name]))))
    seen = found.join(F.broadcast(refs)).withColumns({"class_distance": nearest("classes"), "word_distance": nearest("common")})
    judged = F.col("lang").isNull() | F.array_contains(F.col("_refs")["lang"], F.col("lang"))
    odd = ((F.col("n_words") >= CLASS_GUARD) & (F.col("class_distance") > class_limit)) | ((F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > word_limit))
    kept = ~F.col("base_failed") & ~F.coalesce(judged & odd, F.lit(False))
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def op1_divergence(spark, sf_dir: str) -> DataFrame:
    """The distances are rounded to six places."""
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _counted(sets: list[str]) -> str:
    return ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))".replace("'\"", "''\"") for c in sets)


#: Distances from the references and the verdict, in SQL.
SQL = rf"""
with texts as (select doc_id, lang, coalesce(text, '') as t from documents),
cut as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
spans as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from cut where len(w) >= {WINDOW})),
twice as (select doc_id, i from spans qualify count(*) over (partition by doc_id, s) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from texts),
repeated as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counted as (
  select doc_id, lang, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(t) as size,
    [{_counted(CLASSES)}] as cl, list_transform({COMMON}, lambda c: len(list_filter(w, lambda x: x = c))) as cw from cut),
measured as (
  select c.*, coalesce(r.n, 0) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words, list_append(cl, size - list_sum(cl)::bigint) as a, list_append(cw, n_words - list_sum(cw)::bigint) as b
  from counted c left join repeated r using (doc_id) left join covered v using (doc_id)),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured),
flat as (select lang, n_words, unnest(a) as x, generate_subscripts(a, 1) as i, 1 as kind from based where not base_failed and lang is not null
  union all select lang, 0, unnest(b), generate_subscripts(b, 1), 2 from based where not base_failed and lang is not null),
sums as (select lang, kind, i, sum(x) as x from flat group by all),
large as (select lang from based where not base_failed and lang is not null group by lang having sum(n_words) >= {LEAST_WORDS}),
refs as (select lang, list(x order by i) filter (kind = 1) as ra, list(x order by i) filter (kind = 2) as rb from sums where lang in (select lang from large) group by lang),
parts as (
  select doc_id, r.lang, kind, p / greatest(sp, 1) as p, q / greatest(sq, 1) as q from (
    select doc_id, r.lang, 1 as kind, unnest(a) as p, list_sum(a) as sp, unnest(ra) as q, list_sum(ra) as sq from based, refs r
    union all select doc_id, r.lang, 2, unnest(b), list_sum(b), unnest(rb), list_sum(rb) from based, refs r) r),
apart as (
  select doc_id, lang, kind, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as d from parts group by all),
nearest as (select doc_id, min(d) filter (kind = 1) as class_distance, min(d) filter (kind = 2) as word_distance from apart group by doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce((lang is null or lang in (select lang from refs))
    and ((n_words >= {CLASS_GUARD} and class_distance > {CLASS_LIMIT}) or (n_words >= {WORD_GUARD} and word_distance > {WORD_LIMIT})), false) as kept,
  round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance
from based left join nearest using (doc_id)
"""
