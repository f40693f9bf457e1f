"""Quality rules: base counts and the divergence of histograms from language references.

Everything on the main path is a DataFrame or SQL expression.

Method: each document has a histogram of character classes and one of common
words.  The documents that pass the base rules are summed by language into
reference histograms; a document goes when the Jensen-Shannon distance of
either histogram from its language's reference is above a threshold.  Texts
below ``min_words`` words have too small a sample and are judged by the base
rules alone, as are languages with fewer than ``min_reference_words`` words
(those use the reference pooled over all languages).

Edge cases: a null or blank text has no words, so all counts are 0 and it
fails the base rules.  A null language uses the pooled reference.  Repeated
rows are judged one by one.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import materialize

#: Frequent function words of four languages; other languages use the mixed list.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "de": ["der", "die", "und", "das", "von", "zu", "mit", "den"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "que"],
    "es": ["de", "la", "que", "el", "en", "los", "las", "por"],
}
MIXED = ["the", "of", "der", "und", "le", "et", "el", "los"]
N_COMMON = len(MIXED)

#: References (about 200 bytes a language) are broadcast up to this many languages and joined by a shuffle beyond.
MAX_BROADCAST_ROWS = 10_000

#: lower-case ASCII, white space, upper-case ASCII, digits, symbols, other ASCII, the rest.
CHAR_CLASSES = ["lower", "space", "upper", "digit", "symbol", "punct", "other"]

_BLANK = r"[\\x20\\x09-\\x0D]+"


def _with_counts(df: DataFrame, text: str, lang: str, keep: list[Column]) -> DataFrame:
    """``keep`` as given, then the counts of every row."""
    df = df.select(
        F.struct(*keep).alias("row_"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang_"),
        F.coalesce(F.col(text), F.lit("")).alias("t_"),
    )
    df = df.withColumn("w0_", F.expr(f"split(t_, '{_BLANK}')"))
    df = df.withColumn("w_", F.expr("CASE WHEN w0_[0] = '' OR element_at(w0_, -1) = '' THEN filter(w0_, x -> x <> '') ELSE w0_ END"))
    # Each step takes out one class of characters, so that the later ones see short strings.
    df = df.withColumn("r1_", F.expr(r"regexp_replace(t_, '[a-z\\x20\\x09-\\x0D]+', '')"))
    df = df.withColumn("r2_", F.expr("regexp_replace(r1_, '[A-Z]+', '')"))
    df = df.withColumn("r3_", F.expr("regexp_replace(r2_, '[0-9]+', '')"))
    df = df.withColumn("r4_", F.expr("regexp_replace(r3_, '[#*$%&|<>]+', '')"))
    df = df.withColumn("r5_", F.expr(r"regexp_replace(r4_, '[\\x00-\\x7F]+', '')"))
    df = df.withColumn("word_chars", F.expr("length(concat_ws('', w_))").cast("long"))
    cases = " ".join(f"WHEN '{k}' THEN array({', '.join(f"xxhash64('{w}')" for w in v)})" for k, v in COMMON_WORDS.items())
    df = df.select(
        "row_",
        "lang_",
        "w_",
        F.expr("size(w_)").alias("n_"),
        F.expr("transform(w_, x -> xxhash64(x))").alias("h1_"),
        F.expr(f"CASE lang_ {cases} ELSE array({', '.join(f"xxhash64('{w}')" for w in MIXED)}) END").alias("k_"),
        F.expr("transform(array(filter(split(t_, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), x -> size(x) - size(array_distinct(x)))[0]").cast("long").alias("n_dup_lines"),
        "word_chars",
        (F.length("r3_") - F.length("r4_")).cast("long").alias("n_symbols"),
        F.array(
            F.col("word_chars") - F.length("r1_"),
            F.length("t_") - F.col("word_chars"),
            *(F.length(a) - F.length(b) for a, b in (("r1_", "r2_"), ("r2_", "r3_"), ("r3_", "r4_"), ("r4_", "r5_"))),
            F.length("r5_"),
        ).cast("array<long>").alias("chars_"),
    )
    # Window hashes by doubling: words 1-2, then 1-4, and 1-5 only where four words repeat.
    df = df.withColumn("h2_", F.expr("zip_with(h1_, slice(h1_, 2, n_), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("h4_", F.expr("slice(zip_with(h2_, slice(h2_, 3, n_), (a, b) -> xxhash64(a, b)), 1, greatest(n_ - 3, 0))"))
    df = df.withColumn(
        "h5_",
        F.expr("CASE WHEN size(array_distinct(h4_)) < size(h4_) THEN slice(zip_with(h4_, slice(h1_, 5, n_), (a, b) -> xxhash64(a, b)), 1, greatest(n_ - 4, 0)) ELSE cast(array() AS array<bigint>) END"),
    )
    # Positions of windows found twice or more: sort (hash, position), keep those beside an equal hash, and sum
    # how many words each adds to the one before it.
    repeats = """
        CASE WHEN size(array_distinct(h5_)) = size(h5_) THEN 0L ELSE
          transform(array(sort_array(zip_with(h5_, sequence(0, size(h5_) - 1), (h, p) -> struct(h, p)))), s ->
            transform(array(sort_array(transform(filter(
                zip_with(
                  zip_with(s, slice(s, 2, size(s)), (x, y) -> struct(x.p AS p, x.h AS h, y.h AS after)),
                  concat(array(cast(NULL AS struct<h:bigint, p:int>)), slice(s, 1, size(s) - 1)),
                  (x, y) -> struct(x.p AS p, x.h AS h, x.after AS after, y.h AS before)),
                z -> z.h <=> z.before OR z.h <=> z.after), z -> z.p))), p ->
              aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (t, x) -> t + x))[0])[0] END
    """
    counts = ", ".join(f"n_ - size(array_remove(h1_, k_[{i}]))" for i in range(N_COMMON))
    return df.select(
        "row_",
        "lang_",
        F.col("n_").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(repeats).alias("n_repeat_words"),
        "chars_",
        F.expr(f"cast(array({counts}) AS array<long>)").alias("words_"),
    ).withColumn("words_", F.expr("concat(words_, array(n_words - aggregate(words_, 0L, (t, x) -> t + x)))"))


def _js_distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance (base 2) of two count arrays of one length; 0 where either is empty."""

    def total(a: str) -> str:
        return f"aggregate({a}, 0D, (t, x) -> t + x)"

    def term(a: str, m: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0D END"

    pair = f"zip_with(transform({p}, x -> x / k.tp), transform({q}, x -> x / k.tq), (a, b) -> struct(a, b))"
    body = f"sqrt(greatest(0D, aggregate({pair}, 0D, (t, z) -> t + 0.5D * ({term('z.a', '(z.a + z.b) / 2')}) + 0.5D * ({term('z.b', '(z.a + z.b) / 2')}))))"
    return f"transform(array(struct({total(p)} AS tp, {total(q)} AS tq)), k -> CASE WHEN k.tp > 0 AND k.tq > 0 THEN {body} ELSE 0D END)[0]"


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    keep: list[str] | None = None,
    min_words: int = 50,
    max_char_distance: float = 0.32,
    max_word_distance: float = 0.4,
    min_reference_words: int = 2_000,
) -> DataFrame:
    """Columns ``keep`` (all of the input if None), then counts, distances and verdicts of every row.

    The counts are written once to the shared scratch folder, because the
    references need all of them before the first verdict.  ``keep`` columns go
    along; leave the text out where it isn't needed.  A ``keep`` column whose
    name is one of the results gives way to the result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    stats = materialize(_with_counts(docs, text, lang, [F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none_")]), "quality")
    stats = stats.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    sums = [F.sum(F.col("chars_")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES))] + [F.sum(F.col("words_")[i]).alias(f"w{i}") for i in range(N_COMMON + 1)]
    arrays = [F.array(*(F.col(f"c{i}") for i in range(len(CHAR_CLASSES)))).alias("ref_chars"), F.array(*(F.col(f"w{i}") for i in range(N_COMMON + 1))).alias("ref_words"), "total"]
    good = stats.where(~F.col("base_failed"))
    by_lang = good.groupBy("lang_").agg(*sums, F.sum("n_words").alias("total")).select("lang_", *arrays).where((F.col("total") >= min_reference_words) & (F.col("lang_") != ""))
    pooled = good.groupBy().agg(*sums, F.sum("n_words").alias("total")).select(*(a.alias(n) if isinstance(a, Column) else F.col(a) for a, n in zip(arrays, ("all_chars", "all_words", "total"), strict=True))).drop("total")
    refs = materialize(by_lang.drop("total"), "quality-references")
    refs = F.broadcast(refs) if refs.count() <= MAX_BROADCAST_ROWS else refs
    # The pooled sums are one row: a scalar subquery, not a join.
    out = stats.join(refs, "lang_", "left").withColumn("pooled_", pooled.select(F.struct("all_chars", "all_words").alias("p")).scalar())
    out = out.withColumn("ref_chars", F.coalesce("ref_chars", "pooled_.all_chars")).withColumn("ref_words", F.coalesce("ref_words", "pooled_.all_words"))
    out = out.withColumn("char_distance", F.expr(f"coalesce({_js_distance('chars_', 'ref_chars')}, 0D)"))
    out = out.withColumn("word_distance", F.expr(f"coalesce({_js_distance('words_', 'ref_words')}, 0D)"))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    return out.select(*(F.col("row_")[c].alias(c) for c in names), *made)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LISTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in COMMON_WORDS.items())
_FAR = """SELECT r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS d
  FROM (SELECT r, v::DOUBLE / sum(v) OVER (PARTITION BY r) AS p, ref::DOUBLE / sum(ref) OVER (PARTITION BY r) AS q FROM (
    SELECT r, unnest({v}) AS v, unnest({ref}) AS ref FROM judged)) GROUP BY r"""
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, CASE lang {_LISTS} ELSE {MIXED} END AS k FROM t),
grams AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM grams JOIN (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    [length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(text, '[^\x00-\x7F]|[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))] AS chars,
    list_transform(k, lambda x: len(list_filter(w, lambda y: y = x))) AS commons
  FROM w LEFT JOIN repeats USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_append(commons, n_words - list_sum(commons)) AS words FROM counts),
long AS (SELECT lang, n_words, unnest(range(1, {len(CHAR_CLASSES) + 1})) AS j, chars, words FROM based WHERE NOT base_failed),
long2 AS (SELECT lang, n_words, unnest(range(1, {N_COMMON + 2})) AS j, words FROM based WHERE NOT base_failed),
langs AS (SELECT lang FROM based WHERE NOT base_failed AND lang <> '' GROUP BY lang HAVING sum(n_words) >= 2000),
ref_c AS (SELECT lang, list(s ORDER BY j) AS v FROM (SELECT lang, j, sum(chars[j]) AS s FROM long GROUP BY lang, j) GROUP BY lang),
ref_w AS (SELECT lang, list(s ORDER BY j) AS v FROM (SELECT lang, j, sum(words[j]) AS s FROM long2 GROUP BY lang, j) GROUP BY lang),
all_c AS (SELECT list(s ORDER BY j) AS v FROM (SELECT j, sum(chars[j]) AS s FROM long GROUP BY j)),
all_w AS (SELECT list(s ORDER BY j) AS v FROM (SELECT j, sum(words[j]) AS s FROM long2 GROUP BY j)),
judged AS (
  SELECT b.*, CASE WHEN l.lang IS NULL THEN (SELECT v FROM all_c) ELSE c.v END AS ref_chars, CASE WHEN l.lang IS NULL THEN (SELECT v FROM all_w) ELSE x.v END AS ref_words
  FROM based b LEFT JOIN langs l ON l.lang = b.lang LEFT JOIN ref_c c ON c.lang = b.lang LEFT JOIN ref_w x ON x.lang = b.lang),
far_c AS ({_FAR.format(v="chars", ref="ref_chars")}),
far_w AS ({_FAR.format(v="words", ref="ref_words")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= 50 AND (coalesce(c.d, 0) > 0.32 OR coalesce(x.d, 0) > 0.4)) AS kept
FROM judged LEFT JOIN far_c c USING (r) LEFT JOIN far_w x USING (r)
"""
