"""The pipeline against a plain version of every stage's decisions, each on the stage's own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from relspark.llm import quality_rules
from tests.llm.test_text_operators import ALNUM, AZ, brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, folder):
    r = random.Random(12)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    item = " ".join(r.choice(words) for _ in range(14))

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    docs = [(i, text(r.randrange(30, 90))) for i in range(60)]
    docs += [(100, None), (101, "too short"), (102, "again and again and again " * 20), (103, docs[5][1]), (104, docs[6][1] + " tail")]
    docs += [(110, text(40) + " " + item.upper() + " " + text(10)), (111, text(40) + " token = Zq8Kx2Lm5Np7Rt3Vw9 " + text(10))]
    docs += [(120 + i, text(40) + " password: Example1Example2 " + text(10)) for i in range(5)]
    docs += [(7, docs[7][1])]  # a repeated row
    rows = [(i, t, "en", f"s{n % 4}", len(t or "")) for n, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    item = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near-dedup", "decontamination", "secret scan", "mixing"]

    def ids(df):
        assert df.columns == COLUMNS
        return sorted((r.doc_id, r.text) for r in df.collect())

    kept = corpus_pipeline.quality_stage(spark, docs, folder).cache()
    rules = {(r.doc_id, r.text) for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert set(ids(kept)) == rules and not {100, 101, 102} & {i for i, _ in ids(kept)}
    assert len(ids(kept)) == docs.count() - 3

    once = corpus_pipeline.dedup_stage(spark, kept, folder).cache()
    want = brute_components(ids(kept), corpus_pipeline.SHINGLE)
    assert [i for i, _ in ids(once)] == sorted(i for i, (_, c) in want.items() if i == c)
    assert not {103, 104} & {i for i, _ in ids(once)}

    clean = corpus_pipeline.decontamination_stage(spark, once, folder).cache()
    win = ALNUM.findall(item.translate(AZ))
    grams = {tuple(win[k : k + 10]) for k in range(len(win) - 9)}

    def hit(t):
        w = ALNUM.findall(t.translate(AZ))
        return any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))

    assert ids(clean) == [x for x in ids(once) if not hit(x[1])] and 110 not in {i for i, _ in ids(clean)}

    safe = corpus_pipeline.secrets_stage(spark, clean, folder).cache()
    before, after = dict(ids(clean)), dict(ids(safe))
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {111} and "[SECRET]" in after[111] and "Zq8Kx2" not in after[111]
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    mixed = corpus_pipeline.mixing_stage(spark, safe, folder).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(after)
    assert sum(r.taken for r in mixed) > 0

    out = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixed))


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    make(spark, f"{folder}/full")
    spark.read.parquet(f"{folder}/full/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{folder}/full/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).isEmpty()


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, equal ids of other texts, and extra columns named as the stages name theirs."""
    folder = f"file://{tmp_path}"
    make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = [(None, None, None, None, None), (None, "", None, None, 0), (None, "", None, None, 0), (3, "", "xx", None, 0), (3, None, "en", "s1", None), (9, "another text under an id that is there already " * 3, None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    extra = ["doc", "row_key", "kept", "stays", "live", "clean", "contaminated", "n_words", "size", "taken", "target", "t_", "id_"]
    wide = docs.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("source"), F.lit("-"))).alias(c) for c in extra)).cache()
    before = wide.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder).cache()
        assert out.columns == wide.columns and 0 < out.count() <= before, name
        assert out.where(" OR ".join(f"{c} <> concat('{c}', coalesce(source, '-'))" for c in extra)).isEmpty(), name
        assert stage(spark, wide.limit(0), folder).isEmpty(), name
    rejected = corpus_pipeline.quality_stage(spark, wide, folder)
    assert rejected.where("text IS NULL OR text = ''").isEmpty()
    once = corpus_pipeline.dedup_stage(spark, wide, folder)
    assert once.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    assert once.select("doc_id", "text").distinct().where("text IS NULL OR text = ''").count() == 5  # linked with nothing: (100, null) and those of more, repeats once
    safe = corpus_pipeline.secrets_stage(spark, wide, folder)
    assert safe.count() == before and safe.where("text IS NULL").count() == wide.where("text IS NULL").count()
    mix = corpus_pipeline.mixing_stage(spark, docs, folder)
    assert mix.count() == before and mix.where("size = 0 AND taken > 0").isEmpty()
