import corpus_pipeline
from incrementa.llm.decontam import contamination
from incrementa.llm.exact import exact_groups
from incrementa.llm.simhash import similar_scheme, simhash_groups
from incrementa.llm.toxicity import score_toxicity

from .test_exact_simhash import CUT_AT_END
from .test_tokens_packing import check_packing


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    drops = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns
        expect = {
            "toxicity": lambda d: {r.doc_id for r in score_toxicity(d, labels).where("predicted = 0").collect()},
            "exact_dedup": lambda d: {r.keep_id for r in exact_groups(d).collect()},
            "simhash_dedup": lambda d: {r.component_id for r in simhash_groups(d, similar_scheme()).collect()},
            "decontamination": lambda d: {r.doc_id for r in contamination(d, bench).where("not contaminated").collect()},
        }[name](docs)
        got = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == expect and set(got) < before
        drops.append(len(before) - len(got))
        docs, before = after, set(got)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(drops) and check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), 2048, 0)


def test_edge_rows_pass_through(spark, edge_rows, sf):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in edge_rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 60


def tables(spark, path, docs, labels, bench):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path, edge_rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    none = tables(spark, tmp_path / "none", spark.createDataFrame([], kinds), [], [])
    assert corpus_pipeline.run(spark, none).collect() == []
    # without labels nothing is rejected as toxic, without a benchmark nothing is contaminated
    rows = [(i, t, "en", "s", 1) for i, t in edge_rows if len(t or "") < 5000]
    some = tables(spark, tmp_path / "some", spark.createDataFrame(rows, kinds), [], [])
    docs = spark.read.parquet(f"{some}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, some)
        assert after.columns == docs.columns and (name not in ("toxicity", "decontamination") or after.count() == docs.count())
        docs = after
    # equal texts leave one row each; of near copies the first stays
    assert docs.count() == docs.select("text").na.fill("").distinct().count() > 60
    assert corpus_pipeline.STAGES[-1][1](spark, docs, some).select("doc_id").distinct().count() > 60


def test_columns_of_clashing_names_are_carried(spark, tmp_path, edge_rows, sf):
    extra = ["fp", "h", "n", "m", "s", "part", "row", "node", "root", "rid", "key", "keep_id", "component_id", "item_ids", "count", "piece"]
    rows = [(i, t, *(f"{c}{k}" for c in extra)) for k, (i, t) in enumerate(edge_rows) if len(t or "") < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    texts = {tuple(r[2:]): (r[0], r[1]) for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", *extra]
    kept = docs.collect()
    assert len(kept) > 60 and all(texts[tuple(r)[2:]] == (r.doc_id, r.text) for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(kept)


def test_exact_stage_where_a_batch_ends_in_a_cut(spark, sf):
    rows = [(i, t, "en") for i, t in enumerate(["first", CUT_AT_END, "second", CUT_AT_END])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = corpus_pipeline.exact_dedup(spark, docs, sf).collect()
    assert sorted(tuple(r) for r in got) == [rows[0], rows[2], rows[3]]
