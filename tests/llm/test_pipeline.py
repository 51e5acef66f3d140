"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from msgloom.llm import bpe, language_id, secret_scan
from msgloom.llm.common import staged, table

from test_models_and_pairs import brute_components, brute_sets


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extra = [(90_001, "12345 !!!", "en", "s", 9), (90_002, None, "en", "s", None), (90_003, "", None, None, 0), (None, "the and of to in is it that was", "en", "s", 30)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = staged(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in out.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "language ID":
            assert set(before) - set(after) == {90_001, 90_002, 90_003}
        elif name == "near-dedup":
            sets = brute_sets([(k, r.text) for k, r in before.items() if k is not None], 5)
            roots = brute_components(sets, 80)
            assert set(after) == {k for k in before if k is None or roots[k] == k}
        elif name == "decontamination":
            held = {k for k, r in before.items() if any(i in r.text for i in items)}
            assert held.isdisjoint(after) and len(before) - len(after) - len(held) <= 1
        elif name == "secret scans":
            assert set(after) == set(before)
            for k, r in after.items():
                assert not secret_scan.base_spans(r.text) and r.n_chars == len(r.text)
                assert r.text == before[k].text or secret_scan.base_spans(before[k].text)
        else:
            enc = bpe.encoding()
            assert set(after) == set(before)
            for k, r in after.items():
                assert r.decodes and r.token_ids == enc.encode_ordinary(before[k].text or "") and r.n_tokens == len(r.token_ids)
        docs = out


def test_stages_keep_columns_of_clashing_names(spark, sf_dir):
    """The caller's columns come back as they were, whatever a stage calls its own."""
    own = {"score": F.col("doc_id") / 7, "lang_pred": F.lit("mine"), "benchmark_hits": F.col("doc_id"), "language": F.lit("l"), "__raw": F.lit("r"), "hits_of_part_0": F.lit(1), "words": F.lit("w"), "bucket": F.lit(2), "kept": F.lit(False), "a.b": F.lit("dotted")}
    docs = table(spark, sf_dir, "documents").where("doc_id < 120").withColumns(own)
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns and 0 < out.count()
        for r in out.collect():
            assert all(r[c] == want[r.doc_id][c] for c in docs.columns if c not in ("text", "n_chars")), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < table(spark, sf_dir, "documents").count() and language_id.UNKNOWN not in {r.lang for r in out.collect()}
