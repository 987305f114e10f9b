"""The pipeline stage by stage against brute force, and on odd inputs."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from ledgerweave.llm import mixing, queries, toxicity
from tests.llm.test_operators import ODD, components, low, plain_fingerprint

SF = "/root/testdata/sf0.001"
NAMES = ("score", "fp", "cls", "size", "copies", "nth", "many", "digit", "row_text", "order", "keep")


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    clean = stages["toxicity"](spark, docs, SF).cache()
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}

    single = stages["exact_dedup"](spark, clean, SF).cache()
    last = {}
    for r in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        last[low(r["text"])] = r["doc_id"]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())

    apart = stages["simhash"](spark, single, SF).cache()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in single.collect()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(set(components(links, prints).values()))

    mixed = stages["mixing"](spark, apart, SF).cache()
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(apart).collect()}
    assert mixed.columns == docs.columns and collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({i: n for i, n in plan.items() if n})

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    ids = {r["doc_id"]: library.encode(r["text"]) for r in mixed.collect()}
    rows = stages["sentencepiece"](spark, mixed, SF).collect()
    assert len(rows) == mixed.count() and all(r["ids"] == ids[r["doc_id"]] for r in rows)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["ids_crc32"]) for r in rows)


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_inputs_pass_every_stage(spark, tmp_path, kind):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame([(*r[:5], *["x"] * len(NAMES)) for r in ODD] if kind == "odd" else [], schema)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 1, 1), (4, 0, 0), (4, 0, 0), (5, 1, 0), (6, 1, 0), (9, 1, 0), (10, 0, 1)] if kind == "odd" else [], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage-{k}"))
    assert (now.count() > 0) == (kind == "odd") and np.all([r["n_ids"] == len(r["ids"]) for r in now.collect()])
