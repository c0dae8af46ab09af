"""The pipeline: every stage over odd rows, and the whole of it over the given tables."""

import corpus_pipeline
from llm_frames import documents, empty_documents, odd_documents, shingles, similar

from ledgerlens.llm import mixing
from ledgerlens.session import BATCH_KEY, materialize

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_over_the_tables(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    frames = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, DATA), name)
        frames[name] = rows
        if name != "sentencepiece":
            assert rows.columns == COLUMNS
    before = {r.doc_id for r in docs.collect()}
    clean = {r.doc_id for r in frames["toxicity"].collect()}
    gone = before - clean
    assert len([i for i in gone if labels.get(i) == 0]) <= 3 and len([i for i in gone if labels.get(i) == 1]) >= 20
    kept = {r.doc_id: shingles(r.text) for r in frames["jaccard_join"].collect()}
    assert kept.keys() < clean
    ids = sorted(kept)
    holders = {}
    for i in ids:
        for j in {j for s in kept[i] for j in holders.get(s, ())}:
            assert not similar(kept[i], kept[j])
        for s in kept[i]:
            holders.setdefault(s, []).append(i)
    redacted = {r.doc_id: r for r in frames["pii"].collect()}
    assert redacted.keys() == kept.keys()
    assert all(r.n_chars == len(r.text) for r in redacted.values())
    assert sum("<EMAIL>" in r.text for r in redacted.values()) > 5
    assert not any("@mail" in r.text for r in redacted.values())
    mixed = frames["mixing"].collect()
    assert {r.doc_id for r in mixed} <= redacted.keys()
    again = mixing.mix_sources(frames["pii"]).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in again)
    encoded = frames["sentencepiece"].collect()
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)
    assert all(r.round_trip for r in encoded)


def test_stages_over_odd_rows(spark):
    rows = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, DATA), f"odd-{name}")
        assert name == "sentencepiece" or set(rows.columns) == set(odd_documents(spark).columns)
    assert rows.count() > 0


def test_stages_over_empty_tables(spark):
    rows = empty_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, DATA), f"empty-{name}")
        assert rows.count() == 0


def test_stages_send_texts_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BATCH_ROWS", 7)
    before = spark.conf.get(BATCH_KEY)
    rows = documents(spark, [f"text {i} of many words, mail a{i}@mail.org" for i in range(100)]).coalesce(1)
    frame = type(rows)
    mapped = frame.mapInArrow

    def small(df, run, *args, **kwargs):
        def checked(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > 7:
                        raise ValueError(f"{batch.num_rows} rows at once")
                    yield batch
            return run(each())
        return mapped(df, checked, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", small)
    for name, stage in corpus_pipeline.STAGES:
        if name in corpus_pipeline.WRITTEN:
            assert materialize(stage(spark, rows, DATA), f"small-{name}").count() == 100
    assert spark.conf.get(BATCH_KEY) == before
