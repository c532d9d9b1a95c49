"""The pipeline against the same stages done by plain loops."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from foliolens.llm import language_id, quality_rules, secret_scan, simhash_vp
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_loops(spark):
    docs = table(spark, SF, "documents")
    rows = docs.toPandas().sort_values("doc_id")
    profiles = language_id.fit_profiles(docs)
    kept = rows[[p != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE for p, s in map(profiles.predict, rows.text)]]
    frame = docs.where(docs["doc_id"].isin([int(i) for i in kept.doc_id]))
    model = quality_rules.fit_quality(frame, table(spark, SF, "labels"))
    stats = quality_rules.with_statistics(frame).select("doc_id", "_statistics.*").toPandas().set_index("doc_id").loc[kept.doc_id]
    kept = kept[model.score_rows(stats[list(quality_rules.STATISTICS)].to_numpy(float)) >= corpus_pipeline.LEAST_QUALITY]
    fps = [simhash_vp.fingerprint(t) for t in kept.text]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = kept[[g == i for i, g in enumerate(group)]]
    assert 0 < len(kept) < len(rows)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(kept.doc_id)
    from foliolens.llm import packing

    ids = packing.encoder(packing.default_vocabulary()).encode([secret_scan.redacted(t, secret_scan.find_secrets(t)) for t in kept.text])
    wanted = {int(i): len(x) // 2 + 1 for i, x in zip(kept.doc_id, ids, strict=True)}
    assert wanted == got.groupby("doc_id").length.sum().to_dict()
    total = sum(wanted.values())
    assert got.sequence_id.max() == (total - 1) // packing.WINDOW
    assert np.isin(got.sequence_id, range(got.sequence_id.max() + 1)).all()


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
