"""The pipeline on the awkward corpus, stage by stage, against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tests.llm.samples import corpus, table
from tests.llm.test_operators import brute_components, brute_fingerprint, token_ids
from themelens.llm.common import stored


def test_each_stage_acts_on_what_the_one_before_kept(spark, tmp_path):
    path = str(tmp_path / "sf")
    table(spark).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), name)
        after[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    rows = corpus()
    lettered = Counter((i, t) for i, t, *_ in rows if any(map(str.isalpha, t or "")))
    assert Counter((r.doc_id, r.text) for r in after["language"]) == lettered
    groups = {}
    for i, t in lettered:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i, t))
    first = Counter(min(g)[3:] for g in groups.values())
    assert Counter((r.doc_id, r.text) for r in after["exact_duplicates"]) == first
    label = brute_components(sorted({brute_fingerprint(t) for _, t in first}))
    best = {}
    for i, t in first:
        x = label[brute_fingerprint(t)]
        best[x] = min(best.get(x, (True, 0, None)), (i is None, i or 0, i))
    assert Counter(r.doc_id for r in after["near_duplicates"]) == Counter(b[2] for b in best.values())
    times = Counter(r.doc_id for r in after["mix"])
    assert max(times.values()) <= 3 and set(times) <= {b[2] for b in best.values()}
    pieces = Counter()
    texts = {r.doc_id: r.text for r in after["mix"]}
    for i, n in times.items():
        pieces[i] = n * -(-(len(token_ids(texts[i])) + 1) // 2048)
    assert Counter(r.doc_id for r in after["pack"]) == pieces


def test_run_applies_all_stages(spark, tmp_path):
    path = str(tmp_path / "sf")
    table(spark).write.parquet(f"{path}/documents.parquet")
    names = {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert set(corpus_pipeline.run(spark, path).columns) == names
