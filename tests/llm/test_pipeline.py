"""The pipeline, stage by stage, against what the operators' definitions ask for."""

import collections
import re

import numpy as np

import corpus_pipeline as P
from colonnade.llm.pieces import lattice

from .conftest import cases, prose
from .test_queries import groups


def docs():
    rows = [(1000 + i, prose(2000 + i, 50), "en", ["a", "b"][i % 2], 1, "k", "f", 1, "z", 0) for i in range(40)]
    near = rows[0][1].split(" ")
    near[3] = "changed"
    rows += [(2000, " ".join(near), "en", "a", 1, "k", "f", 1, "z", 0), (2001, rows[1][1] + "  ", "en", "b", 1, "k", "f", 1, "z", 0)]
    return rows + cases()


def test_stages(spark, write):
    folder = write(docs())
    frame = spark.read.parquet(folder + "/documents.parquet")
    columns, seen = frame.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = frame.collect()
        stage(spark, frame, folder).write.parquet(f"{folder}/stage{k}")
        frame = spark.read.parquet(f"{folder}/stage{k}")
        after = seen[name] = frame.collect()
        if name != P.STAGES[-1][0]:
            assert frame.columns == columns
        if name == "language_id":  # what has no letters goes
            kept = collections.Counter(r.doc_id for r in after)
            assert not kept.keys() & {2, 4, 5, 15} and kept[1000] == 1 and len(after) > 50
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            assert collections.Counter(norm(r.text) for r in after) == collections.Counter({norm(r.text) for r in before})
        if name == "near_dedup":
            keep = {i for i, _, _, k in groups([(r.doc_id, r.text) for r in before], 5) if k}
            assert {r.doc_id for r in after} == keep
        if name == "mixing":
            of = {(r.doc_id, r.text) for r in before}
            times = collections.Counter((r.doc_id, r.text) for r in after)
            assert times.keys() <= of and max(times.values()) <= 2
            size = lambda r: len((r.text or "").split())
            largest = sum(max(size(r) for r in before if r.source == s) for s in {r.source for r in before})
            assert abs(sum(map(size, after)) - 1.5 * sum(map(size, before))) <= largest
        if name == "pieces":
            m = lattice()
            got = collections.Counter((r.doc_id, m.decode(np.array(r.ids))) for r in after)
            assert got == collections.Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in before)


def test_empty(spark, empty):
    assert P.run(spark, empty).collect() == []


def test_stages_on_a_frame_that_is_no_file_scan(spark, corpus):
    scan = spark.read.parquet(corpus + "/documents.parquet")
    frame = spark.createDataFrame(scan.collect(), scan.schema)
    for stage in (P.drop_exact, P.mix):
        got, want = stage(spark, frame, corpus), stage(spark, scan, corpus)
        assert got.columns == scan.columns and got.count() == want.count() > 0
