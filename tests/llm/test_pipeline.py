"""The pipeline's rows against brute force, stage by stage on what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import corpus_pipeline
from cases import frame
from test_join_and_leaks import brute_links, brute_tiling, leak_rows
from test_maps import brute_mix, whole

from inkwell.llm import language


def table():
    data, items = leak_rows()
    base = [r[1] for r in data if r[1]]
    texts = [r[1] for r in data] + [base[3], base[3] + " tail", base[5], "12 34 ..", "é"]
    return [(i, t, ["en", "fr"][i % 2], ["s1", "s2", None][i % 3], len(t or ""), "x", 1, 2, 3, "k", 4) for i, t in enumerate(texts) if not t or len(t) < 4000], items


def test_stages_and_run(spark, tmp_path):
    data, items = table()
    sf = str(tmp_path)
    frame(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/{name}")
            out = docs = spark.read.parquet(f"{sf}/{name}")
        seen.append([tuple(r) for r in out.collect()])

    models = [language.Model(k, v) for k, v in language.train(language.learning_rows(spark.read.parquet(f"{sf}/documents.parquet"))).items()]
    rejected = language.classify(pa.array([r[1] for r in data], pa.string()), models)[2]
    kept = [r[:5] for r, x in zip(data, rejected, strict=True) if not x]
    assert Counter(seen[0]) == Counter(kept)

    _, root = brute_links([r[1] for r in kept])
    kept = [kept[i] for i in sorted({min((j for j in range(len(kept)) if root[j] == r), key=lambda j: kept[j][0]) for r in set(root)})]
    assert Counter(seen[1]) == Counter(kept)

    kept = [r for r in kept if not any(brute_tiling(r[1], t, 5) >= 0.6 for _, t in items)]
    assert Counter(seen[2]) == Counter(kept)

    size, by, target = brute_mix(kept)
    times = Counter(r[0] for r in seen[3])
    assert set(seen[3]) <= set(kept) and max(times.values()) <= 3
    for s in by:
        mine = [(n, times[r[0]]) for r, n in zip(kept, size, strict=True) if r[3] == s]
        assert abs(sum(n * t for n, t in mine) - target[s]) <= max((n for n, _ in mine), default=0)

    ids = whole([r[1] for r in seen[3]])
    assert Counter((r[0], r[2], r[3]) for r in seen[4]) == Counter((d[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in zip(seen[3], ids, strict=True))
    assert Counter(tuple(r)[:1] + tuple(r)[2:] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r[:1] + r[2:] for r in seen[4])
