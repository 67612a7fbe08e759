"""Keyed updates of a written archive touch the buckets of their rows alone."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import keeping


def files(path):
    return {p.name: p.parent.name for p in path.rglob("part-*.parquet")}


def stored(spark, path, n=500):
    rows = spark.range(n).select(F.format_string("a%03d", "id").alias("id"), F.lit("page").alias("snapshot"), F.lit("text\n").alias("source"), F.when(F.col("id") % 2 == 0, "zh").otherwise("").alias("translation"))
    return keeping.write_archive(rows, str(path))


def change(before, new):
    return keeping.written(before, new)


def test_untouched_files_keep_their_names(spark, tmp_path):
    path = tmp_path / "archive"
    archive = stored(spark, path)
    before = files(path)
    pages = spark.createDataFrame([("a007", "<p>", " seven "), ("new", "<p>", "new")], "id string, snapshot string, source string")
    touched = {f"bucket={r.bucket}" for r in keeping.bucketed(pages).collect()}
    got = {r.id: r for r in keeping.update_archive(archive, str(path), pages, change).collect()}
    after = files(path)
    assert {n for n, b in before.items() if b not in touched} == {n for n, b in after.items() if b not in touched}
    assert not {n for n, b in before.items() if b in touched} & set(after)
    assert len(touched) <= 2 and len(got) == 501
    assert (got["a007"].source, got["a007"].snapshot, got["a007"].translation) == ("seven\n", "<p>", "")
    assert (got["new"].source, got["a006"].source, got["a006"].translation) == ("new\n", "text\n", "zh")
    # Once more with the same pages: the same archive.
    again = keeping.update_archive(archive, str(path), pages, change)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))


def test_null_ids_and_empty_batches(spark, tmp_path):
    path = tmp_path / "archive"
    archive = stored(spark, path, 50)
    schema = "id string, snapshot string, source string"
    before = files(path)
    assert keeping.update_archive(archive, str(path), spark.createDataFrame([], schema), change).count() == 50
    assert files(path) == before
    got = keeping.update_archive(archive, str(path), spark.createDataFrame([(None, "s", "t")], schema), lambda old, new: old.unionByName(new, allowMissingColumns=True))
    assert got.where("id is null").count() == 1


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    path = tmp_path / "archive"
    archive = stored(spark, path)
    rows = archive.select("id", "snapshot", "source").limit(40)
    for buckets in (32, 128):
        with pytest.raises(ValueError, match="buckets"):
            keeping.update_archive(archive, str(path), rows, change, buckets)
