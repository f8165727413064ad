import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.hypergeometric import communication_matrix, draw_hypergeometric, shuffle_into_shards


def test_draws_follow_the_hypergeometric_distribution():
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 4), (300, 100, 50), (10, 0, 3), (0, 9, 2), (3, 4, 7)):
        got = [draw_hypergeometric(rng, good, bad, n) for _ in range(4000)]
        assert min(got) >= max(0, n - bad) and max(got) <= min(n, good)
        assert abs(np.mean(got) - n * good / (good + bad)) < 0.1 * (1 + np.std(got))
        exact = np.random.default_rng(2).hypergeometric(good, bad, n, 4000)
        assert abs(np.std(got) - np.std(exact)) < 0.1 * (1 + np.std(exact))
    assert draw_hypergeometric(rng, 10**11, 10**11, 10**7) > 0


def test_matrix_has_exact_sums():
    rows = [0, 5, 17, 1000, 3, 64]
    matrix = np.array(communication_matrix(rows, 8, 3))
    assert matrix.sum(axis=1).tolist() == rows and (matrix >= 0).all()
    assert set(matrix.sum(axis=0)) <= {sum(rows) // 8, sum(rows) // 8 + 1}


def table(spark, n=5003):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("x").alias("shard"))
    odd = spark.createDataFrame([(None, None, "x"), (None, "", "x"), (3, "t3", "x"), (3, "t3", "x")], "doc_id long, text string, shard string")
    return df.unionByName(odd)


def test_shards_are_exact_and_slots_gapless(spark):
    df = table(spark)
    got = shuffle_into_shards(df, 8, bucket_rows=50)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    rows = got.toPandas()
    assert len(rows) == df.count() and sorted(rows["text"].fillna("null")) == sorted(df.toPandas()["text"].fillna("null"))
    sizes = rows.groupby("shard").size()
    assert sorted(sizes.index) == list(range(8)) and sizes.max() - sizes.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = shuffle_into_shards(df, 8, bucket_rows=50).toPandas()
    assert sorted(map(str, rows.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


def test_order_is_random(spark):
    rows = shuffle_into_shards(table(spark, 8000), 8).toPandas().dropna()
    for _, part in rows.groupby("shard"):
        assert abs((part["doc_id"] < 4000).mean() - 0.5) < 0.07
        assert abs(np.corrcoef(part["doc_id"], part["slot"])[0, 1]) < 0.12
    other = shuffle_into_shards(table(spark, 8000), 8, seed=8).toPandas().dropna()
    both = rows.merge(other, on="doc_id")
    assert abs((both["shard_x"] == both["shard_y"]).mean() - 1 / 8) < 0.03


def test_few_rows_and_none(spark):
    assert sorted(r.slot for r in shuffle_into_shards(table(spark, 0), 8).collect()) == [0] * 4
    assert shuffle_into_shards(table(spark, 5).limit(0), 8).count() == 0


def test_rows_without_an_id_are_spread_evenly(spark):
    df = spark.range(8000).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("doc_id"), F.lit("the same").alias("text"))
    rows = shuffle_into_shards(df.repartition(4, "doc_id"), 8, bucket_rows=64).toPandas()
    null = rows[rows["doc_id"].isna()]
    counts = null.groupby("shard").size().reindex(range(8), fill_value=0)
    assert ((counts - 250) ** 2 / 250).sum() < 30  # chi-square, 7 degrees of freedom
    for _, part in rows.groupby("shard"):
        place = part[part["doc_id"].isna()]["slot"] // 125
        assert place.value_counts().reindex(range(8), fill_value=0).max() < 70


def test_every_placement_is_equally_likely(spark):
    """Against the plain definition: over many seeds, each of a few rows falls into each shard and slot alike."""
    import collections

    df = spark.createDataFrame([(i,) for i in range(6)], "doc_id long").coalesce(2)
    seen = collections.Counter()
    for seed in range(40):
        seen.update((r["doc_id"], r["shard"], r["slot"]) for r in shuffle_into_shards(df, 3, seed).collect())
    counts = np.array([seen[(i, s, t)] for i in range(6) for s in range(3) for t in range(2)])
    assert counts.sum() == 240 and ((counts - 240 / 36) ** 2 / (240 / 36)).sum() < 75


def test_columns_may_have_any_name(spark):
    df = table(spark, 300).drop("shard")
    for name in ("_p", "_row", "_first", "_second", "_number", "_ends", "_start", "_bucket", "_place", "_packed", "SHARD", "slot"):
        df = df.withColumn(name, F.concat(F.lit(name), "text"))
    got = shuffle_into_shards(df, 8)
    assert got.columns == [c for c in df.columns if c not in ("SHARD", "slot")] + ["shard", "slot"]
    wanted = df.select("doc_id", "_p", "_row", "_ends", "_packed").collect()
    assert sorted(map(str, got.select("doc_id", "_p", "_row", "_ends", "_packed").collect())) == sorted(map(str, wanted))


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(i, "x" * (3_000_000 if i == 5 else i)) for i in range(64)], "doc_id long, text string")
    rows = shuffle_into_shards(df, 8).select("doc_id", F.length("text").alias("n"), "shard", "slot").toPandas()
    assert rows.set_index("doc_id")["n"][5] == 3_000_000 and rows.groupby("shard").size().tolist() == [8] * 8


def test_a_table_that_changes_between_reads_is_an_error(spark, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    shuffled = shuffle_into_shards(df, 4)
    import pyarrow as pa
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "t").glob("part-*")
    (tmp_path / "t" / f".{file.name}.crc").unlink(missing_ok=True)
    pq.write_table(pa.table({"doc_id": list(range(150))}), file)
    with pytest.raises(Exception, match="second reading|FILE_NOT_EXIST|read"):
        spark.catalog.refreshByPath(path)
        shuffled.collect()
