"""Base tables of the catalog."""

from recordloom.catalog import load, registry


def test_people_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    many = spark.range(9_000).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").coalesce(1)
    many.write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").write.parquet(str(tmp_path / "nation.parquet"))
    df = registry.dirty(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    assert df.count() == 9_000 and df.select("row_id").distinct().count() == 9_000


def test_pieces_of_large_tables_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(registry, "PIECE_ROWS", 100)
    assert registry.spread(spark.range(0, 5_000, 1, 1)).rdd.getNumPartitions() == 50
    assert registry.spread(spark.range(0, 50, 1, 1)).rdd.getNumPartitions() == 1


def test_a_query_that_reads_people_once_computes_no_more_than_it_reads(spark):
    load()
    for key, unread in (("infer_last", "_t_wilaya"), ("revalidate_dob", "_t_name"), ("normalize_location", "_t_email"),
                        ("export_projection", "_t_userType"), ("default_picture", "_t_wilaya"), ("missing_fields", "_t_preferences")):
        df = registry.QUERIES[key](spark, "/root/testdata/sf0.001")
        # The given tables are read, and no copy of all columns that was written before.
        assert not any("/composed-" in file for file in df.inputFiles()), key
        assert unread not in df._jdf.queryExecution().optimizedPlan().toString(), key


def test_the_rows_of_a_grid_are_all_written_out(spark):
    """More rows than the customary limits leave: every filled one, as often as it is repeated."""
    load()
    folder = "/root/testdata/sf0.01"
    filled = registry.grid(spark, folder).where("exists(cells, c -> coalesce(c.text, '') <> '')")
    whole = filled.selectExpr("sum(greatest(1, coalesce(try_cast(row_repeat as int), 1))) as n").first()["n"]
    assert whole > 50_000 and registry.QUERIES["grid_row_cap"](spark, folder).count() == whole
