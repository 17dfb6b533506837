"""The first of rows that share a position."""


def test_first_row_of_equal_positions_is_the_first_in_the_files(spark, tmp_path):
    from tidemark.plans import text_queries

    each = "array(named_struct('l_partkey', 2 * id, 'l_returnflag', 'A'), named_struct('l_partkey', 2 * id + 1, 'l_returnflag', 'A'))"
    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS l_orderkey", "1 AS l_linenumber", f"inline({each})")
    # the second file has the later ones of two rows; it is larger, so that Spark reads it first
    more = spark.range(10_000, 60_000, 1, 1).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "2 * id + 1 AS l_partkey", "'A' AS l_returnflag")
    rows.where("l_partkey % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/b")
    rows.where("l_partkey % 2 = 0").unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/a")
    for k, part in enumerate("ba"):
        (found,) = (tmp_path / part).glob("*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        found.rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    got = text_queries.consistent_rows(spark, str(tmp_path))
    assert got.count() == 53_000 and got.where("l_partkey != 2 * l_orderkey + 1").count() == 0
