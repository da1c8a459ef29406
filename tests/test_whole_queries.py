"""Queries over whole tables against brute force and SQL."""

import duckdb

from tessella.plans import queries as q


def test_components_read_every_line_item(spark, sf_dir):
    got = {r.node: r.component for r in q.QUERIES["graph_components"](spark, sf_dir).collect()}
    db = duckdb.connect()
    edges = db.execute(
        f"SELECT DISTINCT o_custkey, l_suppkey + 1000000000 FROM '{sf_dir}/orders.parquet' JOIN '{sf_dir}/lineitem.parquet' ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL"
    ).fetchall()
    least = {v: v for e in edges for v in e}

    def root(v):
        while least[v] != v:
            v = least[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    assert got == {v: root(v) for v in least}


def test_suffix_numbers_have_no_bound(spark, tmp_path):
    spark.range(1, 2001).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 1201).selectExpr("id AS s_suppkey", "id % 7 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.partition, r.number, r.contig) for r in q.QUERIES["suffix_assignment"](spark, str(tmp_path)).collect()}
    assert got == {(n % 7, str(n), f"customer_0_{n}") for n in range(1, 1001)}
    sql = q.ORACLES["suffix_assignment"]
    db = duckdb.connect()
    for t in ("customer", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert set(db.execute(sql).fetchall()) == got
