"""Stand-ins for a code repository, made from the driver's tables; the same expressions in Spark SQL and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = (
    "concat(source, '/', lang, '/', CASE CAST(doc_id % 12 AS INT) WHEN 0 THEN 'models.py' WHEN 1 THEN 'test_views.py' WHEN 2 THEN 'views.py' "
    "WHEN 3 THEN 'tests/helpers.ts' WHEN 4 THEN 'Panel.tsx' WHEN 5 THEN 'README.md' WHEN 6 THEN 'api.spec.js' WHEN 7 THEN 'conftest.py' "
    "WHEN 8 THEN 'settings.toml' WHEN 9 THEN 'generated/types.d.ts' WHEN 10 THEN 'Makefile' ELSE concat('m', CAST(doc_id AS STRING), '.py') END)"
)
#: One row per document as a file; one per document as a chunk.
FILES_SQL = f"(SELECT doc_id, {PATH} AS file_path, text AS content, octet_length(encode(text)) AS size_bytes FROM documents)"
#: A typed graph: orders to customers, customers and suppliers to nations, nations to regions, parts to suppliers by line items.
EDGES_SQL = (
    "(SELECT concat('orders/y', CAST(o_orderkey % 9 AS STRING), '.py::Order', CAST(o_orderkey AS STRING)) AS source_entity, 'has_fk' AS relationship, "
    "concat('sales/customers.py::Customer', CAST(o_custkey AS STRING)) AS target_entity FROM orders "
    "UNION SELECT concat('sales/customers.py::Customer', CAST(c_custkey AS STRING)), 'imports', concat('geo/nations.py::', n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "UNION SELECT concat('supply/generated/suppliers.py::Supplier', CAST(s_suppkey AS STRING)), 'calls', CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE concat('geo/nations.py::', n_name) END FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "UNION SELECT concat('geo/nations.py::', n_name), 'inherits', concat('geo/regions.ts::', r_name) FROM nation JOIN region ON n_regionkey = r_regionkey "
    "UNION SELECT concat('geo/regions.ts::', r_name), 'calls', concat('geo/nations.py::', min(n_name)) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"
)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("file_path"), F.col("text").alias("content"), F.octet_length("text").alias("size_bytes"), "lang", "source")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders")}
    text = lambda c: F.col(c).cast("string")
    customer = lambda c: F.concat(F.lit("sales/customers.py::Customer"), text(c))
    nation = F.concat(F.lit("geo/nations.py::"), "n_name")
    region = F.concat(F.lit("geo/regions.ts::"), "r_name")
    row = lambda s, r, e: (s.alias("source_entity"), F.lit(r).alias("relationship"), e.alias("target_entity"))
    sold = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
    made = t["supplier"].join(F.broadcast(t["nation"]), F.col("s_nationkey") == F.col("n_nationkey"))
    lands = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t["orders"].select(*row(F.concat(F.lit("orders/y"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".py::Order"), text("o_orderkey")), "has_fk", customer("o_custkey")))
    parts = [
        orders,
        sold.select(*row(customer("c_custkey"), "imports", nation)),
        made.select(*row(F.concat(F.lit("supply/generated/suppliers.py::Supplier"), text("s_suppkey")), "calls", F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(nation))),
        lands.select(*row(nation, "inherits", region)),
        lands.groupBy("r_name").agg(F.min("n_name").alias("n_name")).select(*row(region, "calls", nation)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
