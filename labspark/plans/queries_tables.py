"""Registered scans, filters, keys, dimensions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions.text import blank_to_null, first_token, lower_strip
from labspark.operators import dims, quality
from labspark.operators.features import bin_rare
from labspark.operators.numbering import number_rows
from labspark.operators.reshape import drop_empty_columns
from labspark.operators.registry import latest_versions, vocabulary_union
from labspark.plans import roles
from labspark.plans.registered import CASES, LINKS, query
from labspark.session import bounded, scratch_path
from labspark.sources.tables import append_rows, param_filter, read_csv, table


@query("dim_lookup_list", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def dim_lookup_list(spark, folder):
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("param_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'")
def orders_of_priority(spark, folder):
    return param_filter(table(spark, folder, "orders"), o_orderpriority="2-HIGH").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "in_list",
    """SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (
      SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)""",
)
def in_list(spark, folder):
    rich = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
    keys = rich.select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return table(spark, folder, "nation").join(keys, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query(
    "nested_semi",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN (
      SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_orderkey IN (
        SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'))""",
)
def nested_semi(spark, folder):
    urgent = table(spark, folder, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    full = table(spark, folder, "lineitem").filter("l_quantity = 50").select("l_partkey", "l_orderkey")
    used = full.join(urgent, full.l_orderkey == urgent.o_orderkey, "left_semi").select("l_partkey").distinct()
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return part.join(used, part.p_partkey == used.l_partkey, "left_semi")


@query(
    "latest_version_rows",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_custkey, o_orderdate) IN (
      SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey)""",
)
def latest_version_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(newest, ["o_custkey", "o_orderdate"], "left_semi")


@query(
    "scalar_subquery",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
)
def scalar_subquery(spark, folder):
    orders = table(spark, folder, "orders")
    return spark.sql(
        "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate = (SELECT max(o_orderdate) FROM {orders})",
        orders=orders,
    )


@query(
    "latest_version",
    f"WITH {CASES} SELECT panel, CAST(max(batch_id) - (SELECT min(batch_id) FROM cases) + 1 AS INTEGER) AS version FROM cases GROUP BY panel",
)
def latest_version(spark, folder):
    first, _ = roles.span(spark, folder)
    versions = roles.cases(spark, folder).select("panel", (F.col("batch_id") - (first - 1)).alias("version"))
    return latest_versions(versions, "panel")


@query(
    "line_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1 AS line_no FROM orders",
)
def line_numbers(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return number_rows(orders, [F.col("o_orderdate"), F.col("o_orderkey")], "line_no", 2).select("o_orderkey", "line_no")


def _as_csv(spark, rows, name):
    """Rows written as CSV with a header, for the queries that read it back."""
    path = scratch_path(spark, name)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


# Types that the files must get back, by column; text is what the cells of all others are.
_ITEM_TYPES = {"l_orderkey": "bigint", "l_linenumber": "bigint", "l_extendedprice": "double", "l_discount": "double", "l_shipdate": "date",
               "l_returnflag": "string", "code": "string", "open": "boolean", "empty": "string", "exact": "decimal(22,2)", "at": "timestamp"}


@query(
    "typed_csv_lineitem",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_returnflag,
      lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS code, l_linestatus = 'O' AS open, CAST(NULL AS VARCHAR) AS empty,
      '1234567890123456' || lpad(CAST(l_linenumber AS VARCHAR), 4, '5') || '.25' AS exact, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS at,
      '""" + ", ".join(f"{c} {t}" for c, t in sorted(_ITEM_TYPES.items())) + """' AS types FROM lineitem""",
)
def typed_csv_lineitem(spark, folder):
    """Line items through CSV: numbers, days and flags get their types back; codes keep their zeros, long numbers their digits."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"), "l_returnflag",
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("code"), (F.col("l_linestatus") == "O").alias("open"), F.lit("").alias("empty"),
        F.concat(F.lit("1234567890123456"), F.lpad(F.col("l_linenumber").cast("string"), 4, "5"), F.lit(".25")).alias("exact"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )
    read = read_csv(spark, _as_csv(spark, items, "items"), typed=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(read.dtypes))
    shown = {"l_shipdate": F.col("l_shipdate").cast("string"), "exact": F.col("exact").cast("string"), "at": F.col("at").cast("string"), "types": F.lit(types)}
    return read.withColumns(shown)


@query(
    "typed_csv_orders",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, year(o_orderdate) AS o_year, o_orderpriority,
      CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS mixed FROM orders""",
)
def typed_csv_orders(spark, folder):
    """Orders through CSV; customers are asked for as texts, and a column of numbers and words is text."""
    customer = F.col("o_custkey").cast("string")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.when(F.col("o_custkey") % 2 == 0, customer).otherwise(F.col("o_orderpriority")).alias("mixed"),
    )
    read = read_csv(spark, _as_csv(spark, rows, "orders"), typed=True, keep_text=["o_custkey"])
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").cast("long").alias("o_year"), "o_orderpriority", "mixed")


@query(
    "assign_surrogate_keys",
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT n_name FROM nation))
    SELECT name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name) AS id FROM names""",
)
def assign_surrogate_keys(spark, folder):
    known = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    fresh = dims.new_members(table(spark, folder, "part"), "p_name", known)
    return dims.assign_keys(fresh, known).select("name", "id")


@query(
    "get_or_create_dim",
    """WITH known AS (SELECT n_nationkey::bigint AS id, lower(n_name) AS name FROM nation),
    fresh AS (SELECT DISTINCT split_part(trim(lower(p_name)), ' ', 1) AS name FROM part
              UNION SELECT DISTINCT lower(p_type) FROM part)
    SELECT id, name FROM known UNION ALL
    SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name), name
    FROM fresh WHERE name NOT IN (SELECT name FROM known)""",
)
def get_or_create_dim(spark, folder):
    known = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")
    )
    part = table(spark, folder, "part")
    values = part.select(first_token(lower_strip(F.col("p_name"))).alias("v")).unionByName(
        part.select(F.lower("p_type").alias("v"))
    )
    return dims.get_or_create(values, "v", known)


@query(
    "lookup_or_other",
    """WITH brands AS (
      SELECT name, row_number() OVER (ORDER BY name) AS id FROM (
        SELECT DISTINCT p_brand AS name FROM part WHERE p_brand < 'Brand#2' UNION SELECT 'other'))
    SELECT p_partkey, coalesce(b.id, (SELECT id FROM brands WHERE name = 'other')) AS brand_id
    FROM part LEFT JOIN brands b ON b.name = p_brand""",
)
def lookup_or_other(spark, folder):
    part = table(spark, folder, "part")
    names = part.filter("p_brand < 'Brand#2'").select(F.col("p_brand").alias("name")).distinct()
    names = names.unionByName(spark.createDataFrame([("other",)], "name string"))
    known = number_rows(names, [F.col("name")], "id")
    return dims.lookup_or_other(part, "p_brand", known, "brand_id").select("p_partkey", "brand_id")


@query("link_rows", f"WITH {CASES}, {LINKS} SELECT version, batch_id FROM links")
def link_rows(spark, folder):
    return roles.links(spark, folder)


@query(
    "binning_vocab",
    f"""WITH {CASES}, {LINKS}, parts AS (
      SELECT version, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN cases ON report_id = l_orderkey
      JOIN links USING (batch_id)),
    counts AS (SELECT version, p_name, count(*) AS n FROM parts GROUP BY ALL),
    binned AS (SELECT DISTINCT version, CASE WHEN n < 135 THEN 'other' ELSE p_name END AS name FROM counts)
    SELECT version, string_agg(name, '|' ORDER BY name) AS vocabulary FROM binned GROUP BY version""",
)
def binning_vocab(spark, folder):
    """Vocabulary of every snapshot after rare values are binned; stored as one list per snapshot."""
    return snapshot_vocabularies(spark, folder, 135).withColumn("vocabulary", F.array_join("vocabulary", "|"))


def snapshot_vocabularies(spark, folder, k):
    # Counted per batch first: only these counts, not the lines, meet the snapshots.
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_partkey")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    batch_of = roles.cases(spark, folder).select("report_id", "batch_id")
    per_batch = (
        items.join(parts, "l_partkey").join(batch_of, "report_id").groupBy("batch_id", "p_name").agg(F.count("*").alias("n"))
    )
    counts = (
        per_batch.join(bounded(roles.links(spark, folder)), "batch_id")
        .groupBy("version", "p_name")
        .agg(F.sum("n").alias("n"))
    )
    name = F.when(F.col("n") < k, "other").otherwise(F.col("p_name"))
    return counts.groupBy("version").agg(F.sort_array(F.collect_set(name)).alias("vocabulary"))


@query(
    "vocab_union",
    f"""WITH {CASES}, {LINKS}, parts AS (
      SELECT version, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN cases ON report_id = l_orderkey
      JOIN links USING (batch_id) WHERE version >= (SELECT max(version) - 1 FROM links)),
    counts AS (SELECT version, p_name, count(*) AS n FROM parts GROUP BY ALL)
    SELECT DISTINCT CASE WHEN n < 900 THEN 'other' ELSE p_name END AS name FROM counts""",
)
def vocab_union(spark, folder):
    """Values allowed by any of the latest two snapshots (one per panel)."""
    _, last = roles.span(spark, folder)
    binning = snapshot_vocabularies(spark, folder, 900).select(F.col("version").alias("model_group_id"), F.col("vocabulary").alias("schema"))
    panels = ((last - 1, 1, last - 1), (last, 2, last))
    groups = spark.createDataFrame(panels, "model_group_id int, vitek_id int, version int")
    return vocabulary_union(binning, groups)


@query(
    "bin_rare",
    """WITH counts AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
    SELECT p_partkey, CASE WHEN n < 30 THEN 'other' ELSE p_name END AS p_name FROM part JOIN counts USING (p_name)""",
)
def bin_rare_names(spark, folder):
    return bin_rare(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", 30)


@query(
    "distinct_labels",
    "SELECT DISTINCT p_type AS label FROM lineitem JOIN part ON p_partkey = l_partkey",
)
def distinct_labels(spark, folder):
    return roles.lines(spark, folder).select("label").distinct()


@query("label_universe", "SELECT DISTINCT p_type AS label FROM part")
def label_universe(spark, folder):
    return table(spark, folder, "part").select(F.col("p_type").alias("label")).distinct()


@query(
    "new_values",
    "SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)",
)
def new_texts(spark, folder):
    known = table(spark, folder, "benchmark").select("text")
    return quality.new_values(table(spark, folder, "documents").select("text"), known, "text")


@query(
    "blank_to_null",
    """SELECT doc_id, CASE WHEN regexp_matches(coalesce(lang, ''), '^\\s*$') THEN NULL ELSE lang END AS lang,
      CASE WHEN regexp_matches(part, '^\\s*$') THEN NULL ELSE part END AS part
    FROM (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN '  ' WHEN lang = 'de' THEN '' ELSE source END AS part FROM documents)""",
)
def blank_cells_to_null(spark, folder):
    docs = table(spark, folder, "documents")
    part = F.when(F.col("lang") == "en", "  ").when(F.col("lang") == "de", "").otherwise(F.col("source"))
    return docs.select(
        "doc_id", blank_to_null(F.col("lang")).alias("lang"), blank_to_null(part).alias("part")
    )


@query("drop_all_null_columns", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS sample FROM orders")
def drop_all_null_columns(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("sample"),
        F.when(F.col("o_orderkey") < 0, F.col("o_orderstatus")).alias("never_set"),
    )
    return drop_empty_columns(orders)


# ---- files ----


@query(
    "read_csv",
    """SELECT o_orderkey::varchar AS o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'a "P", quoted' ELSE o_orderstatus END AS o_orderstatus,
      nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders""",
)
def csv_round_trip(spark, folder):
    """Orders written as CSV and read back as texts; the token NA is read as missing."""
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", 'a "P", quoted').otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    orders.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path)


@query(
    "append_rows",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS batch_id, o_orderstatus, count(*) AS n, sum(o_orderkey)::bigint AS keys
    FROM orders GROUP BY ALL""",
)
def append_round_trip(spark, folder):
    """Orders appended batch by status, then read back."""
    path = scratch_path(spark, "orders-append")
    orders = table(spark, folder, "orders").withColumn("batch_id", F.year("o_orderdate"))
    append_rows(orders.filter("o_orderstatus = 'F'"), path, ["batch_id"])
    append_rows(orders.filter("o_orderstatus <> 'F'"), path, ["batch_id"])
    stored = spark.read.parquet(path)
    return stored.groupBy("batch_id", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
