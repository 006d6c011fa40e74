"""Registered scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions import text, values
from labspark.plans.registered import query
from labspark.sources.tables import table


def _site_sql(col: str) -> str:
    """The specimen rules as nested SQL calls."""
    site = f"trim(lower({col}))"
    for cut in text.SITE_CUTS:
        site = f"trim(split_part({site}, '{cut}', 1))"
    for side in text.SITE_SIDES:
        site = f"trim(replace({site}, '{side}', ''))"
    named = f"CASE WHEN trim(lower({col})) IN ('', 'unk') THEN 'unknown'"
    for phrase, name in text.SITE_PHRASES.items():
        named += f" WHEN contains(lower({col}), '{phrase}') THEN '{name}'"
    return f"{named} ELSE {site} END"


_SITES = """sites AS (
  SELECT p_partkey, CASE
    WHEN p_type = 'ECONOMY' THEN ' Rt. ' || p_name || ' (deep)'
    WHEN p_type = 'LARGE' THEN 'Left ' || p_name || ' or ' || p_brand
    WHEN p_type = 'MEDIUM' THEN p_name || ' at ' || p_brand || '/' || p_type
    WHEN p_type = 'PROMO' THEN 'Open Wound ' || p_name
    WHEN p_type = 'SMALL' THEN 'l. ' || p_name || '@' || p_brand
    WHEN p_size = 7 THEN ' UNK ' ELSE p_name END AS site FROM part)"""


@query("clean_specimen", f"WITH {_SITES} SELECT p_partkey, site, {_site_sql('site')} AS cleaned FROM sites")
def clean_specimen(spark, folder):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    site = (
        F.when(kind == "ECONOMY", F.concat(F.lit(" Rt. "), name, F.lit(" (deep)")))
        .when(kind == "LARGE", F.concat(F.lit("Left "), name, F.lit(" or "), brand))
        .when(kind == "MEDIUM", F.concat(name, F.lit(" at "), brand, F.lit("/"), kind))
        .when(kind == "PROMO", F.concat(F.lit("Open Wound "), name))
        .when(kind == "SMALL", F.concat(F.lit("l. "), name, F.lit("@"), brand))
        .when(F.col("p_size") == 7, " UNK ")
        .otherwise(name)
    )
    return table(spark, folder, "part").select(
        "p_partkey", site.alias("site"), text.clean_specimen(site).alias("cleaned")
    )


@query(
    "text_basics",
    """SELECT page_id, lower(url) AS low, upper(url) AS up, starts_with(url, 'https') AS secure,
      contains(url, 'utm_') AS tracked, split_part(url, '?', 1) AS path, replace(url, '/', '_') AS flat,
      regexp_extract(html, '[^\\s\\p{Z}]+') AS first_token FROM pages""",
)
def text_basics(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        text.lower_strip(url).alias("low"),
        F.upper(text.strip(url)).alias("up"),
        F.startswith(url, F.lit("https")).alias("secure"),
        url.contains("utm_").alias("tracked"),
        F.substring_index(url, "?", 1).alias("path"),
        text.file_safe(url).alias("flat"),
        text.first_token(F.col("html")).alias("first_token"),
    )


@query(
    "recode_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
      CASE l_returnflag WHEN 'A' THEN 'POS' WHEN 'N' THEN 'NEG' ELSE l_returnflag END AS named,
      replace(p_type || '/' || p_name, '/', '_') AS file_name FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def recode_values(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    return table(spark, folder, "lineitem").join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        values.recode(F.col("l_returnflag"), {"A": "POS", "N": "NEG"}).alias("named"),
        text.file_safe(F.concat_ws("/", "p_type", "p_name")).alias("file_name"),
    )


@query(
    "normalise_map",
    """SELECT event_id, 'S/I/R_' || trim(lower(' ' || event_type || ' ')) AS key,
      CASE WHEN (props->>'k')::int > 66 THEN '+' WHEN (props->>'k')::int > 33 THEN '-' ELSE 'S' END AS value FROM events""",
)
def normalise_map(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.create_map(
        F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" ")),
        F.when(k > 66, "pos").when(k > 33, "Neg").otherwise("s"),
    )
    return (
        table(spark, folder, "events")
        .select("event_id", F.explode(values.normalise_results(raw)).alias("key", "value"))
    )


@query(
    "parse_list",
    """SELECT event_id, event_type || ',' || (props->>'k') AS items, 2 AS n_items,
      (props->>'k')::int AS k FROM events""",
)
def parse_list(spark, folder):
    k = F.from_json("props", "k int")["k"]
    stored = F.concat(F.lit("['"), F.col("event_type"), F.lit("', '"), k.cast("string"), F.lit("']"))
    items = text.parse_list(stored)
    return table(spark, folder, "events").select(
        "event_id", F.array_join(items, ",").alias("items"), F.size(items).alias("n_items"), k.alias("k")
    )


@query(
    "date_parts",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
      year(o_orderdate) > 1997 AS recent, strftime(o_orderdate, '%d-%b-%Y %H:%M:%S') AS shown FROM orders""",
)
def date_parts(spark, folder):
    d = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        values.month_key(d).alias("month"),
        F.to_date(d).cast("string").alias("day"),
        (F.year(d) > 1997).alias("recent"),
        values.display_time(d).alias("shown"),
    )


@query(
    "elapsed_seconds",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
      CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT) AS seconds
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def elapsed(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, folder, "lineitem").join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        values.elapsed_seconds(
            F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
        ).alias("seconds"),
    )


@query(
    "rounding",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax,
      round(l_discount * 100, 2) AS pct, round_even(l_quantity / 2, 0)::int AS half_even,
      trunc(l_extendedprice)::bigint AS whole, least(100.0::double, l_quantity * 3) AS capped,
      round(1 / l_quantity, 6) AS reciprocal FROM lineitem""",
)
def rounding(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax",
        values.percent(F.col("l_discount")).alias("pct"),
        F.bround(q / 2).cast("int").alias("half_even"),
        F.col("l_extendedprice").cast("long").alias("whole"),
        F.least(F.lit(100.0), q * 3).alias("capped"),
        F.round(1 / q, 6).alias("reciprocal"),
    )


@query(
    "render_params",
    """SELECT p_partkey, 'p_brand = ' || p_brand || ', p_type = ' || p_type || ', p_size = ' || p_size AS params FROM part""",
)
def render_params(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", text.assignments(["p_brand", "p_type", "p_size"]).alias("params")
    )
