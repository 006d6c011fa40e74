"""Registered wide/long forms, type inference, features, splits and the batch load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import SITE_SIDES
from labspark.operators import features, reshape
from labspark.operators.split import quota_split, split_by_label
from labspark.plans import load, roles, train
from labspark.plans.registered import ANSWERS, CASES, LINES, REPORTS, SYMBOLS, query
from labspark.session import bounded
from labspark.sources.tables import table

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")  # p_type values, for the SQL only


def _columns(template: str) -> str:
    return ", ".join(template.format(t=t) for t in TYPES)


_RESULTS = "max(symbol) FILTER (WHERE label = '{t}')"
_FLAGS = "coalesce(bool_or(label = '{t}'), false)"


def _coded(spark, folder):
    """Results with A as +, R as R; N is no symbol."""
    coded = F.when(F.col("symbol") == "A", "+").when(F.col("symbol") == "R", "R").otherwise("n/a")
    return roles.symbols(spark, folder).withColumn("symbol", coded)


_CODED = "coded AS (SELECT report_id, label, CASE symbol WHEN 'A' THEN '+' WHEN 'R' THEN 'R' ELSE 'n/a' END AS symbol FROM symbols)"


@query(
    "wide_symbols",
    f"""WITH {LINES}, {SYMBOLS}, {_CODED}
    SELECT report_id, {_columns(_RESULTS + ' AS "S/I/R_{t}"')} FROM coded GROUP BY report_id""",
)
def wide_symbols(spark, folder):
    return reshape.pivot_symbols(_coded(spark, folder), "report_id", "label", "symbol", roles.labels(spark, folder))


def _wide(spark, folder):
    facts = roles.wide_facts(spark, folder, {"A": "+", "N": "n/a"})
    return reshape.wide_report(roles.reports(spark, folder), facts)


_WIDE = f"""{REPORTS}, {LINES}, {SYMBOLS}, {ANSWERS}, {_CODED},
  results AS (SELECT report_id, {_columns(_RESULTS + ' AS "S/I/R_{t}"')} FROM coded GROUP BY report_id),
  flags AS (SELECT report_id, {_columns(_FLAGS + ' AS "ans_{t}"')} FROM answers GROUP BY report_id),
  wide AS (SELECT reports.*, {_columns('coalesce("ans_{t}", false) AS "ans_{t}"')},
    {_columns("coalesce(" + '"S/I/R_{t}"' + ", '') AS " + '"S/I/R_{t}"')}
    FROM reports LEFT JOIN flags USING (report_id) LEFT JOIN results USING (report_id))"""


@query("wide_report", f"WITH {_WIDE} SELECT * FROM wide")
def wide_report(spark, folder):
    return _wide(spark, folder)


@query("prefix_project", f"""WITH {_WIDE} SELECT report_id, {_columns('"S/I/R_{t}"')} FROM wide""")
def prefix_project(spark, folder):
    return reshape.prefix_project(_wide(spark, folder), ["report_id"], reshape.RESULT_PREFIX)


@query(
    "melt_symbols",
    f"""WITH {LINES}, {SYMBOLS}, {_CODED} SELECT report_id, label AS name, symbol FROM coded
    JOIN orders ON o_orderkey = report_id WHERE symbol IN ('+', '-', 'S', 'I', 'R')""",
)
def melt_symbols(spark, folder):
    return reshape.melt_symbols(_wide(spark, folder), ["report_id"])


@query(
    "melt_flags",
    f"""WITH {LINES}, {ANSWERS} SELECT report_id, label AS name FROM answers JOIN orders ON o_orderkey = report_id""",
)
def melt_flags(spark, folder):
    return reshape.melt_flags(_wide(spark, folder), ["report_id"])


@query(
    "infer_symbol_type",
    """WITH counts AS (
      SELECT p_name, p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS n_sir,
             count(*) FILTER (WHERE l_returnflag = 'A') AS n_sign
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT *, CAST(CASE WHEN n_sir > n_sign THEN 2 ELSE 1 END AS INTEGER) AS sir_type_id
    FROM counts WHERE n_sir <> n_sign""",
)
def infer_symbol_type(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    rows = (
        table(spark, folder, "lineitem")
        .select("l_partkey", "l_returnflag")
        .join(parts, "l_partkey")
        .withColumn("symbol", F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "R"))
    )
    return reshape.infer_symbol_type(rows, ["p_name", "p_brand"])


@query(
    "symbol_subtype",
    f"""WITH {LINES}, {SYMBOLS}, typed AS (
      SELECT report_id, label, CASE symbol WHEN 'A' THEN '+' WHEN 'N' THEN 'S' ELSE symbol END AS symbol,
             CAST(CASE WHEN label IN ('PROMO', 'SMALL') THEN 1 ELSE 2 END AS INTEGER) AS sir_type_id FROM symbols)
    SELECT *, CAST(CASE WHEN sir_type_id = 1 AND symbol = '+' THEN 1 WHEN sir_type_id = 2 AND symbol = 'S' THEN 3
                        WHEN sir_type_id = 2 AND symbol = 'R' THEN 5 END AS INTEGER) AS sir_sub_id FROM typed""",
)
def symbol_subtype(spark, folder):
    s = F.col("symbol")
    typed = (
        roles.symbols(spark, folder)
        .withColumn("symbol", F.when(s == "A", "+").when(s == "N", "S").otherwise(s))
        .withColumn("sir_type_id", F.when(F.col("label").isin("PROMO", "SMALL"), 1).otherwise(2))
    )
    return reshape.with_sub_type(typed, reshape.sub_types(spark))


# ---- features ----


@query(
    "one_hot",
    """SELECT p_partkey, 'p_type_' || p_type AS feature FROM part
    UNION ALL SELECT p_partkey, 'p_brand_' || nullif(p_brand, 'Brand#3') FROM part WHERE p_brand <> 'Brand#3'""",
)
def one_hot(spark, folder):
    return features.tokens(_part_cells(spark, folder), "p_partkey", ["p_type", "p_brand"])


def _part_cells(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", "p_type", F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("p_brand")
    )


@query(
    "align_features",
    """SELECT p_partkey, CAST(p_type = 'PROMO' AND p_brand <> 'Brand#3' AS INTEGER) AS "p_type_PROMO",
      CAST(p_type = 'LARGE' AND p_brand <> 'Brand#3' AS INTEGER) AS "p_type_LARGE",
      CAST(p_brand = 'Brand#1' AS INTEGER) AS "p_brand_Brand#1", CAST(0 AS INTEGER) AS "p_type_UNSEEN" FROM part""",
)
def align_features(spark, folder):
    """Parts of brand 3 have no value at all and stay as rows of zeros."""
    cells = _part_cells(spark, folder)
    cells = cells.withColumn("p_type", F.when(F.col("p_brand").isNotNull(), F.col("p_type")))
    long = features.tokens(cells, "p_partkey", ["p_type", "p_brand"])
    wanted = ["p_type_PROMO", "p_type_LARGE", "p_brand_Brand#1", "p_type_UNSEEN"]
    return features.align(long, "p_partkey", wanted, cells)


# ---- splits ----


def quota_sql(rows: str, group: str, stratum: str, key: str, test_size: float, min_stratum: int, name: str) -> str:
    """CTE `name` with the columns of `rows` and a type column."""
    part = f"PARTITION BY {group}" if group else ""
    also = f"{group}, " if group else ""
    return f"""{name}_sizes AS (SELECT {also}{stratum}, count(*) AS n FROM {rows} GROUP BY ALL),
  {name}_total AS (SELECT *, CAST(sum(n) OVER ({part}) AS BIGINT) AS total FROM {name}_sizes WHERE n >= {min_stratum}),
  {name}_train AS (SELECT *, total - CAST(ceil({test_size}::double * total) AS BIGINT) AS train FROM {name}_total),
  {name}_floor AS (SELECT *, (train * n) // total AS base, (train * n) % total AS rest FROM {name}_train),
  {name}_quota AS (SELECT *, base + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, {stratum})
      <= train - sum(base) OVER ({part}) THEN 1 ELSE 0 END AS quota FROM {name}_floor),
  {name} AS (SELECT r.*, CASE WHEN q.quota IS NULL OR row_number() OVER (PARTITION BY {also}{stratum}
      ORDER BY md5('0|' || {key}), {key}) <= q.quota THEN 'train' ELSE 'test' END AS type
    FROM {rows} r LEFT JOIN {name}_quota q USING ({also}{stratum}))"""


@query(
    "stratified_split",
    f"""WITH {CASES}, {quota_sql("cases", "", "sample", "report_id", 0.1, 2, "split")}
    SELECT report_id, sample, type FROM split""",
)
def stratified_split(spark, folder):
    rows = roles.cases(spark, folder).select("report_id", "sample")
    return quota_split(rows, "report_id", "sample", 0.1, min_stratum=2)


_LABEL_ROWS = f"""{LINES}, {ANSWERS}, {CASES},
  pairs AS (SELECT report_id, label, a.report_id IS NOT NULL AS has_answer
    FROM (SELECT report_id, label FROM cases, (SELECT DISTINCT p_type AS label FROM part)) c
    LEFT JOIN answers a USING (report_id, label))"""


@query(
    "split_by_label",
    f"""WITH {_LABEL_ROWS}, {quota_sql("pairs", "label", "has_answer", "report_id", 0.2, 1, "split")}
    SELECT report_id, label, has_answer, type AS sub_type FROM split""",
)
def split_per_label(spark, folder):
    return split_by_label(
        roles.cases(spark, folder), roles.answers(spark, folder), roles.labels(spark, folder)
    )


@query(
    "train_test_frames",
    f"""WITH {_LABEL_ROWS}, {SYMBOLS}, {_CODED}, {quota_sql("pairs", "label", "has_answer", "report_id", 0.2, 1, "split")},
    results AS (SELECT report_id, {_columns(_RESULTS + ' AS "S/I/R_{t}"')} FROM coded GROUP BY report_id)
    SELECT report_id, type AS sub_type, batch_id AS file_id, {_columns('"S/I/R_{t}"')}
    FROM results JOIN split USING (report_id) JOIN cases USING (report_id)
    WHERE label = 'PROMO' AND batch_id <> 1997""",
)
def train_test_frames(spark, folder):
    """Train and test rows of one drug in the active batches."""
    names = roles.labels(spark, folder)
    batch_of = roles.cases(spark, folder).select("report_id", F.col("batch_id").alias("file_id"))
    wide = reshape.pivot_symbols(_coded(spark, folder), "report_id", "label", "symbol", names).join(batch_of, "report_id")
    # The quota of a drug does not depend on the other drugs.
    assigned = split_by_label(roles.cases(spark, folder), roles.answers(spark, folder), ["PROMO"])
    active = roles.batches(spark, folder).select(F.col("batch_id").alias("file_id")).filter("file_id <> 1997")
    parts = zip(("train", "test"), train.train_test_frames(wide, assigned, "PROMO", active))
    return reduce(DataFrame.unionByName, [rows.withColumn("sub_type", F.lit(p)) for p, rows in parts])


# ---- batch load ----

_SPECIES = ("automobile", "building", "furniture", "household", "other")


def _cleaned(col: str) -> str:
    out = f"trim(split_part(lower({col}), '(', 1))"
    for side in SITE_SIDES:
        out = f"trim(replace({out}, '{side}', ''))"
    return out


_LOADED = f"""WITH {REPORTS}, {LINES}, {SYMBOLS}, {ANSWERS},
  species_dim AS (SELECT unnest({list(_SPECIES)}) AS name, unnest(range(1, 6)) AS id),
  genus_dim AS (SELECT 'nation_0' AS name, 7 AS id UNION ALL
    SELECT name, 7 + row_number() OVER (ORDER BY name) FROM (
      SELECT DISTINCT lower(genus) AS name FROM reports WHERE lower(genus) <> 'nation_0')),
  sample_dim AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (
      SELECT DISTINCT {_cleaned("'Rt. ' || sample || ' (swab)'")} AS name FROM reports)),
  drug_dim AS (SELECT 'PROMO' AS name, 1 AS id, 1 AS kind UNION ALL
    SELECT label, 1 + row_number() OVER (ORDER BY label), kind FROM (
      SELECT label, CASE WHEN count(*) FILTER (WHERE symbol IN ('N', 'R')) > count(*) FILTER (WHERE symbol = 'A') THEN 2 ELSE 1 END AS kind
      FROM symbols JOIN reports USING (report_id) WHERE label <> 'PROMO' GROUP BY label)),
  answer_dim AS (SELECT label AS name, row_number() OVER (ORDER BY label) AS id FROM (
      SELECT DISTINCT label FROM answers JOIN reports USING (report_id))),
  report AS (SELECT r.report_id AS line, 100 + row_number() OVER (ORDER BY r.report_id) AS rid, r.hn::varchar AS hn,
      strftime(issued, '%Y-%m-%d') AS date_of_submission, strftime(issued + INTERVAL 2 DAY, '%Y-%m-%d') AS report_issued_date,
      coalesce(s.id, 5) AS species_id, g.id AS genus_id, m.id AS sample_id
    FROM reports r LEFT JOIN species_dim s ON s.name = lower(r.species) JOIN genus_dim g ON g.name = lower(r.genus)
    JOIN sample_dim m ON m.name = {_cleaned("'Rt. ' || r.sample || ' (swab)'")}),
  {quota_sql("report", "", "species_id", "rid", 0.1, 2, "bycase")},
  sir AS (SELECT rid, d.id AS drug, CASE WHEN kind = 1 AND symbol = 'A' THEN 1 WHEN kind = 2 AND symbol = 'N' THEN 3
      WHEN kind = 2 AND symbol = 'R' THEN 5 END AS sub FROM symbols JOIN report ON line = report_id JOIN drug_dim d ON d.name = label),
  ans AS (SELECT rid, d.id AS drug FROM answers JOIN report ON line = report_id JOIN answer_dim d ON d.name = label),
  pairs AS (SELECT c.rid, c.drug, a.rid IS NOT NULL AS has_answer
    FROM (SELECT rid, id AS drug FROM bycase, answer_dim WHERE type = 'train') c LEFT JOIN ans a USING (rid, drug)),
  {quota_sql("pairs", "drug", "has_answer", "rid", 0.2, 1, "bydrug")}"""

_INGEST = f"""{_LOADED}
  SELECT 'report' AS fact, type AS part, count(*) AS n, sum(rid)::bigint AS report_sum,
    sum(species_id + 10 * genus_id + 1000 * sample_id)::bigint AS key_sum FROM bycase GROUP BY ALL
  UNION ALL SELECT 'report_sir', coalesce(sub::varchar, 'none'), count(*), sum(rid)::bigint, sum(drug)::bigint FROM sir GROUP BY ALL
  UNION ALL SELECT 'report_answer', 'true', count(*), sum(rid)::bigint, sum(drug)::bigint FROM ans
  UNION ALL SELECT 'report_train', type, count(*), sum(rid)::bigint, sum(drug)::bigint FROM bydrug GROUP BY ALL"""


def ingest_batch(spark, folder) -> load.Batch:
    names = "id long, name string"
    dims = load.Dimensions(
        species=spark.createDataFrame(list(enumerate(_SPECIES, 1)), names),
        bacteria_genus=spark.createDataFrame([(7, "nation_0")], names),
        submitted_sample=spark.createDataFrame([], names),
        antimicrobial_sir=spark.createDataFrame([(1, "PROMO", 1)], "id long, name string, sir_type_id int"),
        antimicrobial_answer=spark.createDataFrame([], names),
        sir_sub_type=reshape.sub_types(spark),
    )
    return load.ingest(roles.upload(spark, folder), dims, panel=1, file_id=1, last_report_id=100)


@query("ingest", _INGEST)
def ingest(spark, folder):
    """Row counts and key sums of the four facts of a loaded batch."""
    batch = ingest_batch(spark, folder)
    key = F.col("species_id") + 10 * F.col("bacteria_genus_id") + 1000 * F.col("submitted_sample_id")

    def summary(df, fact, part, total):
        return df.groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.sum("report_id").alias("report_sum"), F.sum(total).alias("key_sum")
        ).select(F.lit(fact).alias("fact"), "part", "n", "report_sum", "key_sum")

    drug = F.col("antimicrobial_id")
    parts = [
        summary(batch.report, "report", F.col("type"), key),
        summary(batch.report_sir, "report_sir", F.coalesce(F.col("sir_sub_id").cast("string"), F.lit("none")), drug),
        summary(batch.report_answer, "report_answer", F.lit("true"), drug),
        summary(batch.report_train, "report_train", F.col("sub_type"), drug),
    ]
    return bounded(reduce(DataFrame.unionByName, parts))


@query(
    "ingest_report",
    f"""{_LOADED} SELECT rid AS report_id, hn, date_of_submission, report_issued_date, CAST(species_id AS BIGINT) AS species_id,
    CAST(genus_id AS BIGINT) AS bacteria_genus_id, CAST(sample_id AS BIGINT) AS submitted_sample_id, type FROM bycase""",
)
def ingest_report(spark, folder):
    dates = {c: F.col(c).cast("string") for c in ("date_of_submission", "report_issued_date")}
    return ingest_batch(spark, folder).report.withColumns(dates).select(
        "report_id", "hn", *dates, "species_id", "bacteria_genus_id", "submitted_sample_id", "type"
    )


@query(
    "ingest_sir",
    f"{_LOADED} SELECT rid AS report_id, CAST(drug AS BIGINT) AS antimicrobial_id, CAST(sub AS INTEGER) AS sir_sub_id FROM sir",
)
def ingest_sir(spark, folder):
    return ingest_batch(spark, folder).report_sir


@query("ingest_answer", f"{_LOADED} SELECT rid AS report_id, CAST(drug AS BIGINT) AS antimicrobial_id FROM ans")
def ingest_answer(spark, folder):
    return ingest_batch(spark, folder).report_answer


@query(
    "ingest_train",
    f"{_LOADED} SELECT rid AS report_id, CAST(drug AS BIGINT) AS antimicrobial_id, type AS sub_type FROM bydrug",
)
def ingest_train(spark, folder):
    return ingest_batch(spark, folder).report_train
