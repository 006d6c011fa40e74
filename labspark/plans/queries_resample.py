"""Registered neighbour joins, over-sampling and model training on the embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labspark.operators import resample as rs
from labspark.operators.metrics import binary_metrics
from labspark.operators.neighbors import nearest
from labspark.operators.sets import nearest_sets
from labspark.plans.registered import query
from labspark.session import checkpointed, distinct_values, scratch_path
from labspark.sources.tables import table


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    )


def rare_and_rest(spark, folder):
    """The same rows with two classes: label 0 and all others."""
    return vectors(spark, folder).withColumn("label", (F.col("label") == 0).cast("int"))


# Every pair of rows with its squared distance, and ranked neighbour lists.
_PAIRS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS vec FROM embeddings),
  sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
  top AS (SELECT label AS top_label, n AS n_top FROM sizes ORDER BY n DESC, label LIMIT 1),
  pairs AS (SELECT a.id, a.label, b.id AS nid, b.label AS nlabel,
      list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
    FROM v a JOIN v b ON a.id <> b.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS r FROM pairs),
  own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS r FROM pairs WHERE label = nlabel),
  minority AS (SELECT v.*, n, n_top, n_top - n AS missing FROM v JOIN sizes USING (label), top WHERE label <> top_label)"""
_TWO_CLASSES = _PAIRS.replace("AS id, label, list_transform", "AS id, (label = 0)::int AS label, list_transform")
# Number in [0, 1) from eight hex digits of a text.
_HEX = "CAST(concat('0x', substr({t}, {i}, 8)) AS BIGINT) / 4294967296.0::double"


@query(
    "knn_join",
    f"WITH {_PAIRS} SELECT id, nid AS neighbor_id, CAST(r AS INTEGER) AS rank, round(d2, 6) AS d2 FROM near WHERE r <= 5",
)
def knn_join(spark, folder):
    rows = vectors(spark, folder)
    return nearest(rows, rows, 5, "id", "vec").select("id", "neighbor_id", "rank", F.round("d2", 6).alias("d2"))


# Parts as sets of a type, a brand and words of the name: every pair with the number of tokens that only one of them has.
_SET_PAIRS = """s AS (SELECT p_partkey AS id, list_distinct(['t_' || p_type, 'b_' || p_brand] || list_transform(string_split(p_name, ' '), lambda w: 'n_' || w)) AS tokens FROM part),
  pairs AS (SELECT a.id, b.id AS nid, len(a.tokens) + len(b.tokens) - 2 * len(list_intersect(a.tokens, b.tokens)) AS d2 FROM s a JOIN s b ON a.id <> b.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS r FROM pairs)"""


def part_sets(spark, folder):
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("n_"), w))
    fixed = F.array(F.concat(F.lit("t_"), "p_type"), F.concat(F.lit("b_"), "p_brand"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat(fixed, words).alias("tokens"))


@query(
    "knn_sets",
    f"WITH {_SET_PAIRS} SELECT id, nid AS neighbor_id, CAST(r AS INTEGER) AS rank, CAST(d2 AS DOUBLE) AS d2 FROM near WHERE r <= 5",
)
def knn_sets(spark, folder):
    """Nearest parts by their one-hot tokens, through the inverted index."""
    rows = part_sets(spark, folder)
    return nearest_sets(rows, rows, 5, "id", "tokens").select("id", "neighbor_id", "rank", "d2")


def _synthetic_sql(plan: str, near: str) -> str:
    """CTEs from a plan (id, label, vec, turns) and ranked neighbours (id, nid, r) to synthetic rows."""
    return f"""turns AS (SELECT id, label, vec, turn, md5('0|' || id || '|' || turn) AS t
    FROM (SELECT *, unnest(range(1, turns + 1)) AS turn FROM {plan})),
  lists AS (SELECT id, list(nid ORDER BY r) AS near FROM {near} WHERE r <= 5 GROUP BY id),
  picked AS (SELECT t.*, near[1 + floor({_HEX.format(t="t", i=1)} * len(near))::int] AS neighbor_id, {_HEX.format(t="t", i=9)} AS gap
    FROM turns t JOIN lists USING (id)),
  synthetic AS (SELECT p.label, p.id, CAST(turn AS BIGINT) AS turn, neighbor_id, gap,
      list_transform(list_zip(p.vec, e.vec), lambda z: z[1] + gap * (z[2] - z[1])) AS vec
    FROM picked p JOIN v e ON e.id = neighbor_id)"""


def _in_turn_sql(rows: str) -> str:
    return f"""places AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS pos,
      count(*) OVER (PARTITION BY label) AS in_class FROM {rows}),
  plan AS (SELECT *, missing // in_class + CASE WHEN pos <= missing % in_class THEN 1 ELSE 0 END AS turns FROM places)"""


_SMOTE = f"{_PAIRS}, {_in_turn_sql('minority')}, {_synthetic_sql('plan', 'own')}"
_SHOW = """SELECT label, id, turn, neighbor_id, round(gap, 6) AS gap,
  array_to_string(list_transform(vec, lambda x: CAST(round(x * 100000) AS BIGINT)), ',') AS vec FROM synthetic"""


def _shown(synthetic):
    """Whole vectors, in units of 1/100,000."""
    units = F.transform("vec", lambda x: F.round(x * 100_000).cast("long").cast("string"))
    return synthetic.select(
        "label", "id", "turn", "neighbor_id", F.round("gap", 6).alias("gap"), F.array_join(units, ",").alias("vec")
    )


@query("smote", f"WITH {_SMOTE} {_SHOW}")
def smote(spark, folder):
    return _shown(rs.smote(vectors(spark, folder)))


@query(
    "smote_rounded",
    f"""WITH {_SMOTE} SELECT label, id, turn, list_sum(list_transform(vec, lambda x: round_even(x * 10, 0)::int))::bigint AS total
    FROM (SELECT label, id, turn, vec FROM synthetic)""",
)
def smote_rounded(spark, folder):
    """Synthetic rows as whole numbers, with vectors scaled by ten."""
    scaled = rs.smote(vectors(spark, folder)).withColumn("vec", F.transform("vec", lambda x: x * 10))
    total = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x)
    return rs.rounded(scaled).select("label", "id", "turn", total.alias("total"))


_FOREIGN = "count(*) FILTER (WHERE nlabel <> minority.label AND r <= {m}) AS n_other"


def _counted_sql(m: int) -> str:
    return f"""counted AS (SELECT minority.id, minority.label, missing, {_FOREIGN.format(m=m)}
      FROM minority JOIN near USING (id) GROUP BY minority.id, minority.label, missing)"""


@query(
    "borderline_danger",
    f"""WITH {_TWO_CLASSES}, {_counted_sql(10)}
    SELECT id, label, n_other, n_other >= 5 AND n_other < 10 AS danger FROM counted""",
)
def borderline_danger(spark, folder):
    return rs.borderline_danger(rare_and_rest(spark, folder)).select("id", "label", "n_other", "danger")


@query(
    "borderline_smote",
    f"""WITH {_TWO_CLASSES}, {_counted_sql(10)}, danger AS (SELECT minority.* FROM minority JOIN counted USING (id)
      WHERE n_other >= 5 AND n_other < 10), {_in_turn_sql("danger")}, {_synthetic_sql("plan", "own")} {_SHOW}""",
)
def borderline_smote(spark, folder):
    return _shown(rs.borderline_smote(rare_and_rest(spark, folder)))


_ADASYN = f"""{_TWO_CLASSES}, {_counted_sql(5)}, adasyn AS (SELECT id, label, n_other,
  coalesce(round_even(n_other * missing / nullif(sum(n_other) OVER (PARTITION BY label), 0)::double, 0), 0)::bigint AS turns
  FROM counted)"""


@query("adasyn_plan", f"WITH {_ADASYN} SELECT id, label, n_other, turns FROM adasyn")
def adasyn_plan(spark, folder):
    return rs.adasyn_plan(rare_and_rest(spark, folder)).select("id", "label", "n_other", "turns")


@query(
    "adasyn",
    f"""WITH {_ADASYN}, plan AS (SELECT adasyn.*, vec FROM adasyn JOIN v USING (id)), {_synthetic_sql("plan", "own")} {_SHOW}""",
)
def adasyn(spark, folder):
    return _shown(rs.adasyn(rare_and_rest(spark, folder)))


@query("svm_smote")
def svm_smote(spark, folder):
    return _shown(rs.svm_smote(rare_and_rest(spark, folder)))


_DENSE = f"""{_PAIRS},
  to_major AS (SELECT p.id, nid, d2, row_number() OVER (PARTITION BY p.id ORDER BY d2, nid) AS r
    FROM pairs p JOIN minority USING (id), top WHERE nlabel = top_label),
  scoped AS (SELECT id, nid, d2, 1 AS major FROM to_major UNION ALL
    SELECT id, nid, d2, 0 FROM own JOIN minority USING (id)),
  counted AS (SELECT id, sum(major)::bigint AS n_major FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS q FROM scoped) WHERE q <= 5 GROUP BY id),
  kept AS (SELECT minority.*, n_major, count(*) OVER (PARTITION BY label) AS n_kept
    FROM minority JOIN counted USING (id) WHERE n_major < 5),
  own_kept AS (SELECT p.id, d2, row_number() OVER (PARTITION BY p.id ORDER BY d2, nid) AS r
    FROM pairs p JOIN kept a ON a.id = p.id JOIN kept b ON b.id = p.nid WHERE a.label = b.label),
  own_way AS (SELECT id, sum(sqrt(d2)) AS own_way FROM own_kept WHERE r <= 5 GROUP BY id),
  major_way AS (SELECT m.id, sum(sqrt(d2)) AS major_way FROM to_major m JOIN kept USING (id)
    WHERE r <= least(5, n_kept - 1) + 1 GROUP BY m.id),
  dense AS (SELECT kept.*, round(CASE WHEN coalesce(own_way, 0) = 0 THEN 100.0::double
      ELSE least(100.0::double, major_way / own_way) END, 6) AS density
    FROM kept LEFT JOIN own_way USING (id) LEFT JOIN major_way USING (id))"""


@query("rsmote_density", f"WITH {_DENSE} SELECT id, label, n_major, density FROM dense")
def rsmote_density(spark, folder):
    return rs.rsmote_density(vectors(spark, folder)).select("id", "label", "n_major", "density")


_GROUPED = f"""{_DENSE},
  running AS (SELECT id, label, density, count(*) OVER up AS c, sum(density) OVER up AS s, sum(density * density) OVER up AS q,
      lead(density) OVER (PARTITION BY label ORDER BY density DESC, id) AS next_density,
      count(*) OVER (PARTITION BY label) AS tc, sum(density) OVER (PARTITION BY label) AS ts,
      sum(density * density) OVER (PARTITION BY label) AS tq
    FROM dense WINDOW up AS (PARTITION BY label ORDER BY density DESC, id ROWS UNBOUNDED PRECEDING)),
  errors AS (SELECT *, round((q - s * s / c) + ((tq - q) - (ts - s) * (ts - s) / (tc - c)), 6) AS error
    FROM running WHERE c < tc AND next_density <> density),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY error, c) AS k FROM errors)
    WHERE k = 1 AND c >= 2 AND tc - c >= 2),
  grouped AS (SELECT dense.*, CAST(CASE WHEN best.density IS NULL THEN 0 WHEN dense.density >= best.density THEN 1 ELSE 2 END AS INTEGER) AS grp
    FROM dense LEFT JOIN best ON best.label = dense.label)"""


@query("rsmote_clusters", f"WITH {_GROUPED} SELECT id, label, density, grp FROM grouped")
def rsmote_clusters(spark, folder):
    return rs.rsmote_groups(rs.rsmote_density(vectors(spark, folder))).select("id", "label", "density", "grp")


_RSMOTE = f"""{_GROUPED},
  weighted AS (SELECT *, 5 - n_major AS weight, count(*) OVER (PARTITION BY label, grp) AS size FROM grouped),
  quotas AS (SELECT *, greatest(0, CASE grp WHEN 0 THEN n_top - n_kept
      WHEN 1 THEN floor(size::double / n_kept * (n_top - n))
      ELSE (n_top - n) - floor((n_kept - size)::double / n_kept * (n_top - n)) END)::bigint AS quota,
      sum(weight) OVER (PARTITION BY label, grp)::bigint AS total FROM weighted),
  seats AS (SELECT *, quota * weight // total AS base, quota * weight % total AS rest FROM quotas),
  ranked AS (SELECT *, quota - sum(base) OVER (PARTITION BY label, grp) AS open, row_number() OVER (
      PARTITION BY label, grp ORDER BY rest DESC, weight DESC, density DESC, id) AS place FROM seats),
  plan AS (SELECT id, label, vec, grp, quota, weight, (base + CASE WHEN place <= open THEN 1 ELSE 0 END)::bigint AS turns FROM ranked)"""


@query("rsmote_plan", f"WITH {_RSMOTE} SELECT id, label, grp, quota, weight, turns FROM plan")
def rsmote_plan(spark, folder):
    plan = rs.rsmote_plan(rs.rsmote_groups(rs.rsmote_density(vectors(spark, folder))))
    return plan.select("id", "label", "grp", "quota", "weight", "turns")


@query(
    "rsmote",
    f"""WITH {_RSMOTE}, group_near AS (SELECT p.id, nid, row_number() OVER (PARTITION BY p.id ORDER BY d2, nid) AS r
      FROM pairs p JOIN plan a ON a.id = p.id JOIN plan b ON b.id = p.nid WHERE a.label = b.label AND a.grp = b.grp),
    {_synthetic_sql("plan", "group_near")} {_SHOW}""",
)
def rsmote(spark, folder):
    return _shown(rs.rsmote(vectors(spark, folder)))


@query("train_score")
def train_score(spark, folder):
    """One boosted-tree model per label on balanced rows: fitted, saved, read back and scored."""
    rows = checkpointed(vectors(spark, folder))
    balanced = checkpointed(
        rs.smote(rows)
        .select("label", "vec")
        .unionByName(rows.select("label", "vec"))
        .select("label", array_to_vector("vec").alias("features"))
    )
    cases = rows.select("id", "label", array_to_vector("vec").alias("features"))
    root = scratch_path(spark, "models")
    scored = None
    for label in distinct_values(rows, "label"):
        gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=5, maxDepth=3, seed=0)
        data = balanced.withColumn("y", (F.col("label") == label).cast("double"))
        path = f"{root}/{label}"
        Pipeline(stages=[gbt]).fit(data).write().save(path)
        part = PipelineModel.load(path).transform(cases).select(
            F.lit(label).alias("model"),
            (F.col("label") == label).alias("truth"),
            vector_to_array("probability")[1].alias("score"),
        )
        scored = part if scored is None else scored.unionByName(part)
    return binary_metrics(scored, F.col("truth"), F.col("score"), ["model"])
