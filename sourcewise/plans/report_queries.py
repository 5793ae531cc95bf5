"""Queries on evaluation, selection and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcewise.functions.expressions import class_of, class_probabilities
from sourcewise.operators import composite as P
from sourcewise.operators import curate, insert, neighbors
from sourcewise.operators import evaluation as V
from sourcewise.operators import evidence as E
from sourcewise.operators import reports as R
from sourcewise.plans.book import query
from sourcewise.plans.curation_queries import CLASS, FLAGGED, _flagged
from sourcewise.plans.evidence_queries import MERGED, PAIRS, phi_sql
from sourcewise.plans.space_queries import CELLS, KNN, SCORED, _cells, _flat, _points, _scored
from sourcewise.sources import files
from sourcewise.sources.bindings import LOWER, RECORDS_SQL, UPPER, read, records

R6 = lambda c: F.round(c, 6).alias(c)


def _doc(spark, sf_dir):
    return E.units(records(spark, sf_dir))


@query(MERGED + """, folds AS (SELECT entry % 10 AS fold, sum(variance * (m - 1)) AS ss, sum(m - 1) AS df FROM moments WHERE m >= 2 GROUP BY 1),
 fits AS (SELECT fold, sqrt((sum(ss) OVER () - ss) / (sum(df) OVER () - df)) AS tau FROM folds),
 held AS (SELECT a.entry, a.document, a.v AS observed, avg(b.v) AS center, count(*) AS r FROM merged a JOIN merged b ON a.entry = b.entry AND a.document <> b.document GROUP BY a.entry, a.document, a.v)
 SELECT entry, document, entry % 10 AS fold, round(observed, 6) AS observed, round(center, 6) AS center, round(tau, 6) AS tau, round(tau * sqrt(1 + 1 / r), 6) AS scale FROM held JOIN fits ON fold = entry % 10""")
def out_of_fold_predictions(spark, sf_dir):
    out = V.out_of_fold(_doc(spark, sf_dir), F.pmod("entry", F.lit(10)))
    return out.select("entry", "document", "fold", R6("observed"), R6("center"), R6("tau"), R6("scale"))


@query("""WITH u AS (SELECT DISTINCT l_partkey AS entry, CAST(l_orderkey AS VARCHAR) AS d FROM lineitem),
 every AS (SELECT entry, d, unnest(range(0, 10)) AS fold FROM u)
 SELECT fold, count(*) AS n_units FROM every e WHERE fold <> entry % 10 AND NOT EXISTS (SELECT 1 FROM u WHERE u.d = e.d AND u.entry % 10 = e.fold) GROUP BY fold""")
def leak_free_training_units(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entry"), F.col("l_orderkey").alias("document"), F.lit(1.0).alias("value"))
    return V.training_units(E.units(rows, merge_identical=False), 10, F.pmod("entry", F.lit(10)).cast("int")).groupBy("fold").agg(F.count(F.lit(1)).alias("n_units"))


@query(MERGED + """ SELECT a.entry, a.document, round(avg(b.v), 6) AS consensus, round(a.v - avg(b.v), 6) AS error FROM merged a JOIN merged b ON a.entry = b.entry AND a.document <> b.document
 GROUP BY a.entry, a.document, a.v HAVING count(*) >= 4""")
def consensus_errors(spark, sf_dir):
    return V.consensus_errors(_doc(spark, sf_dir)).select("entry", "document", R6("consensus"), R6("error"))


@query(f"""WITH {RECORDS_SQL} SELECT l_orderkey, l_linenumber, round(CASE WHEN value <= {LOWER} THEN {LOWER} - value WHEN value >= {UPPER} THEN value - {UPPER} ELSE least(value - {LOWER}, {UPPER} - value) END, 6) AS distance FROM records""")
def boundary_distances(spark, sf_dir):
    return records(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(V.distance_score(F.col("value"), LOWER, UPPER), 6).alias("distance"))


OUTCOMES = f"""WITH {RECORDS_SQL}, exact AS (SELECT entry, {CLASS('median(value)')} AS class FROM records WHERE relation = '=' GROUP BY entry),
 bounds AS (SELECT entry, document, value AS bound, CASE WHEN l_linenumber % 2 = 0 THEN '>=' ELSE '<' END AS r FROM records WHERE relation = '>'),
 outcomes AS (SELECT b.entry, b.document, CASE class WHEN 'active' THEN CASE WHEN r = '>=' AND bound >= {UPPER} THEN 'agree' WHEN r = '<' AND bound <= {UPPER} THEN 'disagree' END
  WHEN 'inactive' THEN CASE WHEN r = '<' AND bound <= {LOWER} THEN 'agree' WHEN r = '>=' AND bound > {LOWER} THEN 'disagree' END
  ELSE CASE WHEN r = '>=' AND bound >= {UPPER} OR r = '<' AND bound <= {LOWER} THEN 'disagree' END END AS outcome FROM bounds b JOIN exact USING (entry))"""


def _outcomes(spark, sf_dir):
    r = records(spark, sf_dir)
    exact = r.where("relation = '='").groupBy("entry").agg(class_of(F.median("value"), LOWER, UPPER).alias("class"))
    bounds = r.where("relation = '>'").select("entry", "document", F.col("value").alias("bound"), F.when(F.col("l_linenumber") % 2 == 0, ">=").otherwise("<").alias("r"))
    return bounds.join(exact, "entry").withColumn("outcome", V.bound_outcome(F.col("r"), F.col("bound"), F.col("class"), LOWER, UPPER))


@query(OUTCOMES + " SELECT coalesce(outcome, 'none') AS outcome, count(*) AS n FROM outcomes GROUP BY 1")
def bound_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy(F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(OUTCOMES + " SELECT entry, document, CASE WHEN count(DISTINCT outcome) = 1 THEN max(outcome) ELSE 'none' END AS outcome FROM outcomes WHERE outcome IS NOT NULL GROUP BY entry, document")
def unanimous_bounds(spark, sf_dir):
    return V.unanimous(_outcomes(spark, sf_dir), "entry", "document")


@query(FLAGGED + """ SELECT entry, document, '<' AS relation, round(9.0 - log10(raw), 6) AS bound FROM flagged WHERE reasons = ['non_exact_relation'] AND raw > 0""")
def usable_bounds(spark, sf_dir):
    return R.usable_bounds(_flagged(spark, sf_dir)).select("entry", "document", "relation", R6("bound"))


@query(f"""WITH {CELLS}, c AS (SELECT id, (id % 5 + 1) / 8.0 AS p0, (id % 3) / 16.0 AS p1, id % 3 AS shown, id % 4 = 0 AS uncertain FROM cells),
 q AS (SELECT *, 1 - p0 - p1 AS p2 FROM c), a AS (SELECT x.id AS a, y.id AS b FROM cells x JOIN cells y ON x.id < y.id AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1)
 SELECT count(*) AS pairs, round(avg(CAST(x.shown <> y.shown AS INT)), 6) AS displayed, round(avg(1 - x.p0 * y.p0 - x.p1 * y.p1 - x.p2 * y.p2), 6) AS expected, round(avg(CAST(x.uncertain OR y.uncertain AS INT)), 6) AS hidden
 FROM a JOIN q x ON x.id = a.a JOIN q y ON y.id = a.b""")
def adjacent_contrasts(spark, sf_dir):
    cells, i = _cells(spark, sf_dir), F.col("id")
    c = cells.select("id", ((i % 5 + 1) / 8.0).alias("p0"), ((i % 3) / 16.0).alias("p1"), (i % 3).alias("shown"), (i % 4 == 0).alias("uncertain")).withColumn("p2", 1 - F.col("p0") - F.col("p1"))
    out = V.pair_contrasts(neighbors.adjacent(cells), c)
    return out.select("pairs", R6("displayed"), R6("expected"), R6("hidden"))


@query(f"""WITH {SCORED}, r AS (SELECT status, y, rank() OVER (PARTITION BY status ORDER BY p) + (count(*) OVER (PARTITION BY status, p) - 1) / 2 AS r FROM scored),
 s AS (SELECT status, sum(r) FILTER (y = 1) AS w, sum(y) AS a, count(*) - sum(y) AS b FROM r GROUP BY status)
 SELECT round(sum(w - a * (a + 1) / 2) / sum(a * b), 6) AS auc, count(*) AS strata FROM s WHERE a > 0 AND b > 0""")
def stratified_auc(spark, sf_dir):
    return V.stratified_auc(_scored(spark, sf_dir), "status").select(R6("auc"), "strata")


@query("""WITH x AS (SELECT least(floor(l_tax / 0.1 * 5), 4)::INT AS bin, l_quantity AS v FROM lineitem)
 SELECT i::INT AS bin, round(i / 5, 6) AS low, round((i + 1) / 5, 6) AS high, count(v) AS n, round(avg(v), 6) AS mean FROM range(5) t(i) LEFT JOIN x ON bin = i GROUP BY i""")
def value_by_recall_bin(spark, sf_dir):
    out = V.recall_bins(read(spark, sf_dir, "lineitem").select((F.col("l_tax") / 0.1).alias("recall"), F.col("l_quantity").alias("value")))
    return out.select("bin", R6("low"), R6("high"), "n", R6("mean"))


@query(KNN + " SELECT s.src, round(sum(weight * abs(a.label - b.label)) / 5, 6) AS expected_error FROM shell s JOIN e a ON a.id = s.src JOIN e b ON b.id = s.dst GROUP BY s.src")
def expected_neighbor_error(spark, sf_dir):
    return V.expected_error(neighbors.knn(_points(spark, sf_dir), 5), _points(spark, sf_dir).select("id", F.col("label").alias("value")), 5).select("src", R6("expected_error"))


@query("""WITH p AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, abs(a.n_nationkey - b.n_nationkey)::DOUBLE AS dist, abs(a.n_regionkey - b.n_regionkey)::DOUBLE AS ldist FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey),
 a AS (SELECT src, row_number() OVER w AS rank, avg(dist) OVER (PARTITION BY src ORDER BY dist, dst ROWS UNBOUNDED PRECEDING) AS m FROM p WINDOW w AS (PARTITION BY src ORDER BY dist, dst)),
 b AS (SELECT src, row_number() OVER w AS rank, avg(dist) OVER (PARTITION BY src ORDER BY ldist, dst ROWS UNBOUNDED PRECEDING) AS m FROM p WINDOW w AS (PARTITION BY src ORDER BY ldist, dst))
 SELECT a.src, a.rank, round(a.m, 6) AS reference_mean, round(b.m, 6) AS layout_mean FROM a JOIN b USING (src, rank)""")
def preservation_curves(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.toDF("src", "r1"), n.toDF("dst", "r2")
    pairs = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", F.abs(F.col("src") - F.col("dst")).cast("double").alias("dist"), F.abs(F.col("r1") - F.col("r2")).cast("double").alias("layout_dist"))
    return V.preservation_curve(pairs).select("src", F.col("rank").cast("bigint").alias("rank"), R6("reference_mean"), R6("layout_mean"))


@query("""WITH d AS (SELECT c_nationkey, avg(c_acctbal) AS d FROM customer GROUP BY 1)
 SELECT count(*) AS n, round(avg(d), 4) AS mean, round(avg(d) - 2.0638985616280205 * stddev_samp(d) / sqrt(count(*)), 4) AS low, round(avg(d) + 2.0638985616280205 * stddev_samp(d) / sqrt(count(*)), 4) AS high FROM d""")
def student_interval(spark, sf_dir):
    d = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("d"))
    return V.t_interval(d).select("n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


def _p_of_mean(doc, fit):
    post = E.posteriors(doc, fit)
    low, mid, high = class_probabilities(F.col("mean"), F.col("posterior_scale"), LOWER, UPPER)
    own = class_of(F.col("mean"), LOWER, UPPER)
    return post.select("entry", F.when(own == "inactive", low).when(own == "active", high).otherwise(mid).alias("p"))


def _p_sql(mean: str, scale: str) -> str:
    low, high = phi_sql(f"({LOWER} - {mean}) / {scale}"), phi_sql(f"({mean} - {UPPER}) / {scale}")
    return f"CASE WHEN {mean} <= {LOWER} THEN {low} WHEN {mean} >= {UPPER} THEN {high} ELSE greatest(0.0, least(1.0, 1 - {low} - {high})) END"


@query(MERGED + f""", fit AS (SELECT sqrt(sum(variance * (m - 1)) / sum(m - 1)) AS tau FROM moments WHERE m >= 2),
 r AS (SELECT entry, avg(value) AS rmean, count(*) AS k FROM records GROUP BY entry),
 z AS (SELECT entry, mean, rmean, tau / sqrt(m) AS a, tau / sqrt(k) AS b FROM moments JOIN r USING (entry) CROSS JOIN fit),
 p AS (SELECT entry, {_p_sql('mean', 'a')} AS by_documents, {_p_sql('rmean', 'b')} AS by_records FROM z)
 SELECT CASE WHEN by_documents < 0.8 AND by_records >= 0.8 THEN 'gained' WHEN by_documents >= 0.8 AND by_records < 0.8 THEN 'lost' ELSE 'same' END AS direction, count(*) AS n FROM p GROUP BY 1""")
def support_flips(spark, sf_dir):
    r = records(spark, sf_dir)
    return V.count_flips(r, E.units(r), 0.8, _p_of_mean).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(0.7, 6) AS p0, round(CASE WHEN l_discount + l_tax > 0 THEN 0.3 * l_discount / (l_discount + l_tax) ELSE 0.15 END, 6) AS p1,
 round(CASE WHEN l_discount + l_tax > 0 THEN 0.3 * l_tax / (l_discount + l_tax) ELSE 0.15 END, 6) AS p2 FROM lineitem""")
def rescaled_probabilities(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    p1, p2 = V.rescaled(F.lit(0.7), F.lit("x"), [F.col("l_discount").cast("double"), F.col("l_tax").cast("double")])
    return li.select("l_orderkey", "l_linenumber", F.lit(0.7).alias("p0"), F.round(p1, 6).alias("p1"), F.round(p2, 6).alias("p2"))


@query(f"WITH {SCORED} SELECT count(*) AS n, 0.0::DOUBLE AS mean_residual, 0.0::DOUBLE AS mean_score FROM scored")
def recalibrated_residuals(spark, sf_dir):
    """After recalibration both score equations hold: residuals and residuals times logit vanish."""
    table = _scored(spark, sf_dir).withColumn("p", 0.05 + 0.9 * F.col("p"))
    slope, intercept = V.recalibration(table)
    x = F.log(F.col("p") / (1 - F.col("p")))
    r = F.col("y") - 1 / (1 + F.exp(-(slope * x + intercept)))
    return table.agg(F.count(F.lit(1)).alias("n"), F.round(F.abs(F.avg(r)), 6).alias("mean_residual"), F.round(F.abs(F.avg(r * x)), 6).alias("mean_score"))


@query(f"""WITH {RECORDS_SQL} SELECT entry, max(value) - min(value) <= 1 AS range_within_one, round(-coalesce(stddev_samp(value), 0), 6) AS minus_sd, count(*) AS n FROM records GROUP BY entry""")
def agreement_comparators(spark, sf_dir):
    return V.comparators(records(spark, sf_dir)).select("entry", "range_within_one", R6("minus_sd"), "n")


@query("""WITH s AS (SELECT l_returnflag AS target, l_linestatus AS method, l_discount * 10 AS p, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem)
 SELECT target, method, count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier FROM s GROUP BY GROUPING SETS ((target, method), (method))""")
def scores_by_sets(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("method"), (F.col("l_discount") * 10).alias("p"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"))
    return V.scores_by_sets(s).select("target", "method", "n", R6("accuracy"), R6("brier"))


@query("SELECT round(avg(o_totalprice), 2) AS mean, true AS covered FROM orders")
def clustered_mean(spark, sf_dir):
    out = V.cluster_bootstrap(read(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("double").alias("x")), "o_custkey", 100)
    return out.select(F.round("mean", 2).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("covered"))


@query()
def two_stage_mean(spark, sf_dir):
    """Mean order price with its interval when priorities, and then their customers, are drawn anew."""
    return V.two_stage_bootstrap(read(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", F.col("o_totalprice").cast("double").alias("x")), "o_orderpriority", "o_custkey", 400)


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT l_orderkey % 7 AS target, l_orderkey, l_linenumber, value, md5('3:' || l_orderkey || ':' || l_linenumber) AS draw FROM records),
 a AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY l_orderkey, l_linenumber, value) AS i FROM r), b AS (SELECT target, value, row_number() OVER (PARTITION BY target ORDER BY draw, l_orderkey, l_linenumber, value) AS i FROM r)
 SELECT a.target, l_orderkey, l_linenumber, round(a.value, 6) AS value, round(b.value, 6) AS shuffled FROM a JOIN b USING (target, i)""")
def permuted_values(spark, sf_dir):
    """Values dealt anew within each group, by a digest of the key."""
    r = records(spark, sf_dir).select((F.col("l_orderkey") % 7).alias("target"), "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "value").alias("key"), "value")
    draw = F.md5(F.concat_ws(":", F.lit("3"), "l_orderkey", "l_linenumber"))
    return V.permuted_within(r, "target", "value", "key", draw=draw).select("target", "l_orderkey", "l_linenumber", R6("value"), R6("shuffled"))


@query(MERGED + f""", prior AS (SELECT 4.0 + i * 0.05 AS x, 1.0 + i % 3 AS w FROM range(30) t(i)),
 q AS (SELECT entry, x, w * exp(-0.5 * pow((mean - x) * sqrt(m) / 0.25, 2)) AS l FROM moments CROSS JOIN prior)
 SELECT entry, round(sum(CASE WHEN x <= {LOWER} THEN l ELSE 0 END) / sum(l), 6) AS p_inactive, round(sum(CASE WHEN x > {LOWER} AND x < {UPPER} THEN l ELSE 0 END) / sum(l), 6) AS p_medium, round(sum(CASE WHEN x >= {UPPER} THEN l ELSE 0 END) / sum(l), 6) AS p_active FROM q GROUP BY entry""")
def grid_posteriors(spark, sf_dir):
    prior = spark.range(30).select((4.0 + F.col("id") * 0.05).alias("x"), (1.0 + F.col("id") % 3).alias("weight"))
    return V.grid_prediction(_doc(spark, sf_dir), prior, 0.25, LOWER, UPPER).select("entry", R6("p_inactive"), R6("p_medium"), R6("p_active"))


@query()
def npmle_prior(spark, sf_dir):
    """The prior on a grid of tenths after 30 rounds or when no weight moves by a thousandth."""
    return V.npmle(_doc(spark, sf_dir), 0.25, step=0.1, tolerance=1e-3, rounds=30)


@query()
def student_posteriors(spark, sf_dir):
    """Classes of entries under Student's errors and a prior on a grid."""
    prior = spark.range(30).select((4.0 + F.col("id") * 0.05).alias("x"), (1.0 + F.col("id") % 3).alias("weight"))
    return V.law_prediction(_doc(spark, sf_dir), prior, 0.25, LOWER, UPPER, 4.0).select("entry", R6("p_inactive"), R6("p_medium"), R6("p_active"))


# Neighbour relations

FCUT = """, fcut AS (SELECT src, dst FROM fpairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 5),
 cut AS (SELECT src, dst FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 5)"""


@query(KNN + FCUT + " SELECT c.src, round(count(f.dst) / count(*), 6) AS overlap FROM cut c LEFT JOIN fcut f ON f.src = c.src AND f.dst = c.dst GROUP BY c.src")
def exact_neighbor_overlap(spark, sf_dir):
    return neighbors.exact_overlap(neighbors.knn(_points(spark, sf_dir), 5), neighbors.knn(_flat(spark, sf_dir), 5), 5).select("src", R6("overlap"))


@query(KNN + """, r AS (SELECT s.src, count(f.dst) / count(*) AS recall FROM shell s LEFT JOIN fnear f ON f.src = s.src AND f.dst = s.dst GROUP BY s.src),
 p AS (SELECT f.src, count(s.dst) / count(*) AS precision FROM fnear f LEFT JOIN shell s ON f.src = s.src AND f.dst = s.dst GROUP BY f.src)
 SELECT src, round(recall, 6) AS recall, round(precision, 6) AS precision FROM r JOIN p USING (src)""")
def neighbor_agreement(spark, sf_dir):
    return neighbors.agreement(neighbors.knn(_points(spark, sf_dir), 5), neighbors.knn(_flat(spark, sf_dir), 5)).select("src", R6("recall"), R6("precision"))


@query(KNN + """ SELECT coalesce(s.dst, f.dst) AS dst, CASE WHEN s.dst IS NOT NULL AND f.dst IS NOT NULL THEN 'shared' WHEN s.dst IS NOT NULL THEN 'representation_only' ELSE 'grid_only' END AS kind
 FROM (SELECT dst FROM shell WHERE src = 3) s FULL JOIN (SELECT dst FROM fnear WHERE src = 3) f ON s.dst = f.dst""")
def compared_neighbors(spark, sf_dir):
    return neighbors.compared(neighbors.knn(_points(spark, sf_dir), 5), neighbors.knn(_flat(spark, sf_dir), 5), 3)


@query(KNN + """ SELECT src, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT coalesce(s.src, f.src) AS src, s.dst IS NOT NULL AS a, f.dst IS NOT NULL AS b FROM shell s FULL JOIN fnear f ON s.src = f.src AND s.dst = f.dst) GROUP BY src""")
def neighbor_stability(spark, sf_dir):
    return neighbors.mean_jaccard(neighbors.knn(_points(spark, sf_dir), 5), neighbors.knn(_flat(spark, sf_dir), 5)).select("src", R6("jaccard"))


@query(f"WITH {CELLS} SELECT id FROM cells WHERE abs(row - 3) <= 1 AND abs(col - 12) <= 1")
def cell_window(spark, sf_dir):
    return neighbors.window(_cells(spark, sf_dir), 3, 12).select("id")


# Curation and selection


@query(FLAGGED + f""", e AS (SELECT entry, count(value) AS n, min(value) AS lo, max(value) AS hi FROM flagged WHERE len(reasons) = 0 GROUP BY entry)
 SELECT count(*) AS n_records, count(*) FILTER (len(reasons) = 0) AS n_retained, count(*) FILTER (len(reasons) > 0) AS n_excluded, count(DISTINCT document) FILTER (len(reasons) = 0) AS n_documents,
 (SELECT count(*) FROM e) AS n_entries, (SELECT count(*) FROM e WHERE n > 1) AS n_repeated, (SELECT count(*) FROM e WHERE {CLASS('lo')} <> {CLASS('hi')}) AS n_crossing, (SELECT count(*) FROM e WHERE hi - lo > 1) AS n_wide FROM flagged""")
def curation_report(spark, sf_dir):
    return R.curation_report(_flagged(spark, sf_dir), LOWER, UPPER)


@query(f"""SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 5 = 0 THEN 'labelled' END, CASE WHEN p_size % 3 = 0 THEN 'existing' END, {CLASS('CASE WHEN p_size % 2 = 0 THEN log10(p_retailprice * 40) END')}, 'unlabelled') AS class FROM part""")
def table_classes(spark, sf_dir):
    s = F.col("p_size")
    klass = R.table_class(F.when(s % 5 == 0, " Labelled "), F.when(s % 3 == 0, "existing"), F.when(s % 2 == 0, F.log10(F.col("p_retailprice") * 40)), LOWER, UPPER)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), klass.alias("class"))


@query("""WITH t AS (SELECT p_partkey AS position, 's' || (p_partkey % 700) AS structure, CASE WHEN p_size % 11 = 0 THEN -1.0 ELSE p_retailprice::DOUBLE END AS raw, CASE WHEN p_size % 7 = 0 THEN 'kg' ELSE 'nM' END AS unit FROM part),
 x AS (SELECT *, CASE WHEN raw <= 0 THEN 'nonpositive_activity_value' WHEN unit = 'kg' THEN 'unrecognized_activity_unit' END AS problem FROM t)
 SELECT position, structure, problem, round(CASE WHEN raw > 0 AND unit = 'nM' THEN 9 - log10(raw) END, 6) AS p_value FROM x WHERE problem IS NOT NULL
 UNION ALL SELECT position, structure, problem, round(9 - log10(raw), 6) FROM (SELECT * FROM x WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY structure ORDER BY position) = 1)""")
def prepared_table(spark, sf_dir):
    p = F.col("p_partkey")
    t = read(spark, sf_dir, "part").select(
        p.alias("position"), F.concat(F.lit("s"), (p % 700).cast("string")).alias("structure"), F.when(F.col("p_size") % 11 == 0, -1.0).otherwise(F.col("p_retailprice").cast("double")).alias("raw"),
        F.when(F.col("p_size") % 7 == 0, "kg").otherwise("nM").alias("unit"),
    )
    return R.prepare_table(t, "first").select("position", "structure", "problem", R6("p_value"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey = 17")
def picked_entry(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("x; CHEMBL"), F.col("c_custkey").cast("string")).alias("ids"))
    return R.pick_entry(c, "chembl17").select("id")


@query("""WITH q AS (SELECT p_partkey AS position, 'q' || p_partkey AS query_id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 40 END AS structure FROM part WHERE p_partkey <= 100),
 f AS (SELECT *, CASE WHEN structure IS NOT NULL THEN first_value(query_id) OVER (PARTITION BY structure ORDER BY position) END AS first_id FROM q),
 s AS (SELECT *, CASE WHEN structure IS NULL THEN 'invalid' WHEN first_id <> query_id THEN 'duplicate_query' WHEN structure < 8 THEN 'in_reference' ELSE 'mapped' END AS status FROM f)
 SELECT query_id, CASE status WHEN 'mapped' THEN query_id WHEN 'in_reference' THEN 'r' || structure WHEN 'duplicate_query' THEN first_id END AS shown_id, status FROM s""")
def resolved_queries(spark, sf_dir):
    p = F.col("p_partkey")
    q = read(spark, sf_dir, "part").where("p_partkey <= 100").select(p.alias("position"), F.concat(F.lit("q"), p.cast("string")).alias("query_id"), F.when(p % 10 != 0, p % 40).alias("structure"))
    ref = spark.range(8).select(F.col("id").alias("structure"), F.col("id").alias("position"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("ref_id"))
    return R.resolved(insert.check(q, ref))


@query(f"""WITH {CELLS}, w AS (SELECT *, row + (id % 3) AS wr, col + (id % 2) AS wc FROM cells), d AS (SELECT *, sqrt(pow(row - wr, 2) + pow(col - wc, 2)) AS d FROM w)
 SELECT count(*) AS n_points, 10000::BIGINT AS n_cells, round(count(*) / 10000, 6) AS occupancy, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width, round(avg(d), 6) AS mean_shift, round(median(d), 6) AS median_shift, round(quantile_cont(d, 0.95), 6) AS shift_95 FROM d""")
def layout_metrics(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("wish_row", F.col("row") + F.col("id") % 3).withColumn("wish_col", F.col("col") + F.col("id") % 2)
    out = R.layout_metrics(c, 100)
    return out.select("n_points", "n_cells", R6("occupancy"), "height", "width", R6("mean_shift"), R6("median_shift"), R6("shift_95"))


@query("""WITH t AS (SELECT o_orderpriority AS dataset, o_custkey % 3 AS shown, o_orderkey % 3 AS observed FROM orders),
 a AS (SELECT dataset, shown AS c, count(*) AS x FROM t GROUP BY ALL), b AS (SELECT dataset, observed AS c, count(*) AS y FROM t GROUP BY ALL), xy AS (SELECT dataset, sum(x * y) AS s FROM a JOIN b USING (dataset, c) GROUP BY dataset)
 SELECT dataset, count(*) AS n, round(avg(CAST(shown = observed AS INT)), 6) AS agreement, round(max(s) / count(*) / count(*), 6) AS chance, round(avg(CAST(shown = observed AS INT)) - max(s) / count(*) / count(*), 6) AS difference FROM t JOIN xy USING (dataset) GROUP BY dataset""")
def agreement_by_set(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 3).alias("shown"), (F.col("o_orderkey") % 3).alias("observed"))
    return R.agreement_by_set(t).select("dataset", "n", R6("agreement"), R6("chance"), R6("difference"))


@query(PAIRS + """ SELECT document_a, document_b, round(med, 6) AS median_offset, abs(med) >= 0.3 AND agreement >= 0.8 AS systematic_offset FROM offsets WHERE shared_entries >= 3
 ORDER BY systematic_offset DESC, abs(med) DESC, document_a, document_b LIMIT 10""")
def shown_document_pairs(spark, sf_dir):
    return R.top_pairs(E.pair_offsets(records(spark, sf_dir), offset_threshold=0.3)).select("document_a", "document_b", R6("median_offset"), "systematic_offset")


@query(PAIRS + """ SELECT document_a, document_b, shared_entries FROM offsets WHERE shared_entries >= 3 AND (document_a IN (SELECT document FROM units WHERE entry = 7) OR document_b IN (SELECT document FROM units WHERE entry = 7))""")
def pairs_of_an_entry(spark, sf_dir):
    r = records(spark, sf_dir)
    return R.entry_pairs(E.pair_offsets(r), E.units(r, merge_identical=False), 7).select("document_a", "document_b", "shared_entries")


@query("""WITH m AS (SELECT p_brand AS g, p_partkey AS id, p_type AS structure, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS is_centre FROM part)
 SELECT g AS "group", id, row_number() OVER (PARTITION BY g ORDER BY is_centre DESC, structure, id)::INT AS place FROM m QUALIFY place <= 12""")
def shown_group_members(spark, sf_dir):
    from pyspark.sql import Window

    m = read(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), F.col("p_type").alias("structure"))
    m = m.withColumn("is_centre", F.col("id") == F.min("id").over(Window.partitionBy("group")))
    return R.group_members(m).select("group", "id", "place")


@query("""WITH c AS (SELECT p_type AS feature, count(*) AS n FROM part GROUP BY 1) SELECT feature, n, row_number() OVER (ORDER BY n DESC, length(feature) DESC, feature) AS place FROM c""")
def feature_ranks(spark, sf_dir):
    return R.feature_ranks(read(spark, sf_dir, "part").select(F.col("p_type").alias("feature")))


@query("""WITH q AS (SELECT c_custkey AS query_id, c_nationkey AS reference_id FROM customer), o AS (SELECT o_custkey AS query_id, count(*) AS n, median(o_totalprice::DOUBLE) AS m FROM orders GROUP BY 1),
 r AS (SELECT c_nationkey AS reference_id, median(c_acctbal::DOUBLE) AS rm FROM customer WHERE c_nationkey < 20 GROUP BY 1)
 SELECT query_id, reference_id, coalesce(n, 0) AS n_own, round(m, 4) AS own_median, round(rm, 4) AS reference_median, round(m - rm, 4) AS difference FROM q LEFT JOIN o USING (query_id) LEFT JOIN r USING (reference_id)""")
def own_measurements(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    q = c.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("reference_id"))
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_totalprice").cast("double").alias("value"))
    ref = c.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("reference_id")).agg(F.median(F.col("c_acctbal").cast("double")).alias("reference_median"))
    return R.own_measurements(q, m, ref).select("query_id", "reference_id", "n_own", *(F.round(x, 4).alias(x) for x in ("own_median", "reference_median", "difference")))


@query("SELECT n_nationkey, n_regionkey, r_name AS n_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def metadata_overwrites(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    meta = read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"))
    return R.with_metadata(n, meta, "n_regionkey").select("n_nationkey", "n_regionkey", "n_name")


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT entry FROM records WHERE document IN (3, 5, 8)")
def members_of_sources(spark, sf_dir):
    return R.members_of_sources(records(spark, sf_dir), [3, 5, 8])


@query("SELECT o_custkey AS customer, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def several_keys(spark, sf_dir):
    return R.one_key(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderstatus"), "customer", "o_orderstatus")


LINKS = "(SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://doi.org/10.1021/a b<' || c_custkey || '>' WHEN 1 THEN 'doi: 10.1000/x' || c_custkey WHEN 2 THEN 'PMID: ' || c_custkey WHEN 3 THEN 'https://example.org/' || c_custkey ELSE 'note ' || c_custkey END AS ref FROM customer)"


@query(f"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'doi' WHEN 2 THEN 'pmid' WHEN 3 THEN 'url' ELSE 'text' END AS kind,
 CASE c_custkey % 5 WHEN 1 THEN '10.1000/x' || c_custkey WHEN 2 THEN 'PMID ' || c_custkey ELSE ref END AS label,
 CASE c_custkey % 5 WHEN 1 THEN 'https://doi.org/10.1000/x' || c_custkey WHEN 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || c_custkey || '/' WHEN 3 THEN ref END AS url FROM {LINKS}""")
def reference_links(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    ref = F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10.1021/a b<"), s, F.lit(">"))).when(k % 5 == 1, F.concat(F.lit("doi: 10.1000/x"), s)).when(k % 5 == 2, F.concat(F.lit("PMID: "), s))
    ref = ref.when(k % 5 == 3, F.concat(F.lit("https://example.org/"), s)).otherwise(F.concat(F.lit("note "), s))
    return read(spark, sf_dir, "customer").select("c_custkey", R.reference_link(ref).alias("x")).select("c_custkey", "x.kind", "x.label", "x.url")


@query("""SELECT c_custkey, array_to_string(list_concat(CASE WHEN c_custkey % 2 = 0 THEN ['https://doi.org/10.1/x' || c_custkey] ELSE [] END, list_concat(CASE WHEN c_custkey % 3 = 0 THEN ['https://pubmed.ncbi.nlm.nih.gov/' || c_custkey || '/'] ELSE [] END,
 CASE WHEN c_custkey % 7 = 0 THEN ['https://patents.google.com/patent/US' || c_custkey || 'B2'] ELSE [] END)), ' ') AS urls FROM customer""")
def document_link_lists(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    links = R.document_links(F.when(k % 2 == 0, F.concat(F.lit("10.1/x"), s)), F.when(k % 3 == 0, s), F.when(k % 7 == 0, F.concat(F.lit("US-"), s, F.lit("-B2"))))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(links, lambda x: x["url"]), " ").alias("urls"))


@query("""SELECT c_nationkey, array_to_string(list_transform(list_sort(list(DISTINCT round(c_acctbal / 1000, 1)::DOUBLE + 0.0::DOUBLE)), lambda x: format('{:.2f}', x)), '; ') AS values FROM customer GROUP BY 1""")
def value_texts(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.round(F.col("c_acctbal") / 1000, 1).cast("double")).alias("v"))
    return g.select("c_nationkey", R.value_text(F.col("v")).alias("values"))


@query("SELECT CASE WHEN l_discount < 0.02 THEN 'low' WHEN l_discount < 0.07 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def coverage_buckets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(R.bucket(F.col("l_discount"), [0.02, 0.07], ["low", "middle", "high"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS e, o_orderkey // 8 AS d FROM orders WHERE o_custkey % 4 = 0), p AS (SELECT DISTINCT a.e AS a, b.e AS b FROM l a JOIN l b USING (d)),
 reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b WHERE p.b < r.a + 1000000) SELECT a AS entry, min(b) AS cluster FROM reach GROUP BY a""")
def clusters_by_source(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_custkey % 4 = 0").select(F.col("o_custkey").alias("entry"), F.floor(F.col("o_orderkey") / 8).alias("document"))
    return R.clusters_by_source(o)


@query("SELECT p_partkey AS id, round(p_retailprice::DOUBLE, 6) AS v1, p_size::DOUBLE AS v2 FROM part")
def external_vectors(spark, sf_dir):
    t = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("emb_2"), F.col("p_retailprice").alias("emb_1"))
    return R.external_vectors(t, "p_partkey", "emb_").select("id", F.round(F.get("v", F.lit(0)), 6).alias("v1"), F.get("v", F.lit(1)).alias("v2"))


@query("SELECT 'p_partkey' AS key, count(DISTINCT p_partkey) AS n FROM part")
def entity_key(spark, sf_dir):
    t = read(spark, sf_dir, "part")
    key = R.entity_key(t, ["p_brand", "missing", "p_partkey"], "p_name")
    return t.agg(F.lit(key).alias("key"), F.countDistinct(key).alias("n"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS whole, CASE WHEN o_custkey % 2 = 0 THEN (o_custkey // 2)::VARCHAR ELSE (o_custkey / 2)::VARCHAR END AS half FROM orders")
def reference_texts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", R.reference_text(F.col("o_custkey"), "bigint").alias("whole"), R.reference_text(F.col("o_custkey") / 2, "double").alias("half"))


@query("SELECT g AS \"group\", p_partkey AS id, mean FROM (SELECT p_brand AS g, p_partkey FROM part) LEFT JOIN (SELECT p_brand AS g, round(avg(p_retailprice), 4) AS mean FROM part WHERE p_size > 48 GROUP BY 1) USING (g)")
def members_with_summary(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    summary = part.where("p_size > 48").groupBy(F.col("p_brand").alias("group")).agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return R.joined_summary(part.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id")), summary)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 500")
def fixed_subset(spark, sf_dir):
    return V.fixed_subset(read(spark, sf_dir, "orders"), "o_orderkey", 500, draw=F.md5(F.concat_ws(":", F.lit("5"), "o_orderkey"))).select("o_orderkey", "o_custkey")


# Entry points


def _export(spark, sf_dir):
    r = records(spark, sf_dir)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("brand"))
    return r.join(parts, "entry").withColumn("structure", F.concat(F.lit("s"), (F.col("entry") % 300).cast("string"))).withColumn("parent", F.when(F.col("quantity") > 25, F.col("structure")))


EXPORT = FLAGGED.replace("CASE WHEN upper(trim(status)) IS DISTINCT FROM 'O' THEN 'status_mismatch' END", "NULL") + """,
 kept AS (SELECT *, 's' || (entry % 300) AS structure FROM flagged WHERE len(reasons) = 0), bad AS (SELECT structure FROM kept GROUP BY structure HAVING count(DISTINCT entry) > 1),
 good AS (SELECT * FROM kept WHERE structure NOT IN (SELECT structure FROM bad))"""


@query(EXPORT + """ SELECT (SELECT count(*) FROM good) AS n_retained, (SELECT count(*) FROM flagged) - (SELECT count(*) FROM good) AS n_excluded, (SELECT count(DISTINCT entry) FROM good) AS n_entries, (SELECT count(*) FROM bad) AS n_conflicts""")
def curated_export(spark, sf_dir):
    run = P.curate_export(_export(spark, sf_dir), LOWER, UPPER, conflicts="exclude")
    n = run.conflicts.agg(F.count(F.lit(1)).alias("n_conflicts"))
    return run.report.join(n).select("n_retained", "n_excluded", "n_entries", "n_conflicts")


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT *, 'w' || (l_linenumber % 2) AS structure FROM records), c AS (SELECT entry, structure, count(*) AS n FROM k GROUP BY ALL)
 SELECT entry, count(value) AS n_values, round(median(value), 6) AS median_value, arg_min(structure, (-n, structure)) AS structure, count(DISTINCT structure) AS n_record_structures, count(DISTINCT document) AS n_documents, count(DISTINCT status) AS n_assays
 FROM k JOIN c USING (entry, structure) GROUP BY entry""")
def rolled_up_entries(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("structure", F.concat(F.lit("w"), (F.col("l_linenumber") % 2).cast("string"))).withColumn("assay", F.col("status"))
    return P.roll_up(r, LOWER, UPPER).select("entry", "n_values", R6("median_value"), "structure", "n_record_structures", "n_documents", "n_assays")


@query(f"""WITH {RECORDS_SQL}, j AS (SELECT *, CASE WHEN raw <= 0 THEN 'nonpositive_activity_value' WHEN unit = 'kg' THEN 'unrecognized_activity_unit' WHEN relation <> '=' THEN 'non_exact_relation' END AS reason FROM records),
 g AS (SELECT entry, document, -log10(raw) + CASE unit WHEN 'M' THEN 0 WHEN 'mM' THEN 3 WHEN 'uM' THEN 6 WHEN 'nM' THEN 9 ELSE 12 END AS v FROM j WHERE reason IS NULL)
 SELECT entry, count(*) AS n_values, round(median(v), 6) AS median_value, count(DISTINCT document) AS n_documents FROM g GROUP BY entry""")
def generic_entries(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("structure", F.col("entry").cast("string"))
    entries, _, _ = P.generic_records(r, 3.0, 6.0)
    return entries.select("entry", "n_values", R6("median_value"), "n_documents")


@query("SELECT count(*) AS n_points, count(*) AS n_distinct FROM embeddings")
def built_layout(spark, sf_dir):
    """Every point has a cell of its own inside the lattice."""
    cells, _ = P.build_layout(_points(spark, sf_dir).select("id", F.transform("v", lambda x: x.cast("double")).alias("v")), method="sparse")
    return cells.where("row >= 0 and col >= 0").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("row", "col").alias("n_distinct"))


@query(f"""WITH {RECORDS_SQL} SELECT (SELECT count(*) FROM records WHERE entry = 7) AS n_records, 0::BIGINT AS n_differences, (SELECT count(DISTINCT document) FROM records WHERE entry = 7) AS n_documents""")
def audited_entry(spark, sf_dir):
    r = records(spark, sf_dir)
    entries = curate.annotate(r, LOWER, UPPER).withColumn("ids", F.col("entry").cast("string"))
    found = P.audit_entry(entries, r, E.pair_offsets(r), LOWER, UPPER, wanted="7")
    documents = found["units"].select(F.explode("documents").alias("d")).agg(F.countDistinct("d").alias("n_documents"))
    return found["records"].agg(F.count(F.lit(1)).alias("n_records")).join(found["differences"].agg(F.count(F.lit(1)).alias("n_differences"))).join(documents)


@query(PAIRS + """ SELECT document_a, document_b, (SELECT count(*) FROM pairs) AS observed_document_pair_count FROM offsets WHERE shared_entries >= 3""")
def offsets_with_totals(spark, sf_dir):
    return files.with_totals(*E.pair_offsets_and_totals(records(spark, sf_dir))).select("document_a", "document_b", "observed_document_pair_count")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","x":' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '0.5' END || '}' AS json FROM nation""")
def json_records(spark, sf_dir):
    x = F.when(F.col("n_nationkey") % 2 == 0, float("nan")).otherwise(0.5)
    return files.json_rows(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", x.alias("x")))


@query("SELECT count(*) AS n, count(*) FILTER (n_regionkey = 2) AS n_inserted FROM nation WHERE n_regionkey IN (1, 2)")
def reference_and_inserted(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    out = P.all_points(n.where("n_regionkey = 1").select("n_nationkey", "n_name"), n.where("n_regionkey = 2").select("n_nationkey", "n_regionkey"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("inserted").alias("n_inserted"))
