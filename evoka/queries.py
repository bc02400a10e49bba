"""The operators on the test tables, each beside the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Settings, Window
from .functions.columns import at_rail, flag_code, in_window, neat, reasons, side_of, sign_match, strictly_between
from .operators import effects, evaluate, model, relational, segments, signal, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
POINTS = Settings(sample_rate=64.0, epoch_s=(0.0, 1.0))
WINDOWS = (Window("early", 10, 25), Window("late", 30, 60))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[neat(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def _points(spark, sf_dir) -> DataFrame:
    """(vec_id, label, i, v): the embeddings as series of 64 points."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


POINTS_SQL = "pts AS (SELECT vec_id, label, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("""WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
    SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS "start", max(event_id) AS "end", count(*) AS length FROM b GROUP BY ALL""")
def run_segments(spark, sf_dir):
    return segments.run_segments(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


CUES_SQL = """c AS (SELECT user_id, event_id AS cue, row_number() OVER w AS place, coalesce(lead(event_id) OVER w, 1000000000) AS nxt, value AS cue_value FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (SELECT c.user_id, c.place, e.event_id, e.value FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = 'purchase' AND e.event_id > c.cue AND e.event_id < c.nxt),
    f AS (SELECT user_id, place, min(event_id) AS target, arg_min(value, event_id) AS target_value, count(*) AS n FROM m GROUP BY ALL)"""


def _cues(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "event_type", "value")
    cues = segments.intervals(rows.where("event_type = 'click'").select("user_id", "at", F.col("value").alias("cue_value")), ["user_id"], "at", F.lit(1_000_000_000))
    found = segments.in_intervals(cues, rows.where("event_type = 'purchase'").select("user_id", "at", "value"), ["user_id"], "at")
    return segments.first_matches(cues, found, ["user_id"], "at", ["value"], "target")


@query(f"WITH {CUES_SQL} SELECT user_id, cue, c.place::BIGINT AS place, target, coalesce(n, 0)::BIGINT AS n_target FROM c LEFT JOIN f USING (user_id, place)")
def cue_target_match(spark, sf_dir):
    return _cues(spark, sf_dir).select("user_id", F.col("at").alias("cue"), F.col("place").cast("long").alias("place"), F.col("target.at").alias("target"), F.col("n_target").cast("long").alias("n_target"))


@query(f"""WITH {CUES_SQL} SELECT c.user_id, c.cue, CASE WHEN cue_value > 50 THEN 'R' WHEN cue_value < 50 THEN 'L' ELSE '' END AS cue_side,
    sign(cue_value - 50) = sign(target_value - 50) AS matched, coalesce((sign(cue_value - 50) = sign(target_value - 50))::INT, -1)::TINYINT AS code,
    CASE WHEN n IS NULL THEN 'missing_target' WHEN n > 1 THEN 'multiple_targets' || CASE WHEN sign(cue_value - 50) <> sign(target_value - 50) THEN ';mismatch' ELSE '' END
         WHEN sign(cue_value - 50) <> sign(target_value - 50) THEN 'mismatch' ELSE 'none' END AS reason
    FROM c LEFT JOIN f USING (user_id, place)""")
def reaction_labels(spark, sf_dir):
    rows = _cues(spark, sf_dir)
    cue, target = F.col("cue_value") - 50, F.col("target.value") - 50
    matched = sign_match(cue, target)
    why = reasons(("missing_target", F.col("n_target") == 0), ("multiple_targets", F.col("n_target") > 1), ("mismatch", ~matched))
    return rows.select("user_id", F.col("at").alias("cue"), side_of(cue).alias("cue_side"), matched.alias("matched"), flag_code(matched).alias("code"), why.alias("reason"))


@query("""WITH a AS (SELECT user_id, value - lag(value) OVER w AS d, event_id - lag(event_id) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, round(max(abs(d)), 6) AS max_abs_step, round(avg(abs(d)), 6) AS line_length, coalesce(bool_and(d > 0 AND abs(d - 1) <= 1e-12), false) AS continuous FROM a GROUP BY user_id""")
def step_facts(spark, sf_dir):
    return _rounded(segments.step_facts(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 1.0))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS samples, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS minimum,
    round(quantile_cont(l_extendedprice, 0.001), 6) AS q001, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.999), 6) AS q999, max(l_extendedprice) AS maximum,
    round(max(l_extendedprice) - min(l_extendedprice), 6) AS peak_to_peak, count(*) FILTER (abs(l_extendedprice) >= 50000) AS rail_samples, round(100.0 * count(*) FILTER (abs(l_extendedprice) >= 50000) / count(*), 6) AS rail_percent,
    bool_and(isfinite(l_extendedprice)) AS all_finite FROM lineitem GROUP BY ALL""")
def channel_quality(spark, sf_dir):
    out = stats.signal_quality(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 50_000)
    return _rounded(out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4)))


THRESHOLD_SQL = """m AS (SELECT event_type, median(value) AS median FROM events GROUP BY ALL),
    t AS (SELECT event_type, m.median, 1.4826 * median(abs(value - m.median)) AS scaled_mad FROM events JOIN m USING (event_type) GROUP BY ALL),
    h AS (SELECT *, median + 3 * CASE WHEN scaled_mad <= 1e-12 THEN greatest(0.05 * abs(median), 1e-9) ELSE scaled_mad END AS threshold FROM t)"""


@query(f"WITH {THRESHOLD_SQL} SELECT event_type, round(median, 6) AS median, round(scaled_mad, 6) AS scaled_mad, round(threshold, 6) AS threshold FROM h")
def robust_threshold(spark, sf_dir):
    return _rounded(stats.robust_thresholds(_t(spark, sf_dir, "events"), ["event_type"], "value", multiple=3.0))


@query(f"""WITH {THRESHOLD_SQL}, f AS (SELECT user_id, bool_or(e.event_id % 3 <> 0 AND value > threshold) AS residual_artifact FROM events e JOIN h USING (event_type) GROUP BY user_id)
    SELECT residual_artifact, count(*) AS trials FROM f GROUP BY ALL""")
def artifact_flags(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    limits = stats.robust_thresholds(rows, ["event_type"], "value", multiple=3.0)
    flags = stats.over_threshold(rows, limits, ["event_type"], ["user_id"], "value", F.col("event_id") % 3 != 0)
    return flags.groupBy("residual_artifact").agg(F.count("*").alias("trials"))


@query("""SELECT strategy, count(*) AS trials FROM (SELECT unnest(list_filter([CASE WHEN toxic = 0 AND quality = 1 THEN 'strict_rejection' END, CASE WHEN toxic = 0 THEN 'retain_repaired_saturation' END, CASE WHEN quality = 1 THEN 'all_in_bounds' END], lambda x: x IS NOT NULL)) AS strategy
    FROM (SELECT quality, CASE WHEN quality = 1 THEN toxic ELSE 1 END AS toxic FROM labels)) GROUP BY ALL""")
def rejection_strategies(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("edge"), (F.col("toxic") == 1).alias("residual"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"))
    return stats.with_strategies(rows, "edge", "residual", "accepted").groupBy("strategy").agg(F.count("*").alias("trials"))


@query("""WITH a AS (SELECT user_id, event_id, value, event_type <> 'error' AND event_id % 4 <> 0 AS good FROM events),
    b AS (SELECT *, last_value(CASE WHEN good THEN event_id END IGNORE NULLS) OVER p AS px, last_value(CASE WHEN good THEN value END IGNORE NULLS) OVER p AS py,
        first_value(CASE WHEN good THEN event_id END IGNORE NULLS) OVER n AS nx, first_value(CASE WHEN good THEN value END IGNORE NULLS) OVER n AS ny FROM a
        WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, event_id, round(CASE WHEN good THEN value WHEN px IS NULL THEN ny WHEN nx IS NULL THEN py ELSE py + (ny - py) * (event_id - px) / (nx - px) END, 9) AS filled FROM b""")
def gap_interpolate(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    bad = ~((F.col("event_type") != "error") & (F.col("event_id") % 4 != 0))
    return segments.fill_gaps(rows, ["user_id"], "event_id", "value", bad, 0).select("user_id", "event_id", neat(F.col("filled"), 9).alias("filled"))


@query(f"WITH {POINTS_SQL} SELECT vec_id, i, round(v - avg(v) FILTER (i >= 4 AND i < 16) OVER (PARTITION BY vec_id), 6) + 0.0 AS corrected FROM pts")
def baseline_correct(spark, sf_dir):
    base = in_window(F.col("i"), Window("baseline", 4, 16, half_open=True))
    return _rounded(segments.subtract_baseline(_points(spark, sf_dir), ["vec_id"], "v", base).select("vec_id", "i", "corrected"))


@query("""WITH r AS (SELECT user_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS idx FROM events), c AS (SELECT user_id, idx AS mark FROM r WHERE event_type = 'click')
    SELECT c.user_id, mark, (r.idx - mark + 3)::INT AS t_idx, value FROM c JOIN r ON r.user_id = c.user_id AND r.idx >= mark - 3 AND r.idx < mark + 5""")
def epoch_slice(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("idx"))
    marks = rows.where("event_type = 'click'").select("user_id", F.col("idx").alias("mark"))
    return segments.slices(marks, rows.select("user_id", "idx", "value"), ["user_id"], "mark", "idx", -3, 5).select("user_id", "mark", "t_idx", "value")


@query(f"""WITH {POINTS_SQL}, w AS (SELECT 'early' AS "window", 10 AS lo, 25 AS hi UNION ALL SELECT 'late', 30, 60),
    a AS (SELECT vec_id, "window", i, v, v - lag(v) OVER o AS d, (v + lag(v) OVER o) / 2 * (i - lag(i) OVER o) AS s FROM pts JOIN w ON i BETWEEN lo AND hi WINDOW o AS (PARTITION BY vec_id, "window" ORDER BY i))
    SELECT vec_id, "window", count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS peak_to_peak, round(sum(s), 6) + 0.0 AS area, round(max(v), 6) + 0.0 AS positive_peak,
    first(i ORDER BY v DESC, i) AS positive_peak_latency_s, round(min(v), 6) + 0.0 AS negative_peak, first(i ORDER BY v, i) AS negative_peak_latency_s, round(covar_pop(v, i) / var_pop(i), 6) + 0.0 AS slope_per_s, round(avg(abs(d)) * 64, 6) AS line_length_per_s FROM a GROUP BY ALL""")
def window_features(spark, sf_dir):
    return _rounded(stats.window_statistics(_points(spark, sf_dir), ["vec_id"], "i", "v", WINDOWS, 64.0))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_left, count(*) FILTER (l_linestatus = 'O') AS n_right, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS mean_left, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS mean_right,
    round(avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F'), 6) + 0.0 AS difference,
    round((1 - 3.0::DOUBLE / (4 * count(*) - 9)) * (avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F')) / sqrt(((count(*) FILTER (l_linestatus = 'F') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'F') + (count(*) FILTER (l_linestatus = 'O') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'O')) / (count(*) - 2)), 6) + 0.0 AS hedges_g
    FROM lineitem GROUP BY ALL""")
def hedges_g(spark, sf_dir):
    return _rounded(effects.hedges_g(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "O"))


def _p_values(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n"))
    return rows.select("p_brand", "p_type", ((F.col("n") % 7 + 1) / F.lit(200.0) + (F.floor(F.col("m")) % 97) / F.lit(300.0)).alias("p"))


FDR_SQL = """r AS (SELECT p_brand, p_type, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT p_brand, p_type, (n % 7 + 1) / 200.0::DOUBLE + (floor(m)::BIGINT % 97) / 300.0::DOUBLE AS p FROM r)"""


@query(f"""WITH {FDR_SQL}, q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_brand, p_type) AS q FROM p), b AS (SELECT *, least(1.0, min(q) OVER (ORDER BY p, p_brand, p_type ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM q)
    SELECT p_brand, p_type, round(p, 6) AS p, round(f, 6) AS p_fdr_bh, f < 0.05 AS significant FROM b""")
def fdr_bh(spark, sf_dir):
    return _rounded(effects.benjamini_hochberg(_p_values(spark, sf_dir), [], "p", ["p_brand", "p_type"]))


@query(f"""WITH {FDR_SQL}, q AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, p_type) AS q FROM p), b AS (SELECT *, least(1.0, min(q) OVER (PARTITION BY p_brand ORDER BY p, p_type ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM q)
    SELECT p_brand, p_type, round(p, 6) AS p, round(f, 6) AS p_fdr_bh, f < 0.05 AS significant FROM b""")
def fdr_by_family(spark, sf_dir):
    return _rounded(effects.benjamini_hochberg(_p_values(spark, sf_dir), ["p_brand"], "p", ["p_type"]))


G_SQL = """k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS r FROM (SELECT DISTINCT p_brand FROM part)), d AS (SELECT p_type, (r // 2)::INT AS pair, r % 2 AS side, avg(p_retailprice) - 1200 AS g FROM part JOIN k USING (p_brand) GROUP BY ALL),
    e AS (SELECT p_type, pair, max(g) FILTER (side = 0) AS ga, max(g) FILTER (side = 1) AS gb FROM d GROUP BY ALL)"""


def _brand_effects(spark, sf_dir) -> DataFrame:
    """Effects of all brands, two neighbours in name being a pair's subjects."""
    from pyspark.sql import Window as W

    part = _t(spark, sf_dir, "part")
    place = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("p_brand")) - 1
    brands = part.select("p_brand").distinct().select("p_brand", F.floor(place / 2).cast("int").alias("pair"), F.when(place % 2 == 0, "A").otherwise("B").alias("subject"))
    return part.join(brands, "p_brand").groupBy("p_type", "pair", "subject").agg((F.avg("p_retailprice") - 1200).alias("g"))


@query(f"WITH {G_SQL} SELECT p_type, pair, round(ga, 4) + 0.0 AS g_a, round(gb, 4) + 0.0 AS g_b, sign(ga) = sign(gb) AS same_direction, round((ga + gb) / 2, 4) + 0.0 AS mean_g FROM e")
def subject_consistency(spark, sf_dir):
    out = effects.subject_consistency(_brand_effects(spark, sf_dir), ["p_type", "pair"], "subject", ("A", "B"), "g")
    return out.select("p_type", "pair", *[neat(F.col(c), 4).alias(c) for c in ("g_a", "g_b", "mean_g")], "same_direction")


STABLE_SQL = f"""{G_SQL}, t AS (SELECT p_type, pair, ga, gb, sign(ga) = sign(gb) AND ga <> 0 AND gb <> 0 AS sign_consistent, (abs(ga) + abs(gb)) / 2 AS m, CASE WHEN sign(ga) = sign(gb) AND ga <> 0 AND gb <> 0 THEN least(abs(ga), abs(gb)) ELSE 0 END AS c FROM e)"""


@query(f"""WITH {STABLE_SQL} SELECT p_type, pair, round(ga, 4) + 0.0 AS g_a, round(gb, 4) + 0.0 AS g_b, sign_consistent, round(m, 4) AS mean_abs_g, round(c, 4) AS conservative_abs_g FROM t""")
def stable_effects(spark, sf_dir):
    out = effects.stable_effects(_brand_effects(spark, sf_dir), ["p_type", "pair"], "subject", ("A", "B"), "g")
    return out.select("p_type", "pair", *[neat(F.col(c), 4).alias(c) for c in ("g_a", "g_b", "mean_abs_g", "conservative_abs_g")], "sign_consistent")


@query(f"""WITH {STABLE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(c, 6) DESC, round(m, 6) DESC, p_type) AS place FROM t WHERE sign_consistent) SELECT DISTINCT p_type AS feature FROM r WHERE place <= 6""")
def shown_features(spark, sf_dir):
    from .plans.features import shown_features as run

    stable = effects.stable_effects(_brand_effects(spark, sf_dir), ["p_type", "pair"], "subject", ("A", "B"), "g")
    stable = stable.withColumns({c: F.round(c, 6) for c in ("conservative_abs_g", "mean_abs_g")})
    return run(stable.withColumnsRenamed({"p_type": "feature", "pair": "task"}))


@query("""SELECT feature FROM (SELECT p_type AS feature, max(p_retailprice) AS g FROM part GROUP BY ALL ORDER BY g DESC, feature LIMIT 10)""")
def shown_features_fallback(spark, sf_dir):
    from .plans.features import shown_features as run

    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("feature"), F.col("p_brand").alias("task"), F.lit(False).alias("sign_consistent"), F.lit(0.0).alias("conservative_abs_g"), F.col("p_retailprice").alias("mean_abs_g"))
    return run(rows)


CURVES_SQL = f"{POINTS_SQL}, cv AS (SELECT label, i, avg(v) AS v FROM pts GROUP BY ALL)"


@query(f"""WITH {CURVES_SQL}, j AS (SELECT a.label, a.i, a.v AS o, b.v AS p FROM cv a JOIN cv b ON a.i = b.i AND b.label = 0 AND a.label > 0)
    SELECT label, round(corr(p, o), 6) + 0.0 AS curve_correlation, round(sqrt(avg((o - p) ** 2)), 6) AS rmse, round(max(abs(o - p)), 6) AS maximum_absolute_change, round(sqrt(avg((o - p) ** 2)) / greatest(max(p) - min(p), 1e-9), 6) AS nrmse FROM j GROUP BY label""")
def curve_compare(spark, sf_dir):
    curves = _points(spark, sf_dir).groupBy("label", "i").agg(F.avg("v").alias("v"))
    pairs = curves.where("label > 0").select("label", "i", F.col("v").alias("o")).join(curves.where("label = 0").select("i", F.col("v").alias("p")), "i")
    return _rounded(stats.compare_curves(pairs, ["label"], "p", "o"))


@query(f"""WITH {CURVES_SQL}, j AS (SELECT a.label, a.v AS o, b.v AS p, a.v > 0.02 AS fo, b.v > 0.02 AS fp FROM cv a JOIN cv b ON a.i = b.i AND b.label = 0 AND a.label > 0)
    SELECT label, round(corr(p, o), 6) + 0.0 AS effect_size_correlation, round(avg((sign(p) = sign(o))::INT), 6) AS effect_sign_agreement, round(max(abs(o - p)), 6) AS maximum_absolute_change, bool_and(fp = fo) AS same_decisions FROM j GROUP BY label""")
def effect_agreement(spark, sf_dir):
    curves = _points(spark, sf_dir).groupBy("label", "i").agg(F.avg("v").alias("v"))
    pairs = curves.where("label > 0").select("label", "i", F.col("v").alias("o")).join(curves.where("label = 0").select("i", F.col("v").alias("p")), "i")
    pairs = pairs.withColumn("fo", F.col("o") > 0.02).withColumn("fp", F.col("p") > 0.02)
    return _rounded(effects.effect_agreement(pairs, ["label"], "p", "o", "fp", "fo"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT vec_id, i, v * v AS p FROM pts), a AS (SELECT vec_id, (p + lag(p) OVER w) / 2 * (i - lag(i) OVER w) AS x FROM s WHERE i >= 8 AND i < 13 WINDOW w AS (PARTITION BY vec_id ORDER BY i))
    SELECT vec_id, round(sum(x), 6) AS band_power FROM a GROUP BY ALL""")
def trapezoid_band(spark, sf_dir):
    rows = _points(spark, sf_dir).select("vec_id", "i", (F.col("v") * F.col("v")).alias("p"))
    return _rounded(stats.band_power(rows, ["vec_id"], 8, 13, True, 0.0, "i", "p"))


@query(f"WITH {POINTS_SQL} SELECT vec_id, first(i ORDER BY v DESC, i) AS dominant_frequency FROM pts WHERE i BETWEEN 20 AND 50 GROUP BY vec_id")
def dominant_bin(spark, sf_dir):
    return stats.dominant(_points(spark, sf_dir), ["vec_id"], 20, 50, "i", "v")


@query(f"""WITH {POINTS_SQL} SELECT a.vec_id, a.i, round(b.v - a.v, 6) + 0.0 AS v FROM pts a JOIN pts b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0""")
def laterality(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") - F.col("vec_id") % 2).alias("vec_id"), (F.col("vec_id") % 2).alias("c"), F.col("embedding").cast("array<double>").alias("values"))
    return _rounded(signal.channel_difference(rows, ["vec_id"], "c", 1, 0).select("vec_id", F.posexplode("values").alias("i", "v")))


@query("""SELECT tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
    round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc
    FROM (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)""")
def confusion_metrics(spark, sf_dir):
    return _rounded(evaluate.confusion_metrics(_t(spark, sf_dir, "labels"), [], "quality", "toxic"))


@query("""WITH s AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM s)
    SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1)::DOUBLE * count(*) FILTER (quality = 0)), 6)::DOUBLE AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return _rounded(evaluate.roc_auc(rows, [], "quality", "n_chars"))


@query("""SELECT coalesce(o_orderpriority, 'Pooled') AS scope, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def scope_rollup(spark, sf_dir):
    rows = stats.scoped(_t(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority")
    return rows.groupBy("scope").agg(F.count("*").alias("n"), neat(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F') WHERE place <= 5")
def topk_per_group(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.top_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("SELECT p_brand, p_type, n, best FROM (SELECT p_brand, p_type, count(*) AS n, max(p_retailprice) AS best FROM part GROUP BY ALL) ORDER BY best DESC, n DESC, p_brand, p_type LIMIT 1")
def best_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("best"))
    return relational.best(rows, [F.desc("best"), F.desc("n"), F.asc("p_brand"), F.asc("p_type")])


@query("SELECT count(DISTINCT (user_id, event_type)) AS distinct_keys, min(n) AS smallest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def distinct_keys(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_keys"), F.min("n").alias("smallest"))


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return relational.first_seen(_t(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("""SELECT 'only_customer' AS part, n FROM (SELECT DISTINCT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only_supplier', n FROM (SELECT DISTINCT s_nationkey AS n FROM supplier EXCEPT SELECT c_nationkey FROM customer)
    UNION ALL SELECT 'either', n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    named = lambda df, x: df.select(F.lit(x).alias("part"), "n")
    return named(relational.difference(c, s), "only_customer").unionByName(named(relational.difference(s, c), "only_supplier")).unionByName(named(c.union(s).distinct(), "either"))


@query(f"""WITH {POINTS_SQL}, m AS (SELECT i, count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb, avg(v) FILTER (label = 0) AS ma, avg(v) FILTER (label = 1) AS mb, var_pop(v) FILTER (label = 0) AS va, var_pop(v) FILTER (label = 1) AS vb, avg(v) AS m FROM pts WHERE label IN (0, 1) GROUP BY i)
    SELECT 'e' || i AS feature, round((na * (ma - m) ** 2 + nb * (mb - m) ** 2) / (na * va + nb * vb) * (na + nb - 2), 6) AS f_score FROM m""")
def feature_selection_f(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").where("label in (0, 1)").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    long = relational.to_long(rows, ["vec_id", "label"], [f"e{i}" for i in range(64)])
    return _rounded(model.anova_scores(long, ["feature"], "label"))


@query(f"""WITH {POINTS_SQL}, c AS (SELECT vec_id - vec_id % 2 AS k, vec_id % 2 AS s, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM pts), b AS (SELECT x.k, x.i, x.v AS x, y.v AS y FROM c x JOIN c y ON x.k = y.k AND x.i = y.i AND x.s = 0 AND y.s = 1),
    d AS (SELECT k, sqrt(sum(x * x) * sum(y * y)) AS base FROM b GROUP BY k), l AS (SELECT unnest(range(-8, 9))::INT AS lag),
    r AS (SELECT p.k, lag, sum(q.x * p.y) / base AS r FROM b p CROSS JOIN l JOIN b q ON q.k = p.k AND q.i = p.i + lag JOIN d ON d.k = p.k GROUP BY p.k, lag, base)
    SELECT k AS vec_id, round(first(r ORDER BY round(abs(r), 12) DESC, lag), 6) + 0.0 AS max_abs_correlation, first(lag ORDER BY round(abs(r), 12) DESC, lag) AS lag FROM r GROUP BY k""")
def cross_correlation(spark, sf_dir):
    rows = _points(spark, sf_dir).select((F.col("vec_id") - F.col("vec_id") % 2).alias("vec_id"), (F.col("vec_id") % 2).alias("s"), "i", "v")
    both = rows.groupBy("vec_id", "i").agg(F.max(F.when(F.col("s") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("s") == 1, F.col("v"))).alias("y")).where("x is not null and y is not null")
    return _rounded(stats.lag_correlation(both, ["vec_id"], "i", "x", "y", 8))


def _huber_sql(rounds: int) -> str:
    sql = """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL), s0 AS (SELECT event_type, m.m AS m, 1.4826 * median(abs(value - m.m)) AS s FROM events JOIN m USING (event_type) GROUP BY ALL)"""
    for k in range(rounds):
        sql += f", s{k + 1} AS (SELECT event_type, sum(w * value) / sum(w) AS m, s FROM (SELECT event_type, value, s, CASE WHEN abs(value - m) <= 1.345 * s THEN 1 ELSE 1.345 * s / abs(value - m) END AS w FROM events JOIN s{k} USING (event_type)) GROUP BY event_type, s)"
    return sql + f" SELECT event_type, round(m, 6) AS huber_mean FROM s{rounds}"


@query(_huber_sql(8))
def huber_fixed_rounds(spark, sf_dir):
    return _rounded(stats.huber_means(_t(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value"))


def _savgol_sql() -> str:
    from .functions import kernels

    matrix = kernels.savgol_matrix(64, 9, 3)
    rows = ", ".join(f"({i}, {j}, {w:.17g}::DOUBLE)" for i, r in enumerate(matrix) for j, w in enumerate(r) if w)
    return f"WITH {POINTS_SQL}, k(i, j, w) AS (VALUES {rows}) SELECT vec_id, k.i::INT AS i, round(sum(w * v), 6) + 0.0 AS v FROM pts JOIN k ON pts.i = k.j GROUP BY ALL"


@query(_savgol_sql())
def savgol_smooth(spark, sf_dir):
    cfg = Settings(sample_rate=64.0, epoch_s=(0.0, 1.0), smooth_s=9 / 64)
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", signal.smooth(F.col("embedding").cast("array<double>"), 64, cfg).alias("s"))
    return _rounded(rows.select("vec_id", F.posexplode("s").alias("i", "v")))


@query("SELECT l_returnflag, l_shipdate::DATE AS day, count(*) FILTER (l_extendedprice >= 50000) AS rail_samples FROM lineitem WHERE l_quantity > 10 AND l_quantity < 40 GROUP BY ALL")
def rail_mask_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").where(strictly_between(F.col("l_quantity"), F.lit(10), F.lit(40)))
    return rows.groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("day")).agg(F.count_if(at_rail(F.col("l_extendedprice"), 50_000)).alias("rail_samples"))


@query("""SELECT user_id, window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS samples, round(avg(value), 6) AS mean, min(value) AS minimum, max(value) AS maximum, count(*) FILTER (abs(value) >= 90) AS rail_samples, bool_and(isfinite(value)) AS all_finite
    FROM (SELECT *, date_trunc('day', ts) AS window_start FROM events) GROUP BY ALL""")
def windowed_quality(spark, sf_dir):
    from .streaming.quality import windowed_quality as run

    out = run(_t(spark, sf_dir, "events"), ["user_id"], "ts", "value", 90, "1 day")
    return _rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


def _epochs(spark, sf_dir) -> DataFrame:
    """Embeddings as epochs: three neighbours are a trial's channels. There are
    as many recordings as keep about 200 trials each."""
    rows = _t(spark, sf_dir, "embeddings")
    sessions = F.broadcast(rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 600)).alias("sessions")))
    channel = F.element_at(F.array(*map(F.lit, POINTS.channels)), (F.col("vec_id") % 3 + 1).cast("int"))
    trial = F.floor(F.col("vec_id") / 3).cast("int")
    rows = rows.crossJoin(sessions).select(F.concat_ws("_", F.when(trial % 2 == 0, "A").otherwise("B"), F.lit("Task-1"), F.floor(trial / 4) % F.col("sessions")).alias("file_name"), trial.alias("trial_id"), channel.alias("channel"), F.col("embedding").cast("array<double>").alias("values"))
    return rows.withColumn("subject", F.substring("file_name", 1, 1)).withColumn("task", F.lit("Task-1")).withColumn("cue_direction", F.when(F.floor(F.col("trial_id") / 2) % 2 == 0, "L").otherwise("R"))


EPOCHS_SQL = """n AS (SELECT greatest(1, count(*) // 600) AS sessions FROM embeddings),
    ep AS (SELECT CASE WHEN (vec_id // 3) % 2 = 0 THEN 'A' ELSE 'B' END || '_Task-1_' || ((vec_id // 12) % sessions) AS file_name, vec_id // 3 AS trial_id, ['Fz', 'F3', 'F4'][vec_id % 3 + 1] AS channel, CASE WHEN (vec_id // 6) % 2 = 0 THEN 'L' ELSE 'R' END AS cue_direction,
        (unnest(range(1, len(embedding) + 1)) - 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings, n)"""


@query()
def fitted_curves(spark, sf_dir):
    return signal.fitted_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"], POINTS.channels, POINTS, POINTS.n_curve_bootstraps).select("file_name", "cue_direction", "channel", F.posexplode(F.arrays_zip("values", "ci_low", "ci_high")).alias("i", "z")).select("file_name", "cue_direction", "channel", "i", "z.*")


def _curves_sql(rounds: int) -> str:
    """The fitted curves by their definition: whole trials, scales fixed at the
    start and borrowed where there is none, reweighting, smoothing."""
    from .functions import kernels

    matrix = kernels.savgol_matrix(64, kernels.smoothing_length(POINTS.smooth_s, POINTS.sample_rate, 64, POINTS.smooth_order), POINTS.smooth_order)
    weights = ", ".join(f"({i}, {j}, {w:.17g}::DOUBLE)" for i, r in enumerate(matrix) for j, w in enumerate(r) if w)
    key, cell = "file_name, cue_direction", "file_name, cue_direction, channel, i"
    sql = f"""WITH {EPOCHS_SQL}, whole AS (SELECT file_name, trial_id FROM ep GROUP BY ALL HAVING count(DISTINCT channel) = 3), e AS (SELECT ep.* FROM ep JOIN whole USING (file_name, trial_id)),
        m AS (SELECT {cell}, median(v) AS m FROM e GROUP BY ALL), r AS (SELECT {cell}, m.m AS m, 1.4826 * median(abs(v - m.m)) AS s FROM e JOIN m USING ({cell}) GROUP BY ALL),
        b AS (SELECT {key}, coalesce(median(s) FILTER (s > 1e-10), 1) AS s FROM r GROUP BY ALL), s0 AS (SELECT r.* REPLACE (CASE WHEN r.s > 1e-10 THEN r.s ELSE b.s END AS s) FROM r JOIN b USING ({key}))"""
    for k in range(rounds):
        sql += f", s{k + 1} AS (SELECT {cell}, sum(w * v) / sum(w) AS m, s FROM (SELECT e.*, s, CASE WHEN abs(v - m) <= {POINTS.huber_c} * s THEN 1 ELSE {POINTS.huber_c} * s / abs(v - m) END AS w FROM e JOIN s{k} USING ({cell})) GROUP BY {cell}, s)"
    return sql + f", k(i, j, w) AS (VALUES {weights}) SELECT {key}, channel, k.i::INT AS i, round(sum(w * m), 6) + 0.0 AS v FROM s{rounds} c JOIN k ON c.i = k.j GROUP BY {key}, channel, k.i"


@query(_curves_sql(6))
def curves_of_fixed_rounds(spark, sf_dir):
    cfg = replace(POINTS, huber_iterations=6, huber_tolerance=0.0)
    curves = signal.fitted_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"], cfg.channels, cfg)
    return _rounded(curves.select("file_name", "cue_direction", "channel", F.posexplode("values").alias("i", "v")))


@query(_curves_sql(6))
def located_curves_of_fixed_rounds(spark, sf_dir):
    cfg = replace(POINTS, huber_iterations=6, huber_tolerance=0.0)
    curves = signal.located_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"], cfg.channels, cfg)
    return _rounded(curves.select("file_name", "cue_direction", "channel", F.posexplode("values").alias("i", "v")))


@query()
def curve_differences(spark, sf_dir):
    curves = signal.fitted_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"], POINTS.channels, POINTS, POINTS.n_curve_bootstraps, (("F4_minus_F3", "F4", "F3"),), True)
    out = signal.curve_differences(curves, ["file_name", "channel"], "cue_direction", "R", "L")
    return out.select("file_name", "channel", F.posexplode(F.arrays_zip("values", "ci_low", "ci_high")).alias("i", "z")).select("file_name", "channel", "i", "z.*")


@query(f"WITH {EPOCHS_SQL} SELECT file_name, cue_direction, channel, i, count(*) AS n_trials, round(median(v), 6) + 0.0 AS v FROM ep GROUP BY ALL")
def median_curves(spark, sf_dir):
    curves = signal.median_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"])
    return _rounded(curves.select("file_name", "cue_direction", "channel", "n_trials", F.posexplode("values").alias("i", "v")))


@query(f"WITH {POINTS_SQL} SELECT label, i AS frequency, round(median(v), 6) + 0.0 AS power FROM pts GROUP BY ALL")
def median_spectrum(spark, sf_dir):
    rows = _points(spark, sf_dir).select("label", F.col("i").alias("frequency"), F.col("v").alias("power"))
    return _rounded(signal.median_spectrum(rows, ["label"]))


@query("""SELECT 'orders_are_unique' AS "check", (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS passed UNION ALL SELECT 'nations_are_the_same', (SELECT count(*) = 0 FROM (SELECT * FROM ((SELECT DISTINCT c_nationkey FROM customer) EXCEPT (SELECT s_nationkey FROM supplier)) UNION ALL SELECT * FROM ((SELECT DISTINCT s_nationkey FROM supplier) EXCEPT (SELECT c_nationkey FROM customer))))
    UNION ALL SELECT 'values_are_finite', (SELECT bool_and(isfinite(value)) FROM events) UNION ALL SELECT 'every_user_errs', (SELECT bool_and(e) FROM (SELECT bool_or(event_type = 'error') AS e FROM events GROUP BY user_id)) UNION ALL SELECT 'of_nothing', false""")
def acceptance_checks(spark, sf_dir):
    from .functions.columns import is_finite
    from .sources.tables import checks

    events, orders = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "orders")
    nations = [_t(spark, sf_dir, t).select(F.col(c).alias("n")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return checks(
        orders_are_unique=orders.groupBy("o_orderkey").agg(F.count("*").alias("n")).agg(F.max("n") == 1),
        nations_are_the_same=relational.same_sets(*nations),
        values_are_finite=events.agg(F.bool_and(is_finite(F.col("value")))),
        every_user_errs=events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("e")).agg(F.bool_and("e")),
        of_nothing=events.where("false").agg(F.bool_and(F.col("value") > 0)),
    )


@query("SELECT user_id, event_id, value, event_type FROM events")
def positional_merge(spark, sf_dir):
    from .sources.tables import merged_by_place

    rows = _t(spark, sf_dir, "events")
    return merged_by_place(rows.select("event_id", "user_id", "value"), rows.select("event_id", "event_type"), ["event_id"]).select("user_id", "event_id", "value", "event_type")


@query()
def resampled_tests(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select((F.col("user_id") % 20).alias("test"), "value", F.when(F.col("event_type") == "click", "L").otherwise("R").alias("side"))
    return effects.resampled_tests(rows, ["test"], "value", "side", POINTS.n_permutations, POINTS.n_difference_bootstraps, POINTS.seed)


@query()
def bandpass_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("i"), "value")
    return signal.bandpass(rows, ["channel"], "i", "value")


def _welch_sql(n: int, step: int, rate: float) -> str:
    """Segments without their line and under a Hann window, by the definition of
    the discrete Fourier transform."""
    return f"""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
        k AS (SELECT user_id, value, i, unnest(range(greatest(0, (i - {n}) // {step} + CASE WHEN i < {n} THEN 0 ELSE 1 END), i // {step} + 1)) AS piece FROM s),
        w AS (SELECT user_id, piece, i - piece * {step} AS t, value FROM k WHERE i - piece * {step} < {n}),
        l AS (SELECT user_id, piece, avg(value) AS m, sum((t - {(n - 1) / 2}::DOUBLE) * value) / sum((t - {(n - 1) / 2}::DOUBLE) ** 2) AS slope FROM w GROUP BY ALL HAVING count(*) = {n}),
        x AS (SELECT user_id, piece, t, (value - m - slope * (t - {(n - 1) / 2}::DOUBLE)) * (0.5 - 0.5 * cos(2 * pi() * t / {n})) AS x FROM w JOIN l USING (user_id, piece)),
        f AS (SELECT unnest(range(0, {n // 2 + 1})) AS f),
        d AS (SELECT user_id, piece, f, sum(x * cos(2 * pi() * f * t / {n})) AS re, sum(x * sin(2 * pi() * f * t / {n})) AS im FROM x, f GROUP BY ALL),
        h AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * t / {n})) ** 2) AS h FROM (SELECT unnest(range(0, {n})) AS t))
        SELECT user_id AS channel, f * {rate}::DOUBLE / {n} AS frequency, round(avg((re * re + im * im) / ({rate}::DOUBLE * h) * CASE WHEN f IN (0, {n // 2}) THEN 1 ELSE 2 END), 6) + 0.0 AS power FROM d, h GROUP BY user_id, f"""


@query(_welch_sql(32, 16, 256.0))
def welch_spectra(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "event_id", "value")
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("channel").orderBy("event_id")) - 1)
    return _rounded(signal.spectra(rows, ["channel"], "i", "value", 256.0, 32, 16))


@query()
def stratified_inference(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select((F.col("doc_id") % 2).alias("stratum"), F.lit("all").alias("scope"), F.col("quality").alias("truth"), F.col("toxic").alias("guess"))
    return evaluate.stratified_inference(rows, ["scope"], "stratum", "truth", "guess", POINTS.n_model_permutations, POINTS.n_model_bootstraps, POINTS.seed)


@query("""WITH RECURSIVE r AS (SELECT vec_id % 3 AS g, embedding[1]::DOUBLE AS x, label AS y FROM embeddings WHERE label IN (0, 1)),
    d AS (SELECT g, x, 2 * y - 1 AS s, count(*) OVER (PARTITION BY g) / (2.0 * count(*) OVER (PARTITION BY g, y)) AS c FROM r),
    w AS (SELECT DISTINCT g, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM d
        UNION ALL SELECT g, k + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
        FROM (SELECT g, k, a, b, a - sum(c * s * p * x) AS g1, b - sum(c * s * p) AS g2, 1 + sum(c * p * (1 - p) * x * x) AS h11, sum(c * p * (1 - p) * x) AS h12, 1 + sum(c * p * (1 - p)) AS h22
            FROM (SELECT w.g, k, a, b, x, s, c, 1 / (1 + exp(s * (a * x + b))) AS p FROM w JOIN d USING (g) WHERE k < 12) GROUP BY g, k, a, b))
    SELECT g::INT AS g, round(a, 6) + 0.0 AS weight, round(b, 6) + 0.0 AS intercept FROM w WHERE k = 12""")
def logistic_weights(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").where("label in (0, 1)").select((F.col("vec_id") % 3).cast("int").alias("g"), F.array(F.col("embedding")[0].cast("double")).alias("x"), "label")
    found = model.logistic_weights(rows, ["g"], "x", "label", (1.0,))
    return _rounded(spark.createDataFrame([(g, float(w[0]), float(w[1])) for (g, _), w in found.items()], "g int, weight double, intercept double"))


@query()
def cross_subject_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").where("label in (0, 1)").select(F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("subject"), F.lit("Task-1").alias("task"), F.lit("e").alias("file_name"), F.col("vec_id").cast("int").alias("trial_id"), F.col("label").alias("target_R"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    names = [f"e{i}" for i in range(64)]
    return model.cross_subject(rows, {"all": names, "half": names[:32]})


@query(f"""WITH {EPOCHS_SQL}, w AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY file_name, trial_id, channel ORDER BY i)) AS d FROM ep WHERE i / 64.0 <= 0.8)
    SELECT file_name, trial_id::INT AS trial_id, channel, round(max(v) - min(v), 6) AS peak_to_peak, round(max(abs(v)), 6) AS maximum_absolute, round(max(d), 6) AS maximum_step FROM w GROUP BY ALL""")
def epoch_metrics(spark, sf_dir):
    from .plans.preprocess import epoch_metrics as run

    return _rounded(run(_epochs(spark, sf_dir), POINTS))


@query("""WITH q AS (SELECT 'f' || (doc_id % 4) AS file_name, CASE WHEN doc_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, quality = 0 AS edge, toxic = 1 AS bad, quality = 1 AND toxic = 0 AND doc_id % 10 = 3 AS residual FROM labels), a AS (SELECT *, NOT (edge OR bad OR residual) AS ok FROM q)
    SELECT file_name, count(*) AS total_trials, count(*) FILTER (edge) AS rejected_edge, count(*) FILTER (bad AND NOT edge) AS rejected_saturation_or_nonfinite, count(*) FILTER (residual) AS rejected_residual_artifact, count(*) FILTER (ok) AS accepted_trials,
        count(*) FILTER (side = 'L') AS total_L, count(*) FILTER (side = 'R') AS total_R, count(*) FILTER (ok AND side = 'L') AS accepted_L, count(*) FILTER (ok AND side = 'R') AS accepted_R FROM a GROUP BY ALL""")
def retention(spark, sf_dir):
    from .plans.preprocess import retention as run

    edge, bad = F.col("quality") == 0, F.col("toxic") == 1
    residual = ~edge & ~bad & (F.col("doc_id") % 10 == 3)
    rows = _t(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id") % 4).alias("file_name"), F.lit("A").alias("subject"), F.lit("Task-1").alias("task"), F.when(F.col("doc_id") % 2 == 0, "L").otherwise("R").alias("cue_direction"), edge.alias("edge_flag"), bad.alias("raw_saturation_or_nonfinite_flag"), residual.alias("residual_artifact_flag"), (~edge & ~bad & ~residual).alias("accepted_for_erp"))
    return run(rows).drop("subject", "task")


WINDOWS_SQL = "w AS (SELECT 'early_250_500ms' AS \"window\", 0.25 AS lo, 0.5 AS hi UNION ALL SELECT 'late_550_900ms', 0.55, 0.9 UNION ALL SELECT 'full_200_900ms', 0.2, 0.9)"


@query(f"""WITH {EPOCHS_SQL}, {WINDOWS_SQL}, m AS (SELECT file_name, trial_id, channel, "window", avg(v) AS v FROM ep JOIN w ON i / 64.0 BETWEEN lo AND hi WHERE "window" NOT LIKE 'full%' GROUP BY ALL)
    SELECT file_name, trial_id::INT AS trial_id, channel, "window", round(v, 6) + 0.0 AS v FROM m
    UNION ALL SELECT file_name, trial_id::INT, 'F4_minus_F3', "window", round(max(v) FILTER (channel = 'F4') - max(v) FILTER (channel = 'F3'), 6) + 0.0 FROM m GROUP BY ALL""")
def trial_means(spark, sf_dir):
    from .plans.curves import trial_means as run

    return _rounded(run(_epochs(spark, sf_dir), POINTS).select("file_name", "trial_id", "channel", "window", "v"))


@query(f"""WITH {EPOCHS_SQL}, {WINDOWS_SQL}, c AS (SELECT file_name, cue_direction, channel, i, median(v) AS v FROM ep GROUP BY ALL),
    a AS (SELECT file_name, cue_direction, channel, "window", i / 64.0::DOUBLE AS t, v, (v + lag(v) OVER o) / 2 / 64 AS s FROM c JOIN w ON i / 64.0 BETWEEN lo AND hi WINDOW o AS (PARTITION BY file_name, cue_direction, channel, "window" ORDER BY i))
    SELECT file_name, cue_direction, channel, "window", round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS positive_peak, round(first(t ORDER BY v DESC, t), 6) AS positive_peak_latency_s, round(sum(s), 6) + 0.0 AS area FROM a GROUP BY ALL""")
def curve_features(spark, sf_dir):
    from .plans.curves import curve_features as run

    curves = signal.median_curves(_epochs(spark, sf_dir), ["file_name", "cue_direction"]).drop("n_trials")
    return _rounded(run(curves, POINTS))


@query("""WITH v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) - 1 AS t, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, avg(v) AS m FROM v GROUP BY ALL),
    x AS (SELECT vec_id, t, (v - m) * (0.5 - 0.5 * cos(2 * pi() * t / 64)) AS x FROM v JOIN m USING (vec_id)), f AS (SELECT unnest(range(2, 60)) AS f), h AS (SELECT sum((0.5 - 0.5 * cos(2 * pi() * t / 64)) ** 2) AS h FROM (SELECT unnest(range(0, 64)) AS t)),
    d AS (SELECT vec_id, f, sum(x * cos(2 * pi() * f * t / 512)) AS re, sum(x * sin(2 * pi() * f * t / 512)) AS im FROM x, f GROUP BY ALL), p AS (SELECT vec_id, f, 2 * (re * re + im * im) / (256 * h) AS p FROM d, h),
    b AS (SELECT unnest(['delta_1_4Hz', 'theta_4_8Hz', 'alpha_8_13Hz', 'beta_13_30Hz', 'all_1_30Hz']) AS band, unnest([1, 4, 8, 13, 1]) AS lo, unnest([4, 8, 13, 30, 30]) AS hi),
    s AS (SELECT vec_id, band, (p + lag(p) OVER (PARTITION BY vec_id, band ORDER BY f)) / 4 AS s FROM p JOIN b ON f >= 2 * lo AND f < 2 * hi) SELECT vec_id, band, round(sum(s), 9) AS power FROM s GROUP BY ALL""")
def short_band_powers(spark, sf_dir):
    cfg = Settings()
    names = [*(n for n, _, _ in cfg.bands), "all_1_30Hz"]
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", signal.array_bands(F.col("embedding").cast("array<double>"), 0, 64, cfg).alias("b"))
    return rows.select("vec_id", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("band"), F.col("b").alias("power"))).alias("z")).select("vec_id", "z.band", F.round("z.power", 9).alias("power"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def columns_by_prefix(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *relational.feature_group(rows.columns, ("l_q", "l_ex", "l_dis")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders")
def csv_round_trip(spark, sf_dir):
    from .sources import tables

    path = tables.shared_folder(spark, "csv")
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 != 0, F.round(F.col("o_totalprice").cast("double"), 2)).alias("price"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    tables.write_csv(rows, path, "%.12g")
    return tables.read_csv(spark, path, rows.schema)


@query(f"WITH {EPOCHS_SQL} SELECT file_name, trial_id::INT AS trial_id, channel, i, round(v::FLOAT::DOUBLE, 7) + 0.0 AS v FROM ep")
def epoch_round_trip(spark, sf_dir):
    from .sources import tables

    path = tables.shared_folder(spark, "epochs")
    tables.write_epochs(_epochs(spark, sf_dir), path)
    rows = tables.read_epochs(spark, path, 64, ("file_name", "trial_id", "channel", "values"))
    return rows.select("file_name", "trial_id", "channel", F.posexplode("values").alias("i", "v")).withColumn("v", neat(F.col("v"), 7))


@query(f"""WITH {EPOCHS_SQL} SELECT file_name, trial_id::INT AS trial_id, channel, i, i / 64.0::DOUBLE AS time_s, CASE trial_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END::TINYINT AS behavior_code, round(v::FLOAT::DOUBLE, 7) + 0.0 AS v FROM ep""")
def archive_round_trip(spark, sf_dir):
    from .sources import tables

    path = tables.shared_folder(spark, "archive")
    known = F.when(F.col("trial_id") % 3 != 0, F.col("trial_id") % 3 == 1)
    tables.write_archive(_epochs(spark, sf_dir).withColumn("correct", known), path, POINTS, "correct")
    rows = tables.read_archive(spark, path, POINTS, ("file_name", "trial_id", "channel", "values", "behavior_code"))
    axis = F.broadcast(tables.archive_facts(spark, path).select(F.posexplode("time_s").alias("i", "time_s")))
    points = rows.select("file_name", "trial_id", "channel", "behavior_code", F.posexplode("values").alias("i", "v")).join(axis, "i")
    return points.withColumn("v", neat(F.col("v"), 7))


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'StudyCogA' ELSE 'StudyCogB' END || '_Task-' || (n_nationkey % 3) || '.mat' AS file_name, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS subject, CASE WHEN n_nationkey % 3 = 1 THEN 'Task-1' ELSE 'Task-2' END AS task, count(*) AS n FROM nation GROUP BY ALL""")
def file_facts(spark, sf_dir):
    from .sources import tables

    key = F.col("n_nationkey")
    path = F.concat(F.lit("/data/raw/"), F.when(key % 2 == 0, "StudyCogA").otherwise("StudyCogB"), F.lit("_Task-"), key % 3, F.lit(".mat"))
    rows = tables.with_recording_facts(_t(spark, sf_dir, "nation").select(path.alias("path")), F.col("path"))
    return rows.groupBy("file_name", "subject", "task").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT vec_id // 3 AS file_name, ['Fz', 'F3', 'F4'][vec_id % 3 + 1] AS channel, unnest(range(1, len(embedding) + 1)) - 1 AS sample_idx, unnest(embedding)::DOUBLE AS value, count(*) OVER (PARTITION BY vec_id // 3) AS n FROM embeddings)
    SELECT file_name, channel, sample_idx, round(value, 7) + 0.0 AS value FROM m WHERE n = 3""")
def matrix_samples(spark, sf_dir):
    from .sources import tables

    rows = _t(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("file_name")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("m")).where(F.size("m") == 3)
    rows = rows.select("file_name", F.transform("m", lambda r: r["e"]).alias("data"), F.array(*[F.array(*map(F.lit, c)) for c in POINTS.channels]).alias("cells"))
    samples = tables.samples_of_matrix(rows.withColumn("labels", tables.labels_of(F.col("cells"))))
    return samples.withColumn("value", neat(F.col("value"), 7))
