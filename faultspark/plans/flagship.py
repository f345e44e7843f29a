"""The headline question: which series change just before their trigger?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import rnd
from ..operators import series as S
from ..operators.anomaly import minmax_ensemble
from ..operators.matrix import finite
from .registry import R, query
from .seriesdata import PRE, REF_DT, WINDOW_SQL, samples, scaled_sql

SQL = f"""{WINDOW_SQL}, e AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS dv, {scaled_sql(7)} AS ne, {scaled_sql(13)} AS nl FROM win),
  c AS (SELECT *, sum(dv) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cs FROM e),
  f AS (SELECT series_id, abs(coalesce(regr_slope(value, pos), 0)) AS slope, greatest(max(cs), -min(cs)) AS cusum, abs(avg(CASE WHEN pos >= nl THEN value END) - avg(CASE WHEN pos < ne THEN value END)) AS diff,
    var_pop(CASE WHEN pos >= nl THEN value END) / (var_pop(CASE WHEN pos < ne THEN value END) + 1e-10) AS vr FROM c GROUP BY 1),
  b AS (SELECT *, {', '.join(f'coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0) AS n_{x}' for x in ('slope', 'cusum', 'diff', 'vr'))} FROM f)
  SELECT series_id, {R('slope')} AS slope, {R('cusum', 4)} AS cusum, {R('diff')} AS diff, {R('(n_slope + n_cusum + n_diff + n_vr) / 4')} AS score FROM b ORDER BY (n_slope + n_cusum + n_diff + n_vr) DESC, series_id LIMIT 20"""


@query("changed_before_trigger", "C30", SQL)
def changed_before_trigger(t) -> DataFrame:
    s = samples(t)
    w = S.pre_window(s, S.find_trigger(s), PRE, REF_DT)
    f = S.window_features(w, S.scale_samples(7, "dt_us", REF_DT), S.scale_samples(13, "dt_us", REF_DT))
    f = f.select("series_id", F.abs("trend_slope").alias("slope"), F.greatest(F.col("cusum_max"), -F.col("cusum_min")).alias("cusum"),
                 F.abs("early_late_diff").alias("diff"), finite(F.col("var_ratio_late_early")).alias("ratio"))
    d = minmax_ensemble(f, ["slope", "cusum", "diff", "ratio"], "score")
    top = d.orderBy(F.desc("score"), "series_id").limit(20)
    return top.select("series_id", rnd("slope").alias("slope"), rnd("cusum", 4).alias("cusum"), rnd("diff").alias("diff"), rnd("score").alias("score"))
