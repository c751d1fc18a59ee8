"""Model fits and evaluations. Fits have no SQL twin; they run with the settings of the operators' purpose."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import GRID_SQL, dense_observations, exact_mean, model_forecasts, observations, region_days
from rainloom.catalog.ensembles import labelled
from rainloom.catalog.feature_sets import CALENDAR_SQL, CYCLE_SQL, DELTA_SQL, EXTRA_SQL, FLAG_SQL, LAG_SQL, W, WIND_SQL, rolling_sql
from rainloom.catalog.profiles import store
from rainloom.catalog.registry import query
from rainloom.constants import (
    ALL_FEATURES, BASE_FEATURES, MODEL_VERSIONS_DDL, RAW_COLUMNS, SWEEP_ENSEMBLE, SWEEP_REGIONAL, SWEEP_RETRAIN,
)
from rainloom.functions.ensemble import live_name
from rainloom.functions.labels import event
from rainloom.operators.bagging import ForestSettings
from rainloom.operators.baselines import best_vote_count, long_decisions, single_model_f1, vote_count
from rainloom.operators.blocks import over_blocks
from rainloom.operators.ensemble_features import ensemble_feature_names, ensemble_features
from rainloom.operators.ledger import conform
from rainloom.operators.metrics import best_threshold, brier, grid, regression_metrics, threshold_sweep
from rainloom.operators.models import (
    Grower, calibrated, fit_amount, fit_boosted, fit_forest, importances, predict, predict_amount,
)
from rainloom.operators.profile import best_per_group
from rainloom.operators.seasonal import fit_seasonal, predict_seasonal
from rainloom.operators.splits import assign_folds, split_at
from rainloom.plans.evaluation import (
    ablation, approaches_station_out, cross_fitted, decided, evaluate, evaluate_by_station, fit_each, lead_comparison,
    leave_one_out, out_of_fold, predict_each, source_matrix, stack, stacked_leave_one_out, transfer, weighted_by_hours,
)
from rainloom.plans.serving import publish, score_ensemble, score_hours, serving_frame
from rainloom.plans.training import retrain_into, train_ensemble, train_regional
from rainloom.session import materialize, scratch_path
from rainloom.sinks.tables import read_evolved
from rainloom.sources.tables import read_table

T = "observation_time"
KEY = ["station_id"]
Y = "target_will_rain"
CUTS = ("2024-01-18 00:00:00", "2024-01-24 00:00:00")
NAMES = ("train", "calibrate", "test")
#: Models of other stations are shallower and have larger leaves than the champion, and balance every bag.
regional = Grower(ForestSettings(trees=300, depth=12, least_rows=20, balance="bag"), "rain-regional", complete=True)
#: The champion's settings, for the many first models of a stack.
champions = Grower(ForestSettings(trees=200, depth=15, least_rows=1, balance="all"), "rain", complete=True)
#: Models of the forecast hour and its neighbours.
phase_forest = partial(fit_forest, trees=300, depth=12, leaf=5)
_moment = lambda text: F.lit(text).cast("timestamp_ntz")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature store with a temporal split, written once because fits read it many times."""
    return materialize(split_at(store(spark, sf_dir).dropna(subset=ALL_FEATURES), *CUTS, NAMES), "training")


def part(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("split") == name)


def champion_of(rows: DataFrame):
    model = fit_forest(part(rows, "train"), BASE_FEATURES, Y, name="rain")
    return calibrated(model, part(rows, "calibrate"), Y, grid(*SWEEP_RETRAIN))


# --- serving ----------------------------------------------------------------------------

_SERVE_SQL = "WITH" + GRID_SQL + f""",
obs AS (SELECT * FROM cells WHERE observation_time <= TIMESTAMP '2024-01-20 06:30:00' AND observation_time >= TIMESTAMP '2024-01-17 06:00:00'),
fcst AS (SELECT * REPLACE (temperature_2m + 1 AS temperature_2m, observation_time + INTERVAL 24 HOUR AS observation_time) FROM cells),
fc2 AS (SELECT * FROM fcst WHERE observation_time >= TIMESTAMP '2024-01-17 06:00:00' AND observation_time <= TIMESTAMP '2024-01-21 07:00:00'
        AND (station_id, observation_time) NOT IN (SELECT station_id, observation_time FROM obs)),
both_ AS (SELECT * FROM obs UNION ALL BY NAME SELECT * FROM fc2),
bs AS (SELECT station_id, MIN(observation_time) AS lo, MAX(observation_time) AS hi FROM both_ GROUP BY 1),
bf AS (SELECT station_id, UNNEST(generate_series(lo, hi, INTERVAL 1 HOUR)) AS observation_time FROM bs),
ser AS (SELECT * FROM bf LEFT JOIN both_ USING (station_id, observation_time)),
ft AS (SELECT *, {LAG_SQL}, {DELTA_SQL}, {rolling_sql()}, {CALENDAR_SQL}, {CYCLE_SQL}, {FLAG_SQL}, {EXTRA_SQL}, {WIND_SQL},
              LEAD(precipitation, 1) OVER w AS api_precip_alvo FROM ser {W})
SELECT station_id, observation_time, temp_lag_24h, temp_rolling_6h, precip_rolling_24h, pressure_tend_3h, api_precip_alvo FROM ft
WHERE observation_time >= TIMESTAMP '2024-01-20 06:00:00' AND observation_time < TIMESTAMP '2024-01-21 06:00:00'
  AND {" AND ".join(f"{c} IS NOT NULL" for c in BASE_FEATURES)}"""


def _serving(spark, sf_dir, features=BASE_FEATURES):
    cells = observations(spark, sf_dir)
    forecast = cells.withColumns({"temperature_2m": F.col("temperature_2m") + 1, T: F.col(T) + F.expr("INTERVAL 24 HOURS")})
    return serving_frame(cells, forecast, KEY, _moment("2024-01-20 06:30:00"), features)


@query(_SERVE_SQL)
def serving_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the next 24 hours from observations followed by the forecast."""
    return _serving(spark, sf_dir).select(
        *KEY, T, "temp_lag_24h", "temp_rolling_6h", "precip_rolling_24h", "pressure_tend_3h", "api_precip_alvo"
    )


@query()
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models side by side over the coming hours, published and merged into the history."""
    rows = training_rows(spark, sf_dir)
    champion = champion_of(rows)
    second = regional(part(rows, "train"), ALL_FEATURES, Y)
    scored = score_hours(_serving(spark, sf_dir, ALL_FEATURES), champion, _moment("2024-01-20 06:30:00"), second)
    latest, history = scratch_path(spark, "latest"), scratch_path(spark, "history")
    publish(scored, latest, history, ["station_id", "inferencia_local", "target_time"])
    return spark.read.parquet(history)


@query()
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 48 hours from six models' forecasts."""
    rows = materialize(labelled(spark, sf_dir), "ensemble-rows")
    model = fit_boosted(rows.where(F.col(T) < _moment(CUTS[1])), ensemble_feature_names(), "y", name="mos-multimodelo")
    features = ensemble_features(model_forecasts(spark, sf_dir, live_name), [], live_name)
    return score_ensemble(features, model, _moment("2024-01-26 10:20:00"))


# --- classifiers ------------------------------------------------------------------------

def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six years of days with lags of the orders' mean price and number, and whether the next day's mean is high."""
    days = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias(T)).agg(
        exact_mean(F.col("o_totalprice")).alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
    )
    columns = lambda w: {f"{c}_lag_{k}d": F.lag(c, k).over(w) for c in ("price", "n_orders", "urgent") for k in (1, 2, 7)} | {
        "next_high": (F.lead("price", 1).over(w) > HIGH_PRICE).cast("int"),
    }
    lagged = over_blocks(days, [], T, 7, 1, columns, step_hours=24)
    return lagged.withColumns({"weekday": F.dayofweek(T).cast("double"), "month": F.month(T).cast("double")})


HIGH_PRICE = 250_000.0
DAY_FEATURES = ["price", "n_orders", "urgent", "weekday", "month"] + [f"{c}_lag_{k}d" for c in ("price", "n_orders", "urgent") for k in (1, 2, 7)]


@query()
def retrain_with_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three monthly retrainings on six years of days: fit, calibrate on a year, test on a year, promote or keep, and
    the stored ledger read back."""
    days, path = materialize(order_days(spark, sf_dir), "order-days"), scratch_path(spark, "ledger")
    champion = None
    for version, month in enumerate(("2001-04-01 00:00:00", "2001-05-01 00:00:00", "2001-06-01 00:00:00"), 1):
        champion = retrain_into(path, days, DAY_FEATURES, "next_high", _moment(month), fit_forest, version, _moment(month), champion)
    return conform(read_evolved(spark, path), MODEL_VERSIONS_DDL)


@query()
def feature_importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_forest(part(training_rows(spark, sf_dir), "train"), ALL_FEATURES, Y)
    return spark.createDataFrame(importances(model, 15), "feature string, importance double")


@query()
def champion_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold from the calibration rows, metrics on the test rows."""
    rows = training_rows(spark, sf_dir)
    tested = materialize(decided(champion_of(rows), part(rows, "test"), "champion"), "tested")
    return evaluate(tested, ["abordagem", "threshold"], Y)


@query()
def hurdle_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage amounts and their errors on all and on wet hours."""
    rows = training_rows(spark, sf_dir)
    amount = fit_amount(part(rows, "train"), BASE_FEATURES, "target_rain_next_1h")
    predicted = predict_amount(champion_of(rows), amount, part(rows, "test")).select("target_rain_next_1h", "amount")
    return regression_metrics(predicted, [], "target_rain_next_1h", "amount")


@query()
def gbt_mos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted model on six models' forecasts: out-of-fold threshold, then test."""
    rows = materialize(labelled(spark, sf_dir).withColumn("period", F.date_format(T, "yyyy-MM-dd")), "mos-rows")
    train, test = rows.where(F.col(T) < _moment(CUTS[1])), rows.where(F.col(T) >= _moment(CUTS[1]))
    names = ensemble_feature_names()
    # the models of the folds and the final one grow in the same jobs
    folded = materialize(assign_folds(train, ["period"], 4), "mos-folds")
    mine = {str(n): F.col("fold") == n for n in range(4)}
    models = fit_each(fit_boosted, folded, names, "y", {k: ~c for k, c in mine.items()} | {"all": F.lit(True)})
    final = models.pop("all")
    oof = materialize(predict_each(models, folded, mine), "oof")
    threshold = best_threshold(threshold_sweep(oof, [], "score", "y", grid(*SWEEP_ENSEMBLE)), []).first()["threshold"]
    scored = materialize(decided(replace(final, threshold=threshold), test, "mos"), "tested")
    out = evaluate(scored, ["abordagem", "threshold"], "y")
    return out.withColumn("brier", scored.agg(brier("score", "y")).scalar())


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training row scored by a model of the other stations' folds."""
    rows = part(training_rows(spark, sf_dir), "train")
    return out_of_fold(rows, KEY, 3, BASE_FEATURES, Y, fit_forest).select(*KEY, T, Y, "fold", "score")


@query()
def approach_comparison_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API, best single model, votes and a fitted model on the same test rows."""
    rows = materialize(labelled(spark, sf_dir), "mos-rows")
    train, test = rows.where(F.col(T) < _moment(CUTS[1])), rows.where(F.col(T) >= _moment(CUTS[1]))
    single = best_per_group(single_model_f1(train, [], "y"), [], "f1", [F.col("rank_no")]).first()["modelo"]
    votes_needed = best_vote_count(train, [], "y").first()["threshold"]
    model = fit_boosted(train, ensemble_feature_names(), "y")
    scored = predict(model, test, "prob")
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    long = long_decisions(scored, ["y"], {
        "api": (score("p_best_match") > 0, score("p_best_match")),
        f"melhor_1:{single}": (score(f"p_{single}") > 0, score(f"p_{single}")),
        "votos": (vote_count() >= votes_needed, vote_count() / 6.0),
        "mos": (F.col("prob") >= model.threshold, F.col("prob")),
    })
    return evaluate(materialize(long, "approaches"), ["abordagem"], "y")


def station_forecasts(spark: SparkSession, sf_dir: str, ahead_hours: int = 2) -> DataFrame:
    """Six models' forecasts of three stations with a measured event: rain a few hours later."""
    wide = ensemble_features(model_forecasts(spark, sf_dir, live_name, stations=3), KEY, live_name)
    ahead = lambda w: {"y": (F.lead("p_best_match", ahead_hours).over(w) > 0).cast("int")}
    return over_blocks(wide, KEY, T, 0, ahead_hours, ahead).dropna(subset=["y", "p_best_match"])


@query()
def approaches_by_held_out_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four approaches with each station left out, and their means weighted by test hours."""
    rows = materialize(station_forecasts(spark, sf_dir), "stations")
    long = materialize(approaches_station_out(
        rows, "station_id", "y", ensemble_feature_names(), _moment(CUTS[1]), fit_boosted, grid(*SWEEP_ENSEMBLE), folds=4, at_least=10
    ), "approaches")
    per_station = evaluate(long, ["abordagem", "station_id"], "y").select("abordagem", "station_id", "f1", "n")
    means = weighted_by_hours(per_station, ["abordagem"]).withColumn("station_id", F.lit("todas"))
    return per_station.unionByName(means)


@query()
def loso_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station tested by models that never saw it: a regional one, one with the champion's
    probability as an input, the champion itself and persistence; per station and pooled.

    The champion's probability of a row comes from a model that saw neither the held-out station nor
    the fold of stations the row belongs to.
    """
    rows = training_rows(spark, sf_dir)
    stacked = materialize(cross_fitted(rows, "station_id", BASE_FEATURES, Y, champions, "p_champ"), "stacked")
    own = stacked.where("split = 'test'")
    places = F.array(*[F.lit(r[0]) for r in rows.select("station_id").distinct().orderBy("station_id").collect()])
    p_own = F.col("p_champ")[(F.array_position(places, F.col("station_id")) - 1).cast("string")]
    sweep = grid(*SWEEP_REGIONAL)
    regionals = leave_one_out(stacked.drop("p_champ"), "station_id", Y, {"regional": BASE_FEATURES}, regional, sweep, at_least=10)
    both = stacked_leave_one_out(stacked, "station_id", Y, BASE_FEATURES, "p_champ", regional, sweep, "regional_mais_champ", at_least=10)
    wet = F.col("precipitation") > 0
    plain = long_decisions(own.withColumn("_own", p_own), ["station_id", Y], {
        "champion": (F.col("_own") >= 0.5, F.col("_own")), "persistencia": (wet, F.lit(None)),
    })
    shared = ["station_id", Y, "score", "pred", "abordagem"]
    pooled = materialize(stack([regionals.select(shared), both.select(shared), plain.select(shared)]), "loso")
    return evaluate_by_station(pooled, ["abordagem"], "station_id", Y)


@query()
def regional_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final regional model and its ledger row."""
    rows = training_rows(spark, sf_dir)
    _, ledger = train_regional(rows, "station_id", BASE_FEATURES, Y, regional, 1, _moment("2024-02-01 00:00:00"), at_least=10)
    return ledger


@query()
def ensemble_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted model on six models' forecasts, judged against the raw forecast with stations left out, and its ledger row."""
    rows = materialize(station_forecasts(spark, sf_dir), "stations")
    _, ledger = train_ensemble(
        rows, "station_id", ensemble_feature_names(), "y", "p_best_match", _moment(CUTS[1]), fit_boosted, 1, _moment("2024-02-01 00:00:00"),
        folds=3, at_least=10,
    )
    return ledger


@query()
def ablation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four feature sets on the same rows; the monthly index is stood in by the day's phase."""
    rows = training_rows(spark, sf_dir).withColumn("oni", F.sin(F.dayofmonth(T) / 5.0))
    variants = {
        "A_base": BASE_FEATURES, "B_base_extra": ALL_FEATURES, "C_base_extra_oni": [*ALL_FEATURES, "oni"], "D_base_oni": [*BASE_FEATURES, "oni"],
    }
    tested = materialize(ablation(rows, Y, variants, fit_forest, grid(*SWEEP_RETRAIN)), "ablation")
    return evaluate(tested, ["abordagem", "n_features", "threshold"], Y)


@query()
def train_test_source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of the same hours, each trained and tested against each."""
    rows = training_rows(spark, sf_dir)
    keep = [*KEY, T, *BASE_FEATURES, Y, "split"]
    other = rows.withColumns({"temperature_2m": F.col("apparent_temperature"), "relative_humidity": F.col("dew_point_2m")})
    sources = {"bestmatch": rows.select(keep), "era5": materialize(other.select(keep), "source")}
    tested = materialize(source_matrix(sources, [*KEY, T], Y, BASE_FEATURES, fit_forest, grid(*SWEEP_RETRAIN)), "matrix")
    return evaluate(tested, ["abordagem", "threshold"], Y)


@query()
def transfer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model at every station against two labels and against persistence."""
    rows = training_rows(spark, sf_dir)
    test = part(rows, "test").withColumns({
        "y_medida": (F.col("target_rain_next_1h") >= 5).cast("int"), "persist": (F.col("precipitation") > 0).cast("int"),
    })
    long = transfer(champion_of(rows), test, {"rotulo_modelo": Y, "chuva_medida": "y_medida"}, "persist")
    return evaluate(materialize(long, "transfer"), ["alvo", "station_id"], "y")


@query()
def champion_on_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw forecast and champion at leads 0, 1 and 2, phase-shift models at leads 1 and 2, all
    on identical hours. An older run is stood in by the series of as many hours before."""
    rows = training_rows(spark, sf_dir)
    champion = champion_of(rows)
    dense = materialize(dense_observations(spark, sf_dir), "dense")
    truth = dense.select(*KEY, T, event(F.col("precipitation")).alias("y"))
    runs = {0: dense} | {
        n: over_blocks(dense, KEY, T, n, 0, lambda w: {c: F.lag(c, n).over(w) for c in RAW_COLUMNS}) for n in (1, 2)
    }
    return evaluate(lead_comparison(runs, truth, KEY, champion, phase_forest, CUTS, grid(*SWEEP_RETRAIN)), ["abordagem"], "y")


@query()
def seasonal_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily amounts from a trend with change points times yearly and weekly seasons; errors on the last years."""
    daily = region_days(spark, sf_dir).groupBy(F.to_date(T).alias("ds")).agg(F.sum("precipitation").alias("y"))
    daily = materialize(daily, "daily")
    cut = F.lit("2000-01-01").cast("date")
    model = fit_seasonal(daily.where(F.col("ds") < cut), "ds", "y")
    predicted = predict_seasonal(model, daily.where(F.col("ds") >= cut), "ds")
    return regression_metrics(predicted, [], "y", "yhat")
