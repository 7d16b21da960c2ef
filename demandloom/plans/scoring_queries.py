"""Scored requests and the submission file, ridge paths per series, validation by running sums."""

from pyspark.sql import functions as F

from demandloom import PAIR
from demandloom.functions import scalars as X
from demandloom.operators import evaluation as E
from demandloom.operators import forecast as Fc
from demandloom.operators import gram as G
from demandloom.operators import ridge as R
from demandloom.operators import scoring as Sg
from demandloom.operators import sets as S
from demandloom.plans.common import r6, rounded
from demandloom.plans.least_squares_sql import dot_sql, least_squares, seasonal_sql
from demandloom.plans.registry import query
from demandloom.session import materialize
from demandloom.sources import panels

_KNOWN = ("known_1", "known_7", "known_28")
_FEATURES = (*_KNOWN, "day_of_week", "month", "store_nbr", "item_nbr")
_S = "PARTITION BY store_nbr, item_nbr"


def _known_sql(source):
    """Means of the last known log demands before each row."""
    means = ", ".join(f"avg(y) OVER ({_S} ORDER BY k RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS known_{n}" for n in (1, 7, 28))
    return f"""f AS (SELECT *, {means} FROM (SELECT *, count(y) OVER ({_S} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM {source}) t)"""


_TERMS_SQL = seasonal_sql(yearly=1) | {k: k for k in _KNOWN}


def _terms():
    return Fc.seasonal_terms(yearly=1, regressors=_KNOWN)


def _requests(spark, d):
    """History before the test period with requests for it, and the series long enough for a model."""
    panel = panels.sales(spark, d, province=False).select("date", *PAIR, X.log_units(F.col("units")).alias("logunits"))
    cut = F.lit(panels.TEST_START).cast("date")
    history, requests = panel.where(F.col("date") < cut), panel.where(F.col("date") >= cut).select("date", *PAIR)
    rows = materialize(Sg.known_means(S.stack_requests(history, requests, "is_request"), "logunits"), "requests")
    return rows, Fc.long_enough(rows.where("NOT is_request"))


@query(
    "fc7_score_and_submit",
    f"""WITH h AS (SELECT date, store_nbr, item_nbr, CASE WHEN date < DATE '2001-01-01' THEN ln(1 + units) END AS y FROM sales), {_known_sql('h')},
        m AS (SELECT store_nbr, item_nbr FROM h WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20),
        {least_squares('(SELECT f.* FROM f JOIN m USING (store_nbr, item_nbr))', [], _TERMS_SQL, 'y')}
        SELECT concat_ws('_', f.store_nbr, f.item_nbr, strftime(date, '%Y-%m-%d')) AS id,
               round(CASE WHEN m.store_nbr IS NULL THEN 0 ELSE greatest(exp(coalesce({dot_sql(_TERMS_SQL, 'ols.')}, 0)) - 1, 0) END, 4) + 0 AS units
        FROM f CROSS JOIN ols LEFT JOIN m ON f.store_nbr = m.store_nbr AND f.item_nbr = m.item_nbr WHERE f.y IS NULL""",
)
def _(spark, d):
    """Least squares on the log demand of all series with 20 rows before the test period; requests scored from history
    before it only, un-logged, floored, 0 for other series; written as the sorted submission and read back."""
    rows, modelled = _requests(spark, d)
    train = rows.where("NOT is_request").join(modelled, list(PAIR), "left_semi")
    coef = G.fit(train, _terms(), F.col("logunits")).select("fit.coef").scalar()
    asked = rows.where("is_request").withColumn("_coef", coef)
    scored = Sg.demand_of_logs(asked, G.dot(F.col("_coef"), _terms()), modelled)
    return rounded(Sg.submit(scored), ["units"], 4)


@query("fc7_boosted_submission")
def _(spark, d):
    """The same requests by boosted trees on the same features."""
    rows, modelled = _requests(spark, d)
    rows = rows.where("known_1 IS NOT NULL").withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")})
    train = rows.where("NOT is_request").join(modelled, list(PAIR), "left_semi")
    model = Fc.boosted(_FEATURES, label="logunits").fit(train)
    scored = model.transform(rows.where("is_request"))
    unknown = Sg.demand_of_logs(scored, F.col("yhat"), modelled)
    return Sg.submit(unknown)


# A penalty adds a multiple of the centred sum of squares to each term's diagonal cell.
_PATH_TERMS = seasonal_sql(yearly=1)
_PATH_SOURCE = "(SELECT * FROM sales WHERE date < DATE '2000-07-01')"
_PATH_FITS = ",\n".join(
    least_squares(_PATH_SOURCE, ["store_nbr", "item_nbr"], _PATH_TERMS, "units", f"path{i}", 60, ridge=v) for i, v in enumerate(R.PENALTIES)
)
_PATH_CHOICES = " UNION ALL ".join(
    f"""SELECT o.store_nbr, o.item_nbr, n, {v}::DOUBLE AS penalty, {', '.join(f'b{j}' for j in range(len(_PATH_TERMS) + 1))}, sqrt(e) AS valid_rmse
        FROM path{i} o LEFT JOIN (SELECT s.store_nbr, s.item_nbr, avg((units - ({dot_sql(_PATH_TERMS, 'p.')})) ** 2) AS e
          FROM sales s JOIN path{i} p ON s.store_nbr = p.store_nbr AND s.item_nbr = p.item_nbr
          WHERE date >= DATE '2000-07-01' AND date < DATE '2001-01-01' GROUP BY 1, 2) v ON o.store_nbr = v.store_nbr AND o.item_nbr = v.item_nbr"""
    for i, v in enumerate(R.PENALTIES)
)


@query(
    "fc5_ridge_by_pair",
    f"""WITH {_PATH_FITS}, c AS ({_PATH_CHOICES}),
        m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY valid_rmse,
              CASE WHEN valid_rmse IS NULL THEN penalty ELSE -penalty END) = 1)
        SELECT s.date, s.store_nbr, s.item_nbr, units, penalty, round(coalesce({dot_sql(_PATH_TERMS)}, 0), 4) + 0 AS yhat
        FROM sales s LEFT JOIN m ON s.store_nbr = m.store_nbr AND s.item_nbr = m.item_nbr WHERE date >= DATE '2001-01-01'""",
)
def _(spark, d):
    """One model per series: of five penalties the one with the least error on the half-year before the test period;
    series with fewer than 60 rows before that half-year get none and the forecast 0."""
    panel = panels.sales(spark, d, province=False).drop("category")
    flagged = materialize(S.hold_out_flags(panel, panels.VALID_START, panels.TEST_START), "panel")
    terms = Fc.seasonal_terms(yearly=1)
    models = R.fit_paths(flagged.where("NOT is_test"), terms, F.col("units"), F.col("is_valid"), least=60)
    scored = flagged.where("is_test").join(models.drop("n"), list(PAIR), "left")
    yhat = F.coalesce(G.dot(F.col("fit.coef"), terms), F.lit(0.0)).alias("yhat")
    return rounded(scored.select("date", *PAIR, "units", F.col("fit.penalty").alias("penalty"), yhat), ["yhat"], 4)


_FOLDS_SQL = f"""q AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sales) t),
    h AS (SELECT s.date, store_nbr, item_nbr, ln(1 + units) AS y,
            CASE WHEN position >= n - 5 * (n // 6) THEN CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INT) END AS fold FROM sales s JOIN q ON s.date = q.date),
    {_known_sql('h')},
    """ + ",\n".join(least_squares(f"(SELECT * FROM f WHERE fold IS NULL OR fold < {k})", [], _TERMS_SQL, "y", f"fit{k}") for k in range(5))
_FOLD_ROWS = " UNION ALL ".join(f"SELECT {k} AS fold, n AS n_train, y, {dot_sql(_TERMS_SQL)} AS yhat FROM f, fit{k} WHERE fold = {k}" for k in range(5))


def _folded(spark, d):
    panel = panels.sales(spark, d, province=False).select("date", *PAIR, X.log_units(F.col("units")).alias("y"))
    return materialize(S.date_folds(Sg.known_means(panel, "y")), "folds")


@query(
    "cv2_scores_from_sums",
    f"""WITH {_FOLDS_SQL} SELECT CAST(fold AS INT) AS fold, CAST(max(n_train) AS BIGINT) AS n_train, count(*) AS n,
        {r6('sqrt(avg((y - yhat) ** 2))', 'rmse')}, {r6('avg(y - yhat)', 'bias')} FROM ({_FOLD_ROWS}) t WHERE yhat IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    """Five expanding windows by day: every fold's model and errors from one scan, by running sums of products."""
    scored = R.expanding_fits(_folded(spark, d), _terms(), F.col("y"))
    return rounded(scored.select("fold", "n_train", "n", "rmse", "bias"))


@query(
    "fc4_linear_cross_validation",
    f"""WITH {_FOLDS_SQL} SELECT CAST(fold AS INT) AS fold, {r6('avg(abs(y - yhat))', 'mae')}, {r6('sqrt(avg((y - yhat) ** 2))', 'rmse')},
        {r6('sum(abs(y - yhat)) / sum(y) * 100', 'wape')}, count(*) AS n FROM ({_FOLD_ROWS}) t WHERE yhat IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    """Out-of-fold forecasts row by row with the models of the running sums."""
    folded = _folded(spark, d)
    models = R.expanding_fits(folded, _terms(), F.col("y"))
    predicted = R.out_of_fold(folded.where("known_1 IS NOT NULL"), models, _terms())
    return rounded(E.score(predicted, ["fold"]))
