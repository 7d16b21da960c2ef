"""Forecast error measures as aggregate expressions; rows with a NULL side are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error(y: str = "y", yhat: str = "yhat") -> Column:
    return F.col(y) - F.col(yhat)


def percent_error(y: str = "y", yhat: str = "yhat") -> Column:
    """NULL where the actual is zero."""
    return F.try_divide(error(y, yhat), F.col(y)) * 100


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(error(y, yhat)))


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sqrt(F.avg(error(y, yhat) * error(y, yhat)))


def wape(y: str = "y", yhat: str = "yhat") -> Column:
    both = F.when(F.col(yhat).isNotNull(), F.abs(F.col(y)))
    return F.try_divide(F.sum(F.abs(error(y, yhat))), F.sum(both)) * 100


def rmsle(y: str = "y", yhat: str = "yhat") -> Column:
    gap = F.log1p(F.col(yhat)) - F.log1p(F.col(y))
    return F.sqrt(F.avg(gap * gap))


def mape(y: str = "y", yhat: str = "yhat") -> Column:
    """Zero actuals are skipped; `zero_actuals` counts them."""
    return F.avg(F.abs(percent_error(y, yhat)))


def zero_actuals(y: str = "y", yhat: str = "yhat") -> Column:
    return F.count_if((F.col(y) == 0) & F.col(yhat).isNotNull())


def scored(y: str = "y", yhat: str = "yhat") -> Column:
    return F.count(error(y, yhat))
