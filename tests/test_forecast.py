"""Forecaster vs a brute-force numpy fit of the same series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import forecast as FC
from tally.plans.catalog import as_of_of
from tally.sources import testviews as tv
from tests.conftest import SF001


@pytest.fixture(scope="module")
def fitted(spark):
    led, acc = tv.transactions(spark, SF001), tv.accounts(spark, SF001)
    series = FC.balance_series(led, acc, as_of_of(led))
    models = FC.fit_forecaster(series)
    return series.toPandas(), models.toPandas(), models


def test_fit_matches_numpy(fitted):
    series, models, _ = fitted
    assert len(models) == 10
    for m in models.itertuples():
        s = series[series.account_id == m.account_id].sort_values("ds")
        y = s["y"].to_numpy()
        i = np.arange(len(s), dtype=float)
        slope, intercept = np.polyfit(i, y, 1)
        assert m.slope == pytest.approx(slope, rel=1e-9, abs=1e-9)
        assert m.intercept == pytest.approx(intercept, rel=1e-9)
        resid = y - (intercept + slope * i)
        wd = np.array([d.weekday() for d in s["ds"]])
        offs = {int(k): float(resid[wd == k].mean()) for k in np.unique(wd)}
        for k, v in offs.items():
            assert m.weekday_offsets[k] == pytest.approx(v, rel=1e-6, abs=1e-6)
        sigma = np.std(resid - np.array([offs[int(k)] for k in wd]), ddof=1)
        assert m.sigma == pytest.approx(round(sigma, 4), abs=2e-4)
        assert m.n_days == len(s) >= 90


@pytest.mark.parametrize("horizon", [7, 30])
def test_forecast_shape(fitted, horizon):
    _, models, mdf = fitted
    pts = FC.forecast_points(mdf, horizon).toPandas()
    assert len(pts) == 10 * horizon
    assert (pts.groupby("account_id").size() == horizon).all()
    assert (pts.lower_bound <= pts.balance).all() and (pts.balance <= pts.upper_bound).all()
    last = dict(zip(models.account_id, models.last_ds))
    first = pts.groupby("account_id").date.min()
    assert all((first[a] - last[a]).days == 1 for a in first.index)


def test_horizon_bounds(fitted):
    with pytest.raises(ValueError):
        FC.future_dates(fitted[2], 91)


def test_lookback_picks_smallest_sufficient_window(spark):
    rows = [("a", f"2020-{m:02d}-{d:02d}", 100, "inflow") for m in range(1, 13) for d in (1, 15)]
    rows += [("a", f"2023-{m:02d}-{d:02d}", 100, "inflow") for m in range(1, 13) for d in range(1, 8)]
    led = spark.createDataFrame(rows, "account_id string, transaction_date string, amount long, direction string")
    led = led.withColumn("transaction_date", F.col("transaction_date").cast("date"))
    look = FC.adaptive_lookback(FC.daily_signed(led, "2024-06-30"), "2024-06-30").first()
    # 2y and 3y windows hold 84 days; the 4y window adds Jul-Dec 2020 (12 days).
    assert (look.days_2y, look.days_3y, look.days_4y, look.days_5y) == (84, 84, 96, 108)
    assert look.lookback_years == 4 and look.n_days == 96
