import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embertrace.operators.ranking import cumulative, exact_quantiles, percentile_rank, value_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """Four in ten rows share one value."""
    random = np.random.default_rng(5)
    values = np.where(random.random(4000) < 0.4, 1.5, np.round(random.normal(size=4000), 2))
    pdf = pd.DataFrame({"id": range(4000), "g": ["a", "b"] * 2000, "v": values})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_value_ranks(skewed):
    pdf, df = skewed
    rows = value_ranks(df, "v").toPandas().sort_values("v")
    counts = pdf["v"].value_counts().sort_index()
    np.testing.assert_array_equal(rows["v"], counts.index)
    np.testing.assert_array_equal(rows["cnt"], counts)
    np.testing.assert_array_equal(rows["cnt_below"], counts.cumsum() - counts)
    assert set(rows["cnt_total"]) == {4000}
    np.testing.assert_array_equal(rows["next_value"].iloc[:-1], counts.index[1:])
    assert pd.isnull(rows["next_value"].iloc[-1])


def test_grouped_running_sums(skewed):
    pdf, df = skewed
    hist = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    got = cumulative(hist, "v", ["n", "s"], ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.groupby("v")["id"].agg(["size", "sum"]).sort_index()
        have = got[got["g"] == g].sort_values("v")
        np.testing.assert_array_equal(have["n_below"], want["size"].cumsum() - want["size"])
        np.testing.assert_array_equal(have["s_below"], want["sum"].cumsum() - want["sum"])
        assert set(have["s_total"]) == {want["sum"].sum()}


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "heavy_keys": 5}])
def test_percentile_rank(skewed, options):
    pdf, df = skewed
    got = percentile_rank(df, "v", F.col("id"), **options).toPandas().set_index("id")["percentile"].sort_index()
    want = pdf["v"].rank(method="average") / len(pdf) * 100
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    q = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, "v", q, ["g"]).collect()
    for row in got:
        want = np.quantile(pdf[pdf["g"] == row["g"]]["v"], q)
        np.testing.assert_allclose(list(row[1:]), want, atol=1e-12)
