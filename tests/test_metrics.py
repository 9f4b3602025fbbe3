"""Golden vectors, and the invariants of each metric, in the driver's and in the DataFrame form."""

import math
import random

import pytest

from tidemark.enums import CategoricalMetric as K
from tidemark.enums import ColumnClass
from tidemark.enums import ContinuousMetric as C
from tidemark.enums import QuantileType
from tidemark.errors import UnsupportedDriftType
from tidemark.functions.metrics import drift_rows, evaluate

# case: baseline, runtime, sizes, then PSI, KL, JS, continuous and categorical Wasserstein, KS, Hellinger, chi-squared, G
GOLDEN = {
    "disjoint": ([1000, 0], [0, 1000], 1000, 1000, 55.2620422318, 27.6310211159, 0.99999999996, 0, 0.999999999999, 0.999999999999, 0.999999, 2000, 2772.58872224),
    "shifted": ([700, 300], [300, 700], 1000, 1000, 0.67783828831, 0.338919144155, 0.118709100769, 0, 0.4, 0.4, 0.288937469029, 320, 329.13151402),
    "flip90": ([900, 100], [100, 900], 1000, 1000, 3.51555932374, 1.75777966187, 0.531004406411, 0, 0.8, 0.8, 0.632455532034, 1280, 1472.25682867),
    "cont4": ([0, 800, 200, 0], [0, 200, 800, 0], 1000, 1000, 1.66355323334, 0.831776616672, 0.278071905113, 0.6, 0.6, 0.6, 0.4472135955, 720, 770.979028087),
    "uneven": ([3, 2, 0], [2, 0, 8], 5, 10, 33.0516391207, 11.3450595268, 0.675488750177, 0.399999999999, 0.799999999999, 0.8, 0.808448088379, 9.6, 12.3653083788),
}
ORDER = [C.POPULATION_STABILITY_INDEX, C.KULLBACK_LEIBLER, C.JENSEN_SHANNON, C.WASSERSTEIN_DISTANCE, K.WASSERSTEIN_DISTANCE, C.KOLMOGOROV_SMIRNOV, C.HELLINGER, K.CHI_SQUARED, K.G_TEST]


@pytest.mark.parametrize("case", GOLDEN)
def test_golden(case):
    bl, rt, bl_n, rt_n, *expected = GOLDEN[case]
    for metric, value in zip(ORDER, expected, strict=True):
        assert evaluate(bl, rt, bl_n, rt_n, metric) == pytest.approx(value, rel=1e-9, abs=1e-9), metric


@pytest.mark.parametrize("metric", [*C, *K])
def test_identical_is_zero(metric):
    assert evaluate([500, 500], [500, 500], 1000, 1000, metric) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("metric", [*C, *K])
def test_bounds_and_sign(metric):
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(3, 9)
        bl, rt = ([rng.randint(0, 50) for _ in range(n)] for _ in range(2))
        if not sum(bl) or not sum(rt):
            continue
        value = evaluate(bl, rt, sum(bl), sum(rt), metric)
        assert math.isfinite(value) and value > -1e-6
        if metric.value in ("JensenShannon", "Hellinger", "KolmogorovSmirnov", "WassersteinDistance"):
            assert value <= 1 + 1e-9


@pytest.mark.parametrize("metric", [C.JENSEN_SHANNON, C.HELLINGER, C.POPULATION_STABILITY_INDEX])
def test_symmetric(metric):
    a, b = [7, 2, 1], [1, 3, 6]
    assert evaluate(a, b, 10, 10, metric) == pytest.approx(evaluate(b, a, 10, 10, metric))


@pytest.mark.parametrize("kind,metrics", [(ColumnClass.CONTINUOUS, list(C)), (ColumnClass.CATEGORICAL, list(K))])
def test_dataframe_form_agrees(spark, kind, metrics):
    rows = [(name, i, float(a), float(b), float(bl_n), float(rt_n)) for name, (bl, rt, bl_n, rt_n, *_) in GOLDEN.items() for i, (a, b) in enumerate(zip(bl, rt, strict=True))]
    df = spark.createDataFrame(rows, "name string, bin int, bl double, rt double, bl_n double, rt_n double")
    found = {(r["name"], r["metric"]): r["drift_magnitude"] for r in drift_rows(df, kind, metrics, ["name"]).collect()}
    for name, (bl, rt, bl_n, rt_n, *_) in GOLDEN.items():
        for m in metrics:
            assert found[name, m.value] == pytest.approx(evaluate(bl, rt, bl_n, rt_n, m), rel=1e-9, abs=1e-9)


def test_names_are_case_sensitive():
    assert C.parse("Hellinger") is C.HELLINGER and QuantileType.parse("Scott") is QuantileType.SCOTT
    for kind, name in ((C, "hellinger"), (C, "ChiSquared"), (K, "KolmogorovSmirnov"), (QuantileType, "sturges")):
        with pytest.raises(UnsupportedDriftType):
            kind.parse(name)
