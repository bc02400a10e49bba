"""Identities between published outcomes of the study."""

import pytest
from pyspark.sql import functions as F

from evoka.operators import effects, evaluate

# Permutation p and adjusted p of the 24 direction tests.
DIRECTION = [(0.59668066, 0.9194961), (0.76624675, 0.9194961), (0.68906219, 0.9194961), (0.20035993, 0.9194961), (0.97220556, 0.97220556), (0.73625275, 0.9194961), (0.35412917, 0.9194961), (0.38772246, 0.9194961), (0.72065587, 0.9194961), (0.65346931, 0.9194961), (0.56168766, 0.9194961), (0.66686663, 0.9194961), (0.96440712, 0.97220556), (0.41911618, 0.9194961), (0.50729854, 0.9194961), (0.83143371, 0.95020996), (0.36072785, 0.9194961), (0.95360928, 0.97220556), (0.76364727, 0.9194961), (0.49930014, 0.9194961), (0.36732653, 0.9194961), (0.57908418, 0.9194961), (0.12077584, 0.9194961), (0.088382324, 0.9194961)]
# The same of the 8 laterality tests.
LATERALITY = [(0.75224955, 0.82983403), (0.47170566, 0.82983403), (0.23495301, 0.76624675), (0.68486303, 0.82983403), (0.10857828, 0.76624675), (0.28734253, 0.76624675), (0.68846231, 0.82983403), (0.82983403, 0.82983403)]
# Effects of both subjects, same sign, mean.
CONSISTENCY = [(0.1155039, 0.010251275, True, 0.062877586), (-0.068447567, 0.17280065, False, 0.052176541), (-0.090500189, -0.14286165, True, -0.11668092), (0.27844076, -0.046521272, False, 0.11595974), (0.0079848485, 0.19285165, True, 0.10041825), (-0.07332123, -0.012811095, True, -0.043066163), (0.19316004, 0.062848479, True, 0.12800426), (0.18387933, 0.14614232, True, 0.16501082), (0.077801964, 0.19468362, True, 0.13624279), (0.091403263, 0.11665553, True, 0.10402939), (0.12076772, 0.32458375, True, 0.22267573), (0.089016861, 0.35204942, True, 0.22053314)]
# Tn, fp, fn, tp, accuracy, balanced accuracy, sensitivity, specificity, F1, MCC.
CONFUSION = [(45, 41, 43, 46, 0.52, 0.52005487, 0.51685393, 0.52325581, 0.52272727, 0.040104507), (46, 40, 44, 45, 0.52, 0.52025085, 0.50561798, 0.53488372, 0.51724138, 0.040512286), (35, 51, 35, 54, 0.50857143, 0.50685916, 0.60674157, 0.40697674, 0.55670103, 0.013999141), (33, 61, 34, 53, 0.47513812, 0.48012962, 0.6091954, 0.35106383, 0.52736318, -0.041121598), (51, 43, 43, 44, 0.52486188, 0.52415016, 0.50574713, 0.54255319, 0.50574713, 0.048300318), (54, 40, 48, 39, 0.51381215, 0.51137197, 0.44827586, 0.57446809, 0.46987952, 0.022912673), (83, 97, 82, 94, 0.49719101, 0.49760101, 0.53409091, 0.46111111, 0.51226158, -0.0048105236), (85, 95, 84, 92, 0.49719101, 0.49747475, 0.52272727, 0.47222222, 0.50688705, -0.005056654), (81, 99, 74, 102, 0.51404494, 0.51477273, 0.57954545, 0.45, 0.54111406, 0.029793353)]
# Effects of both subjects, one sign, mean size, conservative size.
STABLE = [(-0.299633, -0.314344, True, 0.306988, 0.299633), (-0.300421, -0.267735, True, 0.284078, 0.267735), (-0.264583, -0.395312, True, 0.329948, 0.264583), (0.325382, 0.262956, True, 0.294169, 0.262956), (-0.339845, 0.430809, False, 0.385327, 0.0), (0.367567, -0.388481, False, 0.378024, 0.0)]


@pytest.mark.parametrize("tests", [DIRECTION, LATERALITY], ids=["direction", "laterality"])
def test_adjusted_p(spark, tests):
    rows = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(tests)], "i int, p double, q double").repartition(3)
    found = effects.benjamini_hochberg(rows, [], "p", ["i"]).collect()
    assert len(found) == len(tests) and all(r.p_fdr_bh == pytest.approx(r.q, abs=2e-8) and not r.significant for r in found)


def test_adjusted_p_by_family(spark):
    rows = spark.createDataFrame([(f, i, p, q) for f, tests in enumerate((DIRECTION, LATERALITY)) for i, (p, q) in enumerate(tests)], "f int, i int, p double, q double")
    assert all(r.p_fdr_bh == pytest.approx(r.q, abs=2e-8) for r in effects.benjamini_hochberg(rows, ["f"], "p", ["i"]).collect())


def test_consistency(spark):
    rows = spark.createDataFrame([(i, s, g) for i, x in enumerate(CONSISTENCY) for s, g in zip("AB", x, strict=False)], "i int, subject string, g double")
    found = {r.i: r for r in effects.subject_consistency(rows, ["i"], "subject", ("A", "B"), "g").collect()}
    assert all((found[i].same_direction, found[i].mean_g) == (same, pytest.approx(mean, abs=1e-8)) for i, (_, _, same, mean) in enumerate(CONSISTENCY))
    assert sum(r.same_direction for r in found.values()) == 10


def test_stable_effects(spark):
    rows = spark.createDataFrame([(i, s, g) for i, x in enumerate(STABLE) for s, g in zip("AB", x, strict=False)], "i int, subject string, g double")
    found = {r.i: r for r in effects.stable_effects(rows, ["i"], "subject", ("A", "B"), "g").collect()}
    for i, (_, _, same, mean, least) in enumerate(STABLE):
        assert (found[i].sign_consistent, found[i].mean_abs_g, found[i].conservative_abs_g) == (same, pytest.approx(mean, abs=1e-6), pytest.approx(least, abs=1e-6))


def test_confusion_measures(spark):
    cells = [(i, t, g, x[k]) for i, x in enumerate(CONFUSION) for k, (t, g) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))]
    rows = spark.createDataFrame(cells, "i int, t int, g int, n int").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    found = {r.i: r for r in evaluate.confusion_metrics(rows, ["i"], "t", "g").collect()}
    for i, x in enumerate(CONFUSION):
        r = found[i]
        assert (r.tn, r.fp, r.fn, r.tp) == x[:4]
        assert (r.accuracy, r.balanced_accuracy, r.sensitivity, r.specificity, r.f1, r.mcc) == pytest.approx(x[4:], abs=6e-9)
