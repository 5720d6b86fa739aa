"""Cleaning, splits, samples, weights, coverage, medians, imputing, scaling."""

import datetime
import random
import statistics
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarebird.functions.columns import code_name, lenient_double
from rarebird.functions.hashing import key_hash
from rarebird.operators import coverage as cov
from rarebird.functions.ordering import place, with_place
from rarebird.operators import impute, medians, profile, sample, sketches, split, standardise, vectors, weights
from rarebird.settings import COUNTRY_NAMES, SECTOR_NAMES
from rarebird.sources import observations

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    schema = (
        "emis_id bigint, company string, note string, year int, `odd.name` float, small smallint,"
        " exact decimal(10,2), flag boolean, day date, main_label int"
    )
    day = datetime.date(2020, 1, 1)
    rows = [
        (1, "a", "x", 2016, 1.5, 1, Decimal("1.25"), True, day, 0),
        (2, "b", "7", 2018, NAN, 2, None, False, day, 1),
        (3, "c", None, None, None, None, Decimal("2.5"), None, None, None),
    ]
    return spark.createDataFrame(rows, schema)


def test_roles(mixed):
    roles = {f.name: observations.role_of(f) for f in mixed.schema.fields}
    assert roles == {
        "emis_id": "id", "company": "id", "note": "text", "year": "feature",
        "odd.name": "feature", "small": "feature", "exact": "feature", "flag": "feature",
        "day": "other", "main_label": "label",
    }
    present = {r.column: r.non_null for r in observations.column_roles(mixed).collect()}
    assert present["note"] == 2 and present["main_label"] == 2 and present["emis_id"] == 3


def test_clean(mixed):
    cleaned = observations.clean(mixed, keep=("emis_id",))
    assert cleaned.columns == [
        "emis_id", "year", "odd.name", "small", "exact", "flag", "main_label",
    ]
    assert {t for c, t in cleaned.dtypes if c != "emis_id"} == {"double"}
    rows = {r.emis_id: r for r in cleaned.collect()}
    assert rows[1]["odd.name"] == 1.5 and rows[1].flag == 1.0 and rows[1].exact == 1.25
    assert rows[2]["odd.name"] is None  # NaN is missing
    assert observations.labelled(cleaned).count() == 2
    assert observations.feature_columns(cleaned) == ["year", "odd.name", "small", "exact", "flag"]


def test_clean_reads_numbers_from_text(mixed):
    notes = [r.note for r in observations.clean(mixed, text="cast").orderBy("year").collect()]
    assert sorted(notes, key=str) == [7.0, None, None]
    with pytest.raises(ValueError):
        observations.clean(mixed, text="guess")


def test_lenient_double(spark):
    good = {"1": 1.0, " 2.5 ": 2.5, "-3e2": -300.0, ".5": 0.5, "4.": 4.0, "+1E-1": 0.1}
    bad = ["", " ", "1d", "2f", "0x1p3", "1_000", "1,5", "abc", "--1", "1 2", None]
    table = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r.t: r.v for r in table.select("t", lenient_double(F.col("t")).alias("v")).collect()}
    assert got == {**good, **dict.fromkeys(bad)}
    odd = spark.createDataFrame([("inf",), ("-Infinity",), ("NaN",)], "t string")
    values = [r.v for r in odd.select(lenient_double(F.col("t")).alias("v")).collect()]
    assert values[0] == float("inf") and values[1] == float("-inf") and np.isnan(values[2])


def test_code_names(spark):
    codes = spark.createDataFrame([(0,), (3,), (9,), (None,)], "country int")
    names = [r[0] for r in codes.select(code_name(F.col("country"), COUNTRY_NAMES)).collect()]
    assert names == ["CZ (Czech Republic)", "SK (Slovakia)", "9", None]
    assert len(SECTOR_NAMES) == 6


def test_distribution_keeps_unknown_and_null(spark):
    table = spark.createDataFrame([(0,), (0,), (9,), (None,)], "country int")
    rows = [tuple(r) for r in profile.country_distribution(table).collect()]
    assert rows == [
        (None, None, 1, 25.0), (0, "CZ (Czech Republic)", 2, 50.0), (9, "9", 1, 25.0),
    ]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(20_000).select(
        (F.col("id") % 5000).alias("emis_id"),
        (F.lit(2010) + F.floor(F.col("id") / 5000)).cast("int").alias("year"),
    )


KEYS = ["emis_id", "year"]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_does_not_depend_on_partitions(keyed):
    results = [rows_of(split.hash_split(keyed.repartition(n), KEYS)) for n in (1, 4, 8)]
    assert results[0] == results[1] == results[2]
    share = sum(r[2] == "train" for r in results[0]) / len(results[0])
    assert abs(share - 0.8) < 0.02


def test_split_loses_no_row_with_missing_keys(spark):
    table = spark.createDataFrame([(None, 2010), (1, None), (None, None)], "emis_id int, year int")
    assert split.hash_split(table, KEYS).where("split IS NOT NULL").count() == 3


def test_different_keys_are_told_apart(spark):
    rows = [("1-2", "3"), ("1", "2-3"), (None, "7"), ("7", None), ("-", "7"), ("", "7"), ("1:7", ""), (None, None)]
    table = spark.createDataFrame(rows, "emis_id string, year string")
    assert table.select(key_hash(KEYS)).distinct().count() == len(rows)


def test_sample_and_split_are_independent(keyed):
    drawn = split.hash_split(sample.hash_sample(keyed, KEYS, 0.1), KEYS)
    counts = {r.split: r["count"] for r in drawn.groupBy("split").count().collect()}
    assert abs(counts["train"] / sum(counts.values()) - 0.8) < 0.05


def test_fraction_outside_means_all(keyed):
    for fraction in (0.0, 1.0, 1.5, -1.0):
        assert sample.hash_sample(keyed, KEYS, fraction).count() == keyed.count()


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("n", [1, 777, 19_999, 20_000])
def test_exact_sample(keyed, n, digits):
    drawn = rows_of(sample.exact_sample(keyed, KEYS, n, digits))
    again = rows_of(sample.exact_sample(keyed.repartition(3), KEYS, n, digits))
    assert len(set(drawn)) == n and drawn == again


def test_exact_sample_bounds(keyed):
    assert sample.exact_sample(keyed, KEYS, 50_000).count() == 20_000
    assert sample.exact_sample(keyed, KEYS, 0).count() == 0
    small = set(rows_of(sample.exact_sample(keyed, KEYS, 100)))
    assert small < set(rows_of(sample.exact_sample(keyed, KEYS, 200)))


def test_exact_sample_of_hot_keys_and_alike_rows(spark):
    hot = spark.range(9000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id")
    alike = spark.range(9000).selectExpr("IF(id % 3 = 0, null, id % 7) AS k")
    for table in (hot, alike):
        for n in (1, 500, 3000, 5999, 9000):
            drawn = [tuple(r) for r in sample.exact_sample(table, ["k"], n).collect()]
            assert len(drawn) == n
            again = [tuple(r) for r in sample.exact_sample(table.repartition(3), ["k"], n, listed=1).collect()]
            key = lambda r: tuple((v is None, v or 0) for v in r)
            assert sorted(drawn, key=key) == sorted(again, key=key)


def test_temporal_split(spark):
    table = spark.createDataFrame([(1, 2017), (2, 2018), (3, None)], "id int, year int")
    assert rows_of(split.temporal_split(table)) == [(1, "train"), (2, "test")]
    assert [tuple(r) for r in split.split_profile(table).collect()] == [
        (2017, "train", 1), (2018, "test", 1),
    ]


def test_class_weights(spark):
    table = spark.createDataFrame([(1.0,)] + [(0.0,)] * 9, "main_label double")
    assert weights.fit_class_weights(table) == weights.ClassWeights(10 / 18, 5.0)
    weighted = weights.fit_class_weights(table).apply(table)
    assert weighted.agg(F.sum("classWeight")).first()[0] == pytest.approx(10.0)
    healthy = spark.createDataFrame([(0.0,)] * 4, "main_label double")
    assert weights.fit_class_weights(healthy) == weights.ClassWeights(0.5, 2.0)


def test_coverage(spark):
    rows = [(1.0, None, NAN), (2.0, None, 1.0), (3.0, 1.0, NAN), (None, None, NAN)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.feature: (r.n, r.non_null, r.share) for r in cov.coverage(table, "abc").collect()}
    assert got == {"a": (4, 3, 0.75), "b": (4, 1, 0.25), "c": (4, 1, 0.25)}
    assert cov.fit_features(table, list("abc"), 0.3) == ["a"]
    assert cov.fit_features(table, list("cba"), 0.25) == ["c", "b", "a"]
    assert cov.fit_features(table.limit(0), list("abc")) == ["a", "b", "c"]


def median_table(spark):
    pick = random.Random(4)
    rows = []
    for i in range(6001):
        rows.append((
            pick.lognormvariate(0, 6),                       # heavy tail
            float(pick.randrange(5)),                        # many equal values
            7.0 if i % 3 else pick.gauss(7, 1),              # one hot value
            pick.gauss(0, 1) if i % 2 else None,             # half missing
            NAN if i % 5 else pick.gauss(0, 1),              # NaN is missing
            float(i >= 3001),                                # median at a jump
            float("inf") if i % 2 else -1.0,                 # infinities
            0.0 if i < 3000 else float(i),                   # hot value next to the middle
        ))
    names = ["tail", "steps", "hot", "gaps", "nans", "jump", "infinite", "edge"]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names, rows


@pytest.mark.parametrize("rows_used", [6001, 6000, 3, 2, 1])
@pytest.mark.parametrize("digit_bits", [12, 20, 5])
def test_exact_medians(spark, rows_used, digit_bits):
    table, names, rows = median_table(spark)
    if rows_used < 6001:
        table = spark.createDataFrame(rows[:rows_used], table.schema)
    got = medians.fit_exact_medians(table, names, digit_bits)
    for i, name in enumerate(names):
        values = [r[i] for r in rows[:rows_used] if r[i] is not None and r[i] == r[i]]
        if values:
            assert got[name] == pytest.approx(statistics.median(values), rel=1e-15), name
        else:
            assert name not in got


AWKWARD_DOUBLES = [
    0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, -2.2250738585072014e-308,
    1.0, -1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 1.9999999999999998, 1.7976931348623157e308, -1e308,
    float("inf"), float("-inf"), 3.0, -3.0, 1e22, 123456.789, 8.98846567431158e307,
]


def test_ordered_integers(spark):
    pick = random.Random(8)
    values = AWKWARD_DOUBLES + [struct.unpack(">d", pick.randbytes(8))[0] for _ in range(20_000)]
    values += [2.0**e * (1 + d * 2.0**-52) for e in range(-1022, 1023) for d in (0, 1, 2**52 - 1)]
    values = [v for v in values if v == v]
    table = spark.createDataFrame([(v,) for v in values], "value double")
    got = with_place(table, "value", "o").collect()
    assert all(r.o == place(r.value) for r in got) and len(got) == len(values)
    by_place = sorted(values, key=place)
    assert all(a <= b for a, b in zip(by_place, by_place[1:]))


def test_exact_medians_of_awkward_doubles(spark):
    pick = random.Random(2)
    columns = [[pick.choice(AWKWARD_DOUBLES) for _ in range(31)] for _ in range(12)]
    columns += [[5e-324] * 10 + [0.0] * 10 + [1e-323] * 11, [1.0, 1.0000000000000002] * 15 + [0.9999999999999999]]
    names = [f"f{i}" for i in range(len(columns))]
    table = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{n} double" for n in names))
    for digit_bits in (1, 12):
        assert medians.fit_exact_medians(table, names, digit_bits) == {n: statistics.median(c) for n, c in zip(names, columns)}


def test_approximate_medians(spark):
    table, names, rows = median_table(spark)
    got = medians.fit_approximate_medians(table, names, error=0.01)
    for i, name in enumerate(names):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        below = sum(v < got[name] for v in values) / len(values)
        upto = sum(v <= got[name] for v in values) / len(values)
        assert below - 0.011 <= 0.5 <= upto + 0.011, name


def test_sketches_of_any_set_of_groups(spark):
    pick = random.Random(6)
    rows = [(pick.choice([2001, 2002, 2003, None]), pick.gauss(0, 1), float(pick.randrange(3)), NAN) for _ in range(20_000)]
    rows += [(2001, None, 1.0, None)] * 5
    table = spark.createDataFrame(rows, "year int, a double, `b.c` double, none double")
    stored = sketches.value_sketches(table.repartition(4), ["a", "b.c", "none"], ["year"])
    held = {(r.year, r.feature): r.n for r in stored.collect()}
    assert held[2001, "b.c"] == held[2001, "a"] + 5 and {f for _, f in held} == {"a", "b.c"} and len(held) == 8
    bound = sketches.rank_error()
    for years in ([2001], [2001, 2003], [2001, 2002, 2003]):
        together = sketches.merged(stored.where(F.col("year").isin(years)))
        for r in sketches.quantiles(together, [0.1, 0.5, 0.9]).collect():
            values = [row[1 if r.feature == "a" else 2] for row in rows if row[0] in years]
            values = [v for v in values if v is not None]
            assert r.n == len(values)
            for share, value in zip((0.1, 0.5, 0.9), r.value):
                below, upto = (sum(test(v) for v in values) / r.n for test in (lambda v: v < value, lambda v: v <= value))
                assert below - bound <= share <= upto + bound


def test_missing_values(spark):
    rows = [(1.0,), (2.0,), (NAN,), (4.0,), (None,), (7.0,)]
    table = spark.createDataFrame(rows, "a double")
    assert medians.fit_exact_medians(table, ["a"]) == {"a": 3.0}
    filled = impute.fill_missing(table, {"a": 3.0})
    assert [r.a for r in filled.collect()] == [1.0, 2.0, 3.0, 4.0, 3.0, 7.0]
    model = impute.median_imputer(["a"]).fit(table)
    assert model.transform(table).where("a__imp = 2.0").count() == 3  # not interpolated
    assert impute.complete_rows(table, ["a"]).count() == 4
    assert [r.n_missing for r in impute.missing_features(table, ["a"]).collect()] == [
        0, 0, 1, 0, 1, 0,
    ]


def test_scaling_relationally_and_by_stage(spark):
    pick = random.Random(2)
    rows = [(pick.gauss(5, 3), pick.random() * 1e6, 5.0) for _ in range(500)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    stats = standardise.fit_scaler(table, ["a", "b", "c"])
    plain = np.array([list(r) for r in standardise.standardise(table, stats).collect()])
    joined = vectors.assembler(["a", "b", "c"]).transform(table)
    staged = vectors.scaler().fit(joined).transform(joined)
    by_stage = np.array([r.scaled.toArray() for r in staged.select("scaled").collect()])
    assert np.allclose(plain, by_stage, atol=1e-12)
    assert (plain[:, 2] == 0).all()


def test_components_and_covariance(spark):
    pick = np.random.default_rng(3)
    data = pick.normal(size=(400, 6)) @ pick.normal(size=(6, 6))
    names = [f"x{i}" for i in range(6)]
    schema = ", ".join(f"{n} double" for n in names)
    table = vectors.assembler(names).transform(spark.createDataFrame(data.tolist(), schema))
    cov_rows = vectors.covariance(table, "features", names).collect()
    want = np.cov(data.T)
    assert len(cov_rows) == 21
    for r in cov_rows:
        assert r.covariance == pytest.approx(want[int(r.feature_a[1]), int(r.feature_b[1])])
    scaled = vectors.scaler().fit(table).transform(table)
    model = vectors.principal_components(6, k=50).fit(scaled)
    basis = model.pc.toArray()
    assert basis.shape == (6, 6)  # k is cut to the number of features
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-9)
    spread = np.linalg.eigvalsh(np.corrcoef(data.T))[::-1]
    shares = vectors.explained_variance(model, table).orderBy("component").collect()
    assert np.allclose([r.share for r in shares], spread / spread.sum(), atol=1e-9)
    assert shares[-1].cumulative == pytest.approx(1.0)


def test_constant_feature_has_no_covariance(spark):
    table = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    joined = vectors.assembler(["a", "b"]).transform(table)
    got = {(r.feature_a, r.feature_b): r.covariance
           for r in vectors.covariance(joined, "features", ["a", "b"]).collect()}
    assert got["a", "b"] == 0.0 and got["b", "b"] == 0.0
    assert got["a", "a"] == pytest.approx(7 / 3)


def test_rank_errors(spark):
    rows = [(float(i), 1.0 if i < 90 else float(i), None) for i in range(101)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    got = medians.rank_errors(table, {"a": 50.0, "b": 1.0, "c": 0.0})
    errors = {r.feature: (r.n, r.error) for r in got.collect()}
    assert errors == {"a": (101, 0.0), "b": (101, 0.0)}  # c has no value
    off = medians.rank_errors(table, {"a": 80.0}).first()
    assert off.error == pytest.approx(80 / 101 - 0.5)


def test_poorly_covered(spark):
    rows = [(1.0, 1.0 if i == 0 else None, NAN) for i in range(10)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    dropped = cov.poorly_covered(table, ["a", "b", "c"], min_share=0.1).collect()
    assert [tuple(r) for r in dropped] == [("c", 10, 0, 1.0)]
