import pytest
from pyspark.sql import functions as F

from keysift.functions import bounded
from keysift.options import INT_BOUNDS, ScanOptions, bounded_float, bounded_int

RAW = ["5", " 7 ", "50", "51", "0", "-1", "999999999", "99999999999999999999", "x", "", "3.5", "+4",
       None]


def test_out_of_range_falls_back():
    assert bounded_int("999999999", 5, 1, 50) == 5
    assert bounded_int("abc", 5, 1, 50) == 5
    assert bounded_int("50", 5, 1, 50) == 50
    assert bounded_float("1.0", 2.0, 1.1, 10.0) == 2.0
    assert bounded_float("nan", 2.0, 1.1, 10.0) == 2.0
    assert bounded_float("1.5", 2.0, 1.1, 10.0) == 1.5


@pytest.mark.parametrize("name", sorted(INT_BOUNDS))
def test_defaults_lie_in_bounds(name):
    default, lowest, highest = INT_BOUNDS[name]
    assert lowest <= default <= highest


def test_column_form_equals_plain_form(spark):
    df = spark.createDataFrame([(r,) for r in RAW], "raw STRING")
    got = df.select(
        "raw", bounded.bounded_int(F.col("raw"), 5, 1, 50).alias("i"),
        bounded.bounded_float(F.col("raw"), 2.0, 1.1, 10.0).alias("f"))
    for r in got.collect():
        assert r["i"] == bounded_int(r["raw"], 5, 1, 50), r
        assert r["f"] == bounded_float(r["raw"], 2.0, 1.1, 10.0), r


def test_options_from_environment():
    env = {"MAX_FILE_SIZE_MB": "5", "LOCAL_SCAN_MAX_DEPTH": "-100", "DEDUPLICATION_ENABLED": "false",
           "ENABLE_GIT_BLAME": "true", "SCAN_MODE": "incremental", "BASELINE_FILE": "b.json",
           "TARGET_ORG": "acme"}
    options = ScanOptions.from_env(env, scanner_version="9")
    assert (options.max_file_size_mb, options.max_depth) == (5, 10)
    assert (options.deduplicate, options.attach_blame, options.incremental) == (False, True, True)
    assert (options.baseline_path, options.organization) == ("b.json", "acme")
    assert options.scanner_version == "9"
    assert ScanOptions.from_env({}).deduplicate
