import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haulplan.functions.numbers import COARSE_BITS, ceil_log2, coarse_size, floor_log2, round_half_even
from haulplan.functions.rates import bytes_per_second, parse_rate
from haulplan.functions.text import human_bytes, human_rate, human_seconds


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row.y for row in rows.select("i", expression.alias("y")).orderBy("i").collect()]


def test_human_bytes_known_values(spark):
    values = [0, 1, 1023, 1024, 1152, 1536, 1024**2 - 1, 1024**2, 5 * 1024**4, 2**60, 2**62, -5]
    texts = ["0 B", "1 B", "1023 B", "1.00 KiB", "1.12 KiB", "1.50 KiB", "1024.00 KiB", "1.00 MiB", "5.00 TiB",
             "1024.00 PiB", "4096.00 PiB", "-5 B"]
    assert column(spark, values, "bigint", human_bytes("x")) == texts


def test_human_bytes_rounds_like_printf(spark):
    chance = random.Random(7)
    values = [chance.randrange(1024, 2 ** chance.randrange(11, 62)) for _ in range(3000)]
    values += [1024 * k + 128 * j for k in range(1, 60) for j in range(8)]  # exact ties
    got = column(spark, values, "bigint", human_bytes("x"))
    for value, text in zip(values, got):
        power = min((value.bit_length() - 1) // 10, 5)
        assert text == "%.2f %s" % (value / 1024**power, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"][power])


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_follows_the_binary_value(spark, digits):
    chance = random.Random(3)
    values = [100.0 * chance.randrange(n) / n for n in range(1, 4000)] + [i / 200 for i in range(20000)]
    assert column(spark, values, "double", round_half_even("x", digits)) == [float(round(v, digits)) for v in values]


def test_human_seconds(spark):
    cases = {
        0.0: "0s", 0.5: "0s", 1.5: "2s", 59.4: "59s", 60.0: "1m 0s", 61.0: "1m 1s", 3600.0: "1h 0s", 3605.0: "1h 0m 5s",
        86400.0: "1d 0s", 86401.0: "1d 0h 0m 1s", 90000.0: "1d 1h 0s", 86460.0: "1d 0h 1m 0s", -1.0: "n/a",
        float("inf"): "n/a", float("nan"): "n/a", 1e30: "n/a",
    }
    assert column(spark, list(cases), "double", human_seconds("x")) == list(cases.values())


def test_human_rate(spark):
    values = [1.25e9, 125_000.0, 0.0]
    assert column(spark, values, "double", human_rate("x")) == ["10.00 Gbps", "0.00 Gbps", "0.00 Gbps"]
    assert column(spark, values, "double", human_rate("x", "MBps")) == ["1250.00 MB/s", "0.12 MB/s", "0.00 MB/s"]


GOOD_RATES = {
    "10Gbps": 1.25e9, "1.5Gb/s": 1.875e8, "100MB/s": 1e8, "1GiB/s": 2.0**30, "1000KiB/s": 1024e3, "2MBPerSec": 2e6,
    " .5 Tbps ": 6.25e10, "8bps": 1.0, "3B/s": 3.0, "1Gbp/s": 1.25e8, "1PiB/s": 2.0**50,
}
BAD_RATES = ["10gbps", "5Gbit/s", "10", "", "Gbps", "5.Gbps", "1 Gb", "1e3MB/s", "-1MB/s"]


def test_rates(spark):
    assert column(spark, list(GOOD_RATES), "string", bytes_per_second(F.col("x"))) == list(GOOD_RATES.values())
    assert [parse_rate(text) for text in GOOD_RATES] == list(GOOD_RATES.values())
    assert column(spark, [None], "string", bytes_per_second(F.col("x"))) == [None]


@pytest.mark.parametrize("text", BAD_RATES)
def test_bad_rates_fail(spark, text):
    with pytest.raises(ValueError):
        parse_rate(text)
    with pytest.raises(PySparkException, match="not a rate"):
        column(spark, [text], "string", bytes_per_second(F.col("x")))


def test_logarithms_are_exact(spark):
    values = [v for e in range(1, 62) for v in (2**e - 1, 2**e, 2**e + 1)] + [-3, 0, 1]
    low = column(spark, values, "bigint", F.expr(floor_log2("x")))
    high = column(spark, values, "bigint", F.expr(ceil_log2("x")))
    assert low == [max(v, 1).bit_length() - 1 for v in values]
    assert high == [(v - 1).bit_length() if v >= 2 else 0 for v in values]


def test_coarse_size_is_ordered_and_fine(spark):
    chance = random.Random(5)
    values = sorted([chance.randrange(2 ** chance.randrange(1, 62)) for _ in range(2000)] + [-(2**40) - 1, -7, -1, 0, 8191])
    coarse = column(spark, values, "bigint", coarse_size("x"))
    assert coarse == sorted(coarse)
    for value, kept in zip(values, coarse):
        assert abs(kept) <= abs(value) < max(abs(kept) + 1, abs(kept) * (1 + 2**-COARSE_BITS))
        assert abs(value) >= 2 ** (COARSE_BITS + 1) or kept == value
