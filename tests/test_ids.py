from pyspark.sql import functions as F

from pairlab.functions.ids import drop_null_ids, normalise_id, stable_hash
from pairlab.operators import features
from pairlab.sources.tables import as_pairs


def ids(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(normalise_id(df, "x")).collect()]


def test_numbers_lose_their_fraction(spark):
    assert ids(spark, "double", [12.0, 12.9, -1.9, -0.5, None, float("nan"), 1e30, float("inf")]) == [
        "12", "12", "-1", "0", None, None, str(int(1e30)), None,
    ]
    assert ids(spark, "int", [12, None]) == ["12", None]
    assert ids(spark, "boolean", [True, False]) == ["1", "0"]


def test_text_is_stripped_of_every_white_space(spark):
    every = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
    assert len(every) == 29 and every.strip() == ""
    values = ["12.0", " x\t", " x　", "", None, every + "a b" + every, "​z"]
    assert ids(spark, "string", values) == [v.strip() if v is not None else None for v in values]


def test_rows_with_a_null_id_are_dropped(spark):
    df = spark.createDataFrame([(1.5, "a "), (None, "b"), (2.0, None)], "l double, r string")
    assert as_pairs(df, "l", "r").collect() == [("1", "a")]
    assert drop_null_ids(as_pairs(df, "l", "r")).count() == 1


def test_hash_depends_on_seed_and_text_only(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n bigint")
    got = [r[0] for r in df.orderBy("s").select(stable_hash(7, "s", "n")).collect()]
    assert got == [int(hashlib.md5(f"7|{s}|{n}".encode()).hexdigest()[:15], 16) for s, n in (("a", 1), ("b", 2))]
    assert df.select(stable_hash(8, "s", "n")).first()[0] not in got
    assert df.filter(F.col("s") == "a").select(stable_hash(7, "s", "n")).first()[0] == got[0]


def test_whole_numbers_keep_every_digit(spark):
    values = [0.0, -0.5, 12.9, -3.0, 2.0**53 + 2, 2.0**62, 2.0**63, -(2.0**63), 2.0**64, 1e19, 1e30, -1.5e37, 9.9e37, 1e38, 1.1e39, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.s for r in df.select("i", normalise_id(df, "v").alias("s")).collect()}
    want = {i: None if v is None or v != v or abs(v) >= 1e38 else str(int(v)) for i, v in enumerate(values)}
    assert got == want
    lost = {r.item: r.value for r in features.id_losses(df, ["v"]).collect()}
    assert lost == {"v_null": 1, "v_nan": 1, "v_unfit": 4}


def test_decimals_are_cut_to_whole_numbers(spark):
    df = spark.sql("select cast(x as decimal(38, 3)) as d from values ('-1.999'), ('12345678901234567890123456789.5'), (null) t(x)")
    assert [r[0] for r in df.select(normalise_id(df, "d")).collect()] == ["-1", "12345678901234567890123456789", None]
