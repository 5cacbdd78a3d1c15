from pyspark.sql import functions as F

from pairlab.operators import folds


def labelled(spark, n=203):
    return spark.range(n).select(
        F.col("id").cast("string").alias("left_id"),
        (F.col("id") % 7).cast("string").alias("right_id"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def test_each_row_in_one_fold_whatever_the_partitioning(spark):
    df = labelled(spark)
    a = sorted(folds.assign_folds(df, 5, 42).collect())
    b = sorted(folds.assign_folds(df.repartition(11), 5, 42, bits=4).collect())
    assert a == b and len(a) == 203
    sizes = [sum(r.fold == f for r in a) for f in range(5)]
    assert sizes == [41, 41, 41, 40, 40]
    assert a != sorted(folds.assign_folds(df, 5, 43).collect())


def test_copies_may_part(spark, pairs_of):
    df = pairs_of([("a", "1", 1)] * 40 + [("b", "2", 1)], label=True)
    rows = folds.assign_folds(df, 4, 1, unique=False).collect()
    assert len(rows) == 41
    assert {r.fold for r in rows if r.left_id == "a"} == {0, 1, 2, 3}


def test_summary_views_and_parts(spark):
    split = folds.assign_folds(labelled(spark), 5, 42)
    for row in folds.fold_summary(split).collect():
        val, train = folds.val_part(split, row.fold), folds.train_part(split, row.fold)
        assert row.val_pos == val.filter("label = 1").count() and row.val_neg == val.filter("label = 0").count()
        assert row.train_pos == train.filter("label = 1").count() and row.train_neg == train.filter("label = 0").count()
    views = folds.fold_views(split, 5)
    assert views.count() == 5 * 203 and views.filter("part = 'val'").count() == 203
    assert views.filter("part = 'val' and run <> fold").count() == 0


def test_leaks_are_found(pairs_of):
    pos = pairs_of([("a", "1"), ("b", "2")])
    neg = pairs_of([("a", "1"), ("c", "3")])
    assert folds.check_overlap(pos, neg).collect() == [("a", "1")]
    split = folds.label_union(pos, neg).withColumn("fold", F.when(F.col("label") == 1, 0).otherwise(1))
    assert folds.check_fold_leak(split, pos).collect() == [(1, 2, 1)]
    assert folds.pairs_in_several_folds(split).collect() == [("a", "1")]
