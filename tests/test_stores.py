"""Readers and the store of results."""

from cohortwave.sources import stores


def test_results_are_kept_by_parameters(spark, tmp_path):
    table, a = str(tmp_path / "store"), {"band": [1, 2], "seed": 3}
    assert stores.read_result(spark, table, a) is None and stores.read_params_compatible(spark, table, a) is None
    stores.write_result(spark.range(3), table, a)
    stores.write_result(spark.range(9), table, {"seed": 3, "band": [1, 2]})
    stores.write_result(spark.range(5), table, {"band": [1, 2], "seed": 4, "extra": "x"})
    assert stores.read_result(spark, table, a).count() == 3 and stores.read_result(spark, table, {"seed": 9}) is None
    assert stores.read_params_compatible(spark, table, {"band": [1, 2]}).count() == 5
    assert stores.read_params_compatible(spark, table, {"seed": 3, "extra": "x"}) is None
    assert stores.read_params_compatible(spark, table, {"seed": 3, "extra": "x"}, strict=False).count() == 3


def test_clinical_files_are_chosen_by_name(spark, tmp_path):
    for name in ("ace_1.csv", "ACE_Appendix.csv", "mace.csv"):
        (tmp_path / name).write_text("subject,score\n1,NaN\n2,4.5\n")
    rows = stores.read_clinical(spark, str(tmp_path), "subject long, score double", "*[aA][cC][eE]_*.csv").collect()
    assert sorted((r.subject, r.score) for r in rows) == [(1, None), (2, 4.5)]


def test_samples_are_read_by_subject(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.createDataFrame([(s, st, t, float(t)) for s in range(6) for st in ("open", "closed") for t in range(4)], "subject long, state string, t_idx long, x double").write.partitionBy("state").parquet(path)
    assert stores.read_samples(spark, path, state="open", first=2).count() == 8
    assert stores.read_samples(spark, path, subjects=spark.createDataFrame([(5,), (5,), (7,)], "subject long")).count() == 8
