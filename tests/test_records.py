from quartzframe.functions import schemas as sc
from quartzframe.operators import records as rec


def test_white_space_of_any_kind_is_no_text(spark):
    rows = spark.createDataFrame([("",), (" ",), ("\t\n",), ("  ",), (None,), (" a",), ("é",)], "v string")
    assert [r[0] for r in rows.select(sc.filled(rows["v"])).collect()] == [False] * 5 + [True] * 2


def test_a_candidate_without_an_audit_is_no_frame(spark):
    quad = lambda at: [{"x": at + x, "y": at + y} for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0))]
    rows = [(i, f"c{k}", 0.9 - 0.01 * k, quad(200.0 * k), flag) for i, flags in {1: (None, None), 2: (False, False), 3: (None, True)}.items() for k, flag in enumerate(flags)]
    df = spark.createDataFrame(rows, "i int, id string, s double, q array<struct<x:double,y:double>>, f boolean")
    assert {r["i"]: r["ambiguous"] for r in rec.ambiguous_primary(df, ["i"], "id", "s", "q", "f").collect()} == {1: True, 2: True, 3: False}
