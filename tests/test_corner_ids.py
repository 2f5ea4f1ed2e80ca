import hashlib
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quartzframe.functions import identity
from quartzframe.functions.identity import corner_id


def cases():
    rng = random.Random(4)
    numbers = [0.0, -0.0, 0.5, 90.0, 1e-7, -1e-7, 5e-7, 1.5e-6, 0.0078125, -0.0078125, 12.3456785, 99e-6, 1e-4, 123456.7890123, 1e6, 999999.9999999, 1e15, 1e22, float("nan"), float("inf"), 0.1 + 0.2, 2.675]
    numbers += [rng.uniform(-2000, 2000) for _ in range(300)] + [rng.randrange(-(10**9), 10**9) / 1e6 for _ in range(300)] + [(2 * rng.randrange(10**6) + 1) / 128 for _ in range(100)]
    texts = ["line", "", None, 'a"b', "é", "back\\slash", "a\nb", "end\n", "\x7f", "a b~"]
    return [(i, [(x, rng.choice(numbers))] * (i % 3), texts[i % len(texts)]) for i, x in enumerate(numbers)]


def test_corner_ids_as_python_writes_them(spark):
    rows = spark.createDataFrame(cases(), "i int, c array<struct<x:double,y:double>>, t string")
    none = F.lit(None).cast("string")
    found = rows.select("i", corner_id(F.col("c")).alias("plain"), corner_id(F.col("c"), F.col("t"), none, digits=64).alias("named")).collect()
    digest = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    for (i, points, text), r in zip(cases(), sorted(found)):
        points = [[round(x, 6), round(y, 6)] for x, y in points]
        assert (r["plain"], r["named"]) == (digest(points)[:20], digest([text, None, points])), (i, points, text)


def test_a_number_is_written_once_a_batch(monkeypatch):
    """Each row's numbers were rounded and written one by one before."""
    rounded = []
    monkeypatch.setattr(identity, "round", lambda x, n: rounded.append(x) or round(x, n), raising=False)
    rows = pa.array([[{"x": 1.5, "y": float(i % 3)}] for i in range(1000)] + [None, []], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    found = identity._points_json.func(rows).to_pylist()
    assert found[:2] == ["[[1.5,0.0]]", "[[1.5,1.0]]"] and found[-2:] == [None, "[]"]
    assert sorted(rounded) == [0.0, 1.0, 1.5, 2.0]
