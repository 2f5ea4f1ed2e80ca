import pytest

from quartzframe.sources import scratch
from quartzframe.sources.versions import VersionConflictError, VersionedTable
from quartzframe.streaming import transactions as tr

QUAD = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
MOVED = [[1.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
REQUEST = f"annotation_id string, image_id string, run_id string, algorithm_boundary_corners {tr.CORNERS}, boundary_corners {tr.CORNERS}, confirmation_duration_ms long"


def values(df):
    return sorted(r[0] for r in df.collect())


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.publish(spark.range(3)) == 0
    old = t.read()
    assert t.rewrite(lambda df: df.selectExpr("id + 10 AS id")) == 1
    assert values(old) == [0, 1, 2] and values(t.read()) == [10, 11, 12] and values(t.read(0)) == [0, 1, 2]
    with pytest.raises(Exception, match="torn"):
        t.rewrite(lambda df: df.selectExpr("IF(id = 12, raise_error('torn')::bigint, id) AS id"))
    assert values(t.read()) == [10, 11, 12] and t.versions() == [0, 1]
    assert len(t.vacuum(1)) == 2 and t.versions() == [1] and values(t.read()) == [10, 11, 12]


def test_two_writers(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(1))

    def slow(df, n=[0]):
        n[0] += 1
        if n[0] == 1:  # another writer is faster
            VersionedTable(spark, t.path).publish(spark.range(5, 7))
        return df.selectExpr("id * 2 AS id")

    assert t.rewrite(slow) == 2 and values(t.read()) == [10, 12]
    with pytest.raises(VersionConflictError):
        t.publish(spark.range(1), expected=1)


def test_publish_never_overwrites(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    assert scratch.publish(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c")
    assert not scratch.publish(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c")
    assert (tmp_path / "c").read_text() == "a" and (tmp_path / "b").exists()


def requests(spark, *rows):
    return spark.createDataFrame([(a, i, r, QUAD, q, 5) for a, i, r, q in rows], REQUEST)


def both(tables):
    return sorted(map(repr, tables.feedback().collect())), sorted(map(repr, tables.annotations().collect()))


@pytest.mark.parametrize("stop", [tr.PREPARED, "ANNOTATION", tr.STORED, tr.DONE])
def test_broken_off_between_any_phases(spark, tmp_path, stop):
    first, second = requests(spark, ("a1", "i1", "r", MOVED), ("a2", "i2", "r", QUAD)), requests(spark, ("a2", "i2", "r", QUAD), ("a3", "i3", "r", MOVED))
    plain = tr.Confirmations(spark, f"file://{tmp_path}/plain")
    for n, batch in enumerate((first, second)):
        plain.commit(batch, n)

    def between(phase):
        if phase == stop:
            raise KeyboardInterrupt

    torn = tr.Confirmations(spark, f"file://{tmp_path}/torn", between)
    again = tr.Confirmations(spark, torn.path)
    for n, batch in enumerate((first, second)):
        with pytest.raises(KeyboardInterrupt):
            torn.commit(batch, n)
        again.commit(batch, n)
        again.commit(batch, n)
    assert both(again) == both(plain)
    assert [r["confirmation"] for r in plain.annotations().orderBy("annotation_id").collect()] == ["adjusted", "accepted", "adjusted"]
    assert plain.feedback().count() == 9 and again.recover() == 0


def stopped(spark, path, phase, batch, epoch=0):
    def between(p):
        if p == phase:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        tr.Confirmations(spark, path, between).commit(batch, epoch)
    return tr.Confirmations(spark, path)


def phases(tables):
    return sorted((r["annotation_id"], r["transaction_phase"]) for r in tables.feedback().collect())


def test_recovery_without_the_batch(spark, tmp_path):
    stored = stopped(spark, f"file://{tmp_path}/a", tr.STORED, requests(spark, ("a1", "i1", "r", MOVED)))
    assert stored.recover() == 1 and phases(stored) == [("a1", tr.STORED), ("a1", tr.DONE), ("a1", tr.PREPARED)]
    assert stored.recover() == 0
    absent = stopped(spark, f"file://{tmp_path}/b", "ANNOTATION", requests(spark, ("a1", "i1", "r", MOVED)))
    assert absent.recover() == 1 and phases(absent) == [("a1", tr.ABORTED), ("a1", tr.PREPARED)] and absent.annotations().count() == 0


def test_conflicts(spark, tmp_path):
    tables = tr.Confirmations(spark, f"file://{tmp_path}/a")
    tables.commit(requests(spark, ("a1", "i1", "r", MOVED)), 0)
    with pytest.raises(tr.ConfirmationConflictError, match="a1"):
        tables.commit(requests(spark, ("a1", "i1", "r", QUAD)), 1)
    assert tables.recover() == 0  # the first of that id is done, and the other was refused
    other = tr.Confirmations(spark, f"file://{tmp_path}/b")
    other.commit(requests(spark, ("a1", "i1", "r", MOVED)), 0)
    stopped(spark, other.path, "ANNOTATION", requests(spark, ("a2", "i2", "r", QUAD)), 1)
    with pytest.raises(tr.ConfirmationConflictError, match="a2"):
        other.recover()  # its run has stored another annotation
    twice = tr.Confirmations(spark, f"file://{tmp_path}/c")
    with pytest.raises(tr.ConfirmationConflictError):
        twice.commit(requests(spark, ("a1", "i1", "r", MOVED), ("a1", "i1", "r", QUAD)), 0)
