import os

from grammarlens import session


def test_what_was_staged_is_deleted_when_it_is_done_with(spark):
    with session.discarded(spark):
        df = session.staged(spark.range(5), "numbers")
        assert df.count() == 5
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
    kept = session.staged(spark.range(3), "numbers")
    with session.discarded(spark):
        pass
    assert kept.count() == 3
