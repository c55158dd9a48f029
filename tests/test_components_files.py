import os

from weftline import session
from weftline.operators.components import _shortcut


def test_rounds_of_shortcuts_leave_one_table_and_tidy_the_driver(spark, monkeypatch):
    session.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    monkeypatch.setattr(session, "_tidied", 0.0)
    out = _shortcut(spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "node long, parent long"))
    assert len(set(os.listdir(folder)) - before) == 1 and session._tidied > 0
    assert {r["parent"] for r in out.collect()} == {0}
