"""What operators write between jobs can be removed, and only that."""

from __future__ import annotations

import os

from veriframe.functions.runtime import checkpointed, clear, run_folder, shared_folder, table_name


def test_clear(spark):
    session = spark.newSession()  # its catalogue's tables are those of all sessions; its frames are its own
    kept = checkpointed(session.range(5))
    assert kept.count() == 5
    mine, other = table_name(session, "Some-Rows"), "veriframe_other_rows"
    session.range(3).write.option("path", shared_folder(session, "rows")).saveAsTable(mine)
    session.range(2).write.saveAsTable(other)
    folder = run_folder(session).removeprefix("file://")
    assert os.path.isdir(folder) and clear(session) >= 1 and not os.path.exists(folder)
    names = {t.name for t in session.catalog.listTables()}
    assert mine not in names and other in names
    session.sql(f"DROP TABLE {other}")
    assert clear(session) == 0
