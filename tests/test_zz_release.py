"""Runs last: what was materialised goes, and only once."""

import os

from tessella.plans.materialize import materialize, release


def test_release(spark):
    held = materialize(spark.range(5), "gone")
    path = held.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert held.count() == 5 and os.path.exists(path)
    assert release(spark) >= 1 and not os.path.exists(path) and release(spark) == 0
