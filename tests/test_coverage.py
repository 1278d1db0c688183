"""Every SURVEY §2 operator id maps to a registered catalogue query."""

import re

from tally.plans import catalogue  # noqa: F401
from tally.plans.registry import ORACLE, QUERIES, SURVEY_ID

EXPECTED = (
    [f"S{i}" for i in range(1, 12)] + [f"P{i}" for i in range(1, 11)] + [f"E{i}" for i in range(1, 21)]
    + [f"J{i}" for i in range(1, 7)] + [f"U{i}" for i in range(1, 4)] + [f"A{i}" for i in range(1, 14)]
    + [f"R{i}" for i in range(1, 6)] + [f"W{i}" for i in range(1, 6)] + [f"M{i}" for i in range(1, 22)]
    + [f"L{i}" for i in range(1, 11)]
)


def test_every_operator_registered():
    covered = {x for ids in SURVEY_ID.values() for x in ids.split()}
    missing = [x for x in EXPECTED if x not in covered]
    assert not missing, missing


def test_query_names_plain():
    for n in QUERIES:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", n) and not re.match(r"op\d+_", n)
    assert set(ORACLE) <= set(QUERIES)


def test_sinks_exist():
    from tally.sources import sinks
    assert callable(sinks.write_splits) and callable(sinks.write_report) and callable(sinks.run)


def test_checkpoint_dir_is_stable(spark):
    from tally.session import checkpoint_dir
    a = checkpoint_dir(spark)
    b = checkpoint_dir(spark)
    assert a == b
