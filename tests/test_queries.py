"""Every registered query of the core against its SQL on the smallest tables.

Queries of the optional training-data subpackage are compared in ``tests/llm``.
"""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare, database
from checks.registry import QUERIES
from govlens.plans import detections as D
from govlens.plans.reports import REPORTS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert re.match(r"(ok|rows only)", result := compare(spark, con, name, SF_DIR)), result


def test_every_report_and_detection_is_registered():
    names = set(entry.queries())
    assert len(REPORTS) == 65 and len(D.DETECTIONS) == 11
    assert names >= set(QUERIES) >= set(REPORTS) | set(D.DETECTIONS)
    assert set(entry.oracle_sql()) <= names


def test_flagship(spark):
    assert "user" in entry.entry(spark).columns
