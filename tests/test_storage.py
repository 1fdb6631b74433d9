"""Working tables of a run."""

from pathlib import Path

import pytest

from paysift.plans.queries import QUERIES
from paysift.storage import new_path, run_folder, write_table
from tests.conftest import SF


def place(path):
    return Path("/" + path.removeprefix("file:").lstrip("/"))


def test_a_run_removes_its_working_tables(spark):
    with run_folder(spark) as path:
        assert write_table(spark.range(5), "t").count() == 5 and new_path(spark, "x").startswith(path)
        with run_folder(spark) as inner:
            assert new_path(spark, "y").startswith(inner)
        before = len(list(place(path).iterdir()))
        assert QUERIES["tuned_thresholds"](spark, SF).count() == 1
        assert len(list(place(path).iterdir())) > before >= 1
    assert not place(path).exists()


def test_a_run_that_fails_does_too(spark):
    with pytest.raises(RuntimeError), run_folder(spark) as path:
        write_table(spark.range(5), "t")
        assert place(path).exists()
        raise RuntimeError
    assert not place(path).exists() and not new_path(spark, "x").startswith(path)
