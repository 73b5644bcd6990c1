"""Shared storage for intermediate tables, and functions that travel to workers."""

import subprocess
import sys
from pathlib import Path

import pytest

from urbanframe import session

ROOT = Path(__file__).resolve().parents[1]


class _Cluster:
    """A session that looks like a cluster's: another master, nothing named."""

    def __init__(self, spark):
        self._spark, self.conf = spark, self
        self._jvm, self._jsc, self.sparkContext = spark._jvm, spark._jsc, self
        self.master = "spark://elsewhere:7077"

    def getCheckpointDir(self):
        return None

    def get(self, key, default=None):
        return default if key == "spark.checkpoint.dir" else self._spark.conf.get(key)


def test_a_local_folder_is_refused_on_a_cluster(spark):
    with pytest.raises(ValueError, match="shared storage"):
        session.checkpoint_dir(_Cluster(spark))


def test_no_machine_local_temp_folder_in_the_package():
    assert not [p for p in (ROOT / "urbanframe").rglob("*.py") if "tempfile" in p.read_text()]


def test_intermediate_folders_can_be_removed(spark):
    kept = session._written.pop(spark.sparkContext.applicationId, [])
    table = session.materialize(spark.range(3), "t")
    folder = Path(session._written[spark.sparkContext.applicationId][0].removeprefix("file:"))
    assert table.count() == 3 and folder.exists()
    assert session.remove_intermediate(spark) == 1 and not folder.exists()
    session._written[spark.sparkContext.applicationId] = kept


def test_a_scope_owns_its_tables_and_keeps_what_it_is_told(spark):
    def folder(table):
        return Path(table._intermediate_path.removeprefix("file:"))

    with session.Intermediates(spark) as outer:
        with session.Intermediates(spark) as inner:
            first, second, result = (session.materialize(spark.range(n), "t") for n in (1, 2, 3))
            path = session.owned_path(spark, "plain-files")
            spark.range(2).write.csv(path)
            session.release(first)
            assert not folder(first).exists() and folder(second).exists()
            inner.keep(result)
        assert not folder(second).exists() and not Path(path.removeprefix("file:")).exists()
        assert result.count() == 3  # it now belongs to the outer block
        outer.keep(result)
    assert result.count() == 3
    session.release(result)
    assert not folder(result).exists()
    with pytest.raises(RuntimeError), session.Intermediates(spark):
        lost = session.materialize(spark.range(4), "t")
        raise RuntimeError
    assert not folder(lost).exists()


def test_workers_that_cannot_import_the_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "from urbanframe.session import build_session\n"
        "from urbanframe.functions.udfs import time_of_day_udf\n"
        "spark = build_session('local[1]', extra={'spark.driver.memory': '1g'})\n"
        "df = spark.createDataFrame([('0930',), ('3000000000',)], 't string')\n"
        "print([r[0] for r in df.select(time_of_day_udf('t')).collect()])\n"
    )
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "['Morning', None]" in out.stdout, out.stderr[-1500:]
