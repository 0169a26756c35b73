import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_part(tmp_path):
    """The entry imports and lists its other queries where the subpackage and the pipeline are gone."""
    import shutil

    for name in ("quillspark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quillspark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a3_nunique' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
