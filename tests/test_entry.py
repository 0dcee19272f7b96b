"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "millrace/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'hygiene_by_source' in e.queries() and not any(x.startswith('op') for x in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
