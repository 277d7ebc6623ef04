import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CHECK = """
import __spark_entry__ as e
names = e.queries()
assert "win01_interval_merge" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_works_without_the_text_subpackage(tmp_path):
    """Both folders and the pipeline are really gone."""
    shutil.copytree(ROOT / "orbweave", tmp_path / "orbweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, check=True)


def test_a_broken_text_subpackage_is_an_error(tmp_path):
    shutil.copytree(ROOT / "orbweave", tmp_path / "orbweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "orbweave" / "llm").mkdir()
    (tmp_path / "orbweave" / "llm" / "__init__.py").touch()
    (tmp_path / "orbweave" / "llm" / "registry.py").write_text("import a_module_that_is_not_there\n")
    assert subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, capture_output=True).returncode != 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
