"""The entry point works without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/millrace", tmp_path / "millrace",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(q) > 170 and set(o) <= set(q); "
            "assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q)")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr


def test_a_broken_operator_is_not_hidden(tmp_path):
    shutil.copytree(f"{ROOT}/millrace", tmp_path / "millrace",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path,
                         capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode != 0 and "no_such_library" in run.stderr
