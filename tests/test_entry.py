"""The driver's contract without the llm folders, and with ones that fail."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=False)


def test_entry_without_the_llm_folders(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "tidewell"), here / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), here)
    done = imported(here, "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op')], len(q)")
    assert done.returncode == 0, done.stderr
    # a folder that is there, but fails, is no missing one
    (here / "tidewell" / "llm").mkdir()
    (here / "tidewell" / "llm" / "__init__.py").write_text("")
    (here / "tidewell" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = imported(here, "import __spark_entry__")
    assert done.returncode != 0 and "no_such_module" in done.stderr
