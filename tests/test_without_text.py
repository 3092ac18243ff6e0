import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e, bench, tests.test_catalogue
names = e.queries()
assert names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_all_else_imports_without_the_text_operators(tmp_path):
    for name in ("pairwright", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{os.environ.get('PYTHONPATH', '')}"}
    for extra in ((), ("corpus_pipeline.py",)):
        for name in extra:
            shutil.copy(ROOT / name, tmp_path / name)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
