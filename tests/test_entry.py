"""The entry works without its optional parts, whichever of them are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [["cotejo/llm"], ["cotejo/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_entry(tmp_path, gone):
    shutil.copytree(HERE / "cotejo", tmp_path / "cotejo", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    there = (HERE / "cotejo" / "llm").exists() and "cotejo/llm" not in gone
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, n_llm, pipeline = said.stdout.split()
    assert int(n) >= 57 and (int(n_llm) > 0) == there and (pipeline == "True") == (there and (HERE / "corpus_pipeline.py").exists() and "corpus_pipeline.py" not in gone)
