import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 100 and rows.columns == ["vec_id", "query_id", "rank", "sim", "source", "lang"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_nothing_else_imports_the_llm_operators():
    for p in ROOT.glob("framelake/**/*.py"):
        if "llm" not in p.relative_to(ROOT / "framelake").parts:
            assert not re.search(r"framelake\.llm|from framelake import llm", p.read_text()), p


def test_works_without_the_llm_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "framelake", tmp_path / "framelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries() if k[2:3].isdigit() or k == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False"], out.stderr
