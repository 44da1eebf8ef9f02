import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from graphloom.plans import queries

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_imports_the_text_operators():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"graphloom\.llm|from graphloom import llm|corpus_pipeline", path.read_text()), path


def test_entry_without_the_text_operators():
    code = "import sys\nsys.modules['graphloom.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert [int(x) for x in out] == [len(queries.QUERIES), len(queries.SQL)]


def test_entry(spark):
    assert set(queries.SQL) == set(queries.QUERIES) <= set(__spark_entry__.queries())
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "score" in df.columns
