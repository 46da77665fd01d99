import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"


def shown(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    n, sql, more = out.stdout.split()
    return int(n), int(sql), more == "True"


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "review_trust"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    return tmp_path


@pytest.mark.parametrize("case", ["folders gone", "folder empty", "library missing"])
def test_other_queries_stay(copy, case):
    own = len(__import__("review_trust.plans.queries", fromlist=["QUERIES"]).QUERIES)
    if case == "library missing":
        (copy / "tiktoken.py").write_text("raise ModuleNotFoundError('tiktoken')")
    else:
        shutil.rmtree(copy / "review_trust" / "llm", ignore_errors=True)
        if case == "folders gone":
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        else:
            (copy / "review_trust" / "llm" / "__pycache__").mkdir(parents=True)
    n, sql, more = shown(copy)
    assert n == own and sql == own and not more


def test_every_own_query_has_sql():
    from review_trust.plans.oracles import oracles
    from review_trust.plans.queries import QUERIES

    assert oracles().keys() == QUERIES.keys()
