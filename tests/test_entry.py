import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_optional_folder(tmp_path):
    ignore = shutil.ignore_patterns("llm", "tests", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'margin_decomposition' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_folder():
    for p in (ROOT / "provenant").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "provenant").parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", p.read_text()), p


def test_plans_push_down_and_never_cross(spark):
    """A filter and the needed columns reach the scan; no registered query multiplies tables row by row."""
    df = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity > 45").groupBy("l_returnflag").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") or name in ("pipeline", "logit_coefficients"):
            continue
        text = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text, name
        assert "Python" not in text and "Pandas" not in text, name
