import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_is_read_without_a_session():
    """The driver reads queries() before it makes a session."""
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    n, m, inside = got.stdout.split()[-3:]
    assert int(n) > 80 and int(m) > 70 and inside == "True"


def test_without_the_corpus_part(tmp_path):
    """With the corpus operators deleted the rest is still read and runs."""
    import shutil

    for name in ("plumbline", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print('match_argmax' in q, any(n.startswith('op') for n in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK", "HOME", "PATH"))})
    assert got.returncode == 0, got.stderr
    assert got.stdout.split()[-3:] == ["True", "False", "False"]


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [(r.az, r.off) for r in rows] == [(45, 10)]
