import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
assert set(entry.oracle_sql()) == set(entry.queries()) and len(entry.queries()) > 50
"""


def test_base_queries_stand_without_the_corpus_operators():
    for name in ("ahocorasick", "manyvote.llm"):
        subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT, check=True)
