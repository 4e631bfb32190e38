import subprocess
import sys

import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"fts_search", "recall_current", "dedup_groups"} <= set(e.queries())


def test_flagship(spark):
    assert e.entry(spark).columns == ["rank", "id", "scope", "score"]


def test_entry_without_the_optional_parts():
    """Blocking the subpackage leaves the other queries."""
    code = "import sys; sys.modules['palimpsest.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=e.__file__.rsplit("/", 1)[0], check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "False"
