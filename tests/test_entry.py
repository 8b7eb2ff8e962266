import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["run", "source_language", "target_language", "sentences", "hits", "misses", "occurrences", "served", "added"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_subpackage():
    code = (
        "import sys; sys.modules['foliant.llm'] = None\n"
        "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 50 and not any(n.startswith('op1_') for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
