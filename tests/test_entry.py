import subprocess
import sys

import __spark_entry__


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert {"image_id", "composition", "uri"} <= set(df.columns) and df.count() > 0


def test_names_are_paired():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_part():
    code = "import sys; sys.modules['sugarmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert 'annotate' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], capture_output=True).returncode == 0
