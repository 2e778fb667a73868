"""The entry: every query is listed, and all but the training-data ones are there without their subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    from procflow import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 150


def test_entry_without_the_training_data_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['procflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'g07_commands' in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
