"""The driver's contract, with and without the optional modules."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest
from ordwell.plans import registry


def test_names_and_oracles():
    names = entry.queries()
    assert set(registry.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert "e1_cluster_merge" in names and len(registry.QUERIES) > 130


def test_optional_modules(tmp_path, monkeypatch):
    assert entry._optional("no_such_module") is None
    assert entry._optional("ordwell.no_such") is None
    (tmp_path / "broken_one.py").write_text("import not_there_at_all\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_one")


def test_one_name_one_query():
    with pytest.raises(ValueError):
        registry.query("e1_cluster_merge")(lambda s, d: None)


def test_without_the_corpus_folders(tmp_path):
    """The rest works when ordwell/llm and tests/llm go, with corpus_pipeline.py there or not."""
    root = Path(entry.__file__).resolve().parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'e1_cluster_merge' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(o) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
