"""The driver's contract: every query has a name, and those with SQL give its rows."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_library_does_not_need_the_subpackage():
    code = (
        "import importlib.abc, sys\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'skein.llm') or name.startswith('skein.llm.'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 60 and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for top, _, files in os.walk(os.path.join(ROOT, "skein")):
        if "llm" in top.split(os.sep):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(top, name), encoding="utf-8") as file:
                    assert "skein.llm" not in file.read()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are elsewhere")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
