"""The registry, and that the core stands without the llm subpackage."""

import os
import re
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert not any(re.search(r"\bLIMIT\b", s, re.I) for n, s in sql.items() if re.match(r"p\d+_", n))


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('p8')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]") and int(out.split()[-2]) > 50
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as file:
                        assert "tessera.llm" not in file.read(), name
