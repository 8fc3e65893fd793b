import subprocess
import sys

HIDE = """
import sys, importlib.abc
class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in {roots!r} or name in {roots!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())
assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())
"""


def test_core_queries_without_corpus_parts_or_their_libraries():
    for roots in (("public_tokenizers",), ("sentencepiece",), ("corpus_pipeline", "tallyloom.llm")):
        subprocess.run([sys.executable, "-W", "ignore", "-c", HIDE.format(roots=roots)], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
