"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tracelake.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        x = float(x)
        return None if math.isnan(x) else round(x, 5)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.SQL])
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_cpu_sets_of_the_whole_view(spark):
    got = sorted(map(tuple, Q.QUERIES["k20_cpu_sets_whole"](spark, SF).select("module", "addr", "cpus").collect()), key=repr)
    rows = Q.Views(spark, SF).fx_probe_addr.select("module", "addr").collect()
    want = [(r["module"], r["addr"], ",".join(dict.fromkeys(str(c) for c in (*range(r["addr"] % 7, r["addr"] % 7 + 3), r["addr"] % 5)))) for r in rows]
    assert len({r["addr"] % 10 for r in rows}) > 1 and got == sorted(want, key=repr)


def test_findings_of_the_whole_tree(spark):
    def walk(rules, row, path=""):
        for r in rules:
            try:
                on = eval(r.precondition, {}, row)
            except TypeError:  # a null figure
                on = False
            if on:
                if r.finding:
                    yield path + r.name, r.finding.format(**row)
                yield from walk(r.sub_rules, row, f"{path}{r.name}/")

    want = [(c["collection_id"], *x) for c in Q.context(Q.Views(spark, SF)).collect() for x in walk(Q.L.RULES, Q.L.CONFIG | c.asDict())]
    got = [tuple(r) for r in Q.QUERIES["l4_findings_whole"](spark, SF).select("collection_id", "path", "finding").collect()]
    assert sorted(got) == sorted(want) and {p for _, p, _ in got} - {"diagnosis/OFF-CPU", "diagnosis/ON-CPU"}


def test_entry_imports_without_llm(spark):
    """The driver may delete the training-data subpackage; the entry must still list the rest."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(f"{repo}/tracelake", f"{d}/tracelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{repo}/__spark_entry__.py", d)
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=d, env=os.environ | {"PYTHONPATH": d}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(Q.QUERIES)
