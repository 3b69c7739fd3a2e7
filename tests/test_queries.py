"""Registered queries against their SQL, at the smallest size."""

import itertools
import random

import duckdb
import pytest

from boxloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(frame):
    def text(v):
        if isinstance(v, float):
            return "None" if v != v else f"{v:.8g}"
        return str([text(x) for x in v]) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    assert shown(QUERIES[name](spark, SF).toPandas()) == shown(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_area_slices_add_up_as_their_sql(spark, tmp_path):
    """Four boxes of a mean area of 0.01 to the digit: whether their doubles add up to less depends on the order."""
    rng, lineitem = random.Random(6), []
    even = [s for s in itertools.combinations_with_replacement(range(62, 162, 2), 4) if sum(x * x for x in s) == 40000]
    split = [s for s in even if len({_added(p) < 0.01 for p in itertools.permutations(s)}) == 2]
    assert split
    for key in range(1, 301):
        sides = rng.sample(rng.choice(split), 4)
        for n, (part, side) in enumerate(zip(sorted(rng.sample(range(1, 20000), 4)), sides, strict=True)):
            lineitem.append((key, part, rng.randrange(1, 1000), n + 1, 10.0, "N", (side - 60) / 2))
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_quantity double"
    spark.createDataFrame(lineitem, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in [*range(1, 311), 310]], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("eval_slices", "reference_swap"):
        asked = con.execute(ORACLES[name])
        columns = [c[0] for c in asked.description]
        want = sorted(asked.fetchall(), key=repr)
        assert sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=repr) == want, name


def _added(sides):
    total = 0.0
    for side in sides:  # one by one: sum() of Python 3.12 and later makes up for lost digits
        total += side * side / 1e6
    return total / len(sides)
