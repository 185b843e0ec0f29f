"""Every query with a DuckDB form agrees with it; the others return rows."""

import duckdb
import pytest

from tessera import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    got = Q.QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    if name not in Q.ORACLE:
        assert rows or name == "agentic_hits"  # this prose may hold nothing that an agent's rules match
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(Q.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert canon(got.columns, rows) == canon(want.columns, want.fetchall())
