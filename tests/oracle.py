"""Runs a query in Spark and its SQL in DuckDB and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def compare(spark, sf_dir, query, sql, con):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert sorted(cols) == names, (cols, names)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (len(bad), bad[:2])
    return len(ours)
