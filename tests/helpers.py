import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def sorted_rows(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted_rows([r.asDict() for r in df.collect()], cols)


def duck_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    recs = [dict(zip(cols, r)) for r in rel.fetchall()]
    return sorted(cols), sorted_rows(recs, sorted(cols))


def assert_matches_oracle(spark_df, con, sql):
    c1, r1 = spark_rows(spark_df)
    c2, r2 = duck_rows(con, sql)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
