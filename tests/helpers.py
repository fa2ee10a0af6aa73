"""What tests share."""

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted([tuple(map(repr, (r[n] for n in names))) for r in df.collect()])


def rows_in(relation):
    names = sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    return sorted([tuple(repr(r[i]) for i in at) for r in relation.fetchall()])
