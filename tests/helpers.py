"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value that compares across engines."""
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def same(df, result) -> None:
    """df has the columns and, in any order, the rows of a DuckDB result."""
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    want = sorted(repr(tuple(plain(x) for x in r)) for r in result.fetchall())
    assert got == want
