"""What test modules import; conftest modules hold fixtures only."""
SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    """Sorted plain tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
