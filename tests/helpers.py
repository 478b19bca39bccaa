"""What tests share."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps"


def cell(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return [cell(v) for v in value] if isinstance(value, list | tuple) else value


def rows_of(names, rows):
    """Rows as sorted texts, columns by name."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([cell(r[k]) for k in order]) for r in rows)


def assert_same(spark_rows, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(spark_rows.columns) == sorted(names)
    got, wanted = rows_of(spark_rows.columns, [tuple(r) for r in spark_rows.collect()]), rows_of(names, found.fetchall())
    assert got == wanted
