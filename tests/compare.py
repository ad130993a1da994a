"""Comparison of a Spark result with a DuckDB one: columns by name, rows in any order."""

from __future__ import annotations


def plain(value: object) -> str:
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(tuple(map(plain, r)) for r in relation.query("r", f"select {names} from r").fetchall())


def same(df, con, sql: str) -> None:
    ours, theirs = spark_rows(df), duck_rows(con, sql)
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
