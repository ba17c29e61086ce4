"""Run a query and its oracle and compare them as bags of rows."""

from __future__ import annotations

import collections
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def kind(type_name: str) -> str:
    name = type_name.lower()
    if "int" in name or name == "long":
        return "int"
    if name in ("double", "float"):
        return "float"
    if name in ("string", "varchar"):
        return "text"
    return name


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def differences(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_types = {d[0]: kind(str(d[1])) for d in cur.description}
    o_rows = cur.fetchall()
    s_types = {f.name: kind(f.dataType.typeName()) for f in df.schema}
    problems = []
    if sorted(o_cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(o_cols)}"]
    if s_types != o_types:
        problems.append(f"types {s_types} against {o_types}")
    order = sorted(o_cols)
    index = {c: i for i, c in enumerate(o_cols)}
    ours = collections.Counter(tuple(cell(r[c]) for c in order) for r in df.collect())
    theirs = collections.Counter(tuple(cell(r[index[c]]) for c in order) for r in o_rows)
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        problems.append(
            f"rows {sum(ours.values())} against {sum(theirs.values())}; only here "
            f"{str(list(only_ours)[:2])[:600]}; only there {str(list(only_theirs)[:2])[:600]}"
        )
    return problems
