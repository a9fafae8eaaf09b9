"""Run registered queries next to their SQL twins. Also a command line tool:

python tests/oracle.py SF_DIR [name ...]

TEST_CONF=key=value,... sets session options for a run.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def make_session(shared: str, cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftline")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for setting in filter(None, os.environ.get("TEST_CONF", "").split(",")):
        spark.conf.set(*setting.split("="))
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def compare(spark_df, con, sql: str) -> tuple[int, str | None]:
    """Row count, and the first difference if there is one."""
    columns = sorted(spark_df.columns)
    got = Counter(tuple(r) for r in spark_df.select(*columns).collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return 0, f"columns {columns} != {sorted(relation.columns)}"
    picked = ", ".join(f'"{c}"' for c in columns)
    want = Counter(
        tuple(_plain(v) for v in r) for r in relation.project(picked).fetchall()
    )
    n = sum(got.values())
    if got == want:
        return n, None
    return n, (
        f"{n} rows against {sum(want.values())}; "
        f"only in Spark {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"
    )


def main() -> None:
    from siftline.plans.registry import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = make_session(tempfile.mkdtemp(prefix="siftline-")), duck(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                rows, problem = compare(df, con, ORACLES[name])
            else:
                rows, problem = df.count(), None
        except Exception as failure:
            rows, problem = 0, f"{type(failure).__name__}: {str(failure)[:1500]}"
        bad += problem is not None or rows == 0
        state = "ok" if problem is None and rows else "BAD"
        print(f"{state:4}{name:26}{rows:8}{time.time() - began:8.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(names)}")


if __name__ == "__main__":
    main()
