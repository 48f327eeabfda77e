"""Small counts, whose abundances tie often, trimmed as the SQL trims them."""

import duckdb
import numpy as np
import pandas as pd

from modalens.plans import registry


def test_tmm_of_tied_abundances_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    samples, brands = 300, 30
    keep = rng.random((samples, brands)) < 0.9
    at, brand = np.nonzero(keep)
    pd.DataFrame({"l_suppkey": at, "l_partkey": brand, "l_quantity": rng.integers(1, 13, len(at)).astype(float)}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": np.arange(brands), "p_brand": [f"b{i:02d}" for i in range(brands)]}).to_parquet(tmp_path / "part.parquet")
    db = duckdb.connect()
    for name in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = dict(db.execute(registry.oracle_sql()["n1_tmm"]).fetchall())
    got = {r.sample_id: r.factor for r in registry.queries()["n1_tmm"](spark, str(tmp_path)).collect()}
    assert got == want
