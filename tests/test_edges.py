"""Every core query over empty tables, and over tables whose rows are null in every column or repeated."""

import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.plans import catalog

SOURCE = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SOURCE), reason="no test tables")


def make(folder: Path, kind: str) -> str:
    folder.mkdir()
    for p in Path(SOURCE).glob("*.parquet"):
        t = pq.read_table(p)
        nulls = pa.table([pa.nulls(2, f.type) for f in t.schema], schema=t.schema)
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "null":
            t = nulls
        else:
            t = pa.concat_tables([t, nulls, t.slice(0, 40), t])
            for extra in ("bucket", "rank", "year", "e", "n", "level", "__day", "owner"):
                t = t.append_column(extra, pa.array(["x"] * t.num_rows))
        pq.write_table(t, folder / p.name)
    return str(folder)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    return {k: make(base / k, k) for k in ("empty", "null", "mixed")}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_rows_and_null_rows(spark, tables, name):
    for kind in ("empty", "null"):
        catalog.QUERIES[name](spark, tables[kind]).collect()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.endswith("_found")])
def test_nulls_repeats_and_extra_columns_change_nothing(spark, tables, name):
    plain = {tuple(r) for r in catalog.QUERIES[name](spark, SOURCE).collect()}
    mixed = [tuple(r) for r in catalog.QUERIES[name](spark, tables["mixed"]).collect()]
    assert {r for r in mixed if any(x not in (None, "", "/") for x in r[:2])} == plain
    assert len(mixed) == len(set(mixed))
