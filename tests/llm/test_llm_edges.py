import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries

SOURCE = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not (os.path.exists(SOURCE) and os.path.exists(queries.TOKENIZERS)), reason="no test tables")


def make(folder, kind):
    folder.mkdir()
    for name in ("documents", "eval_items", "signals"):
        t = pq.read_table(f"{SOURCE}/{name}.parquet")
        nulls = pa.table([pa.nulls(2, f.type) for f in t.schema], schema=t.schema)
        t = {"empty": t.slice(0, 0), "null": nulls, "mixed": pa.concat_tables([t, nulls, t.slice(0, 30)])}[kind]
        for extra in ("ids", "restored", "reason", "share", "k", "s", "n"):
            t = t.append_column(extra, pa.array(["x"] * t.num_rows, pa.string()))
        pq.write_table(t, folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_null_and_repeated_rows(spark, tmp_path, name):
    for kind in ("empty", "null"):
        rows = queries.QUERIES[name](spark, make(tmp_path / kind, kind)).collect()
        assert kind == "null" or not rows
    mixed = queries.QUERIES[name](spark, make(tmp_path / "mixed", "mixed")).collect()
    plain = queries.QUERIES[name](spark, SOURCE).collect()
    names = [c for c in ("doc_id", "item_id", "run_day", "strategy_key", "symbol", "signal_name") if c in (plain[0].asDict() if plain else {})]
    key = lambda rows: {tuple(r[c] for c in names) for r in rows if r[0] is not None}
    assert key(mixed) == key(plain)
    if name.endswith("_found"):
        assert len(mixed) == len(plain)
