import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from memloom.operators import search
from memloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def by_sql(query, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return sorted(con.execute(SQL[query]).fetchall())


def test_bm25_top10_asks_whole_items(spark, tmp_path):
    rnd = random.Random(3)
    some = [f"{rnd.choice(['gate', 'run', 'fli', 'note', 'x_'])}{i}{rnd.choice(['', 's', 'ies', 'ing', 'ed'])}" for i in range(150)]
    texts = [" ".join(rnd.choices(some, k=rnd.randint(0, 40))) if i % 19 else None for i in range(300)] + ["quokka"]
    items = [" ".join(rnd.choices(some, k=k)) for k in (0, 5, 14, 15, 40, 90, 400)] + [None, " ".join(f"absent{i}" for i in range(30)) + " Quokkas"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "source": ["s"] * len(texts), "lang": ["en"] * len(texts), "text": pa.array(texts, pa.string())}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": range(len(items)), "text": pa.array(items, pa.string())}), f"{tmp_path}/benchmark.parquet")
    got = QUERIES["bm25_top10"](spark, str(tmp_path)).select("query_id", "id", "score", "rank").collect()
    # A word that follows thirty others is asked as well.
    assert [r.id for r in got if r.query_id == 8] == [300]
    assert sorted(map(tuple, got)) == by_sql("bm25_top10", tmp_path)
    # The same to the last place, where a score's fifth place is a five.
    got = QUERIES["bm25_top10"](spark, SF).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == by_sql("bm25_top10", SF)


def test_long_questions_are_met_in_parts(spark, monkeypatch):
    rnd = random.Random(9)
    pairs = [(q, f"t{t}") for q in range(12) for t in rnd.sample(range(60), rnd.choice([1, 20, 60]))]
    asked = search.Asked(pairs)
    held = [sorted(rnd.sample(range(len(asked.terms)), rnd.choice([0, 1, 30]))) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([70] * 50), pa.array(held, pa.list_(pa.int32())), pa.array([[2] * len(h) for h in held], pa.list_(pa.int32()))], names=["id", "dl", "t", "c"])
    one = search.Prepared(asked, None, np.linspace(1, 3, len(asked.terms)), 60.0, None)
    (whole,) = one.cells([batch])
    monkeypatch.setattr(search, "SHARED", 100)
    parts = list(one.cells([batch]))
    assert [i for ids, _, _ in parts for i in ids.to_pylist()] == list(range(50))
    assert all(len(ids) == 1 or n.sum() <= 100 for ids, _, n in parts) and len(parts) > 20
    assert all((np.concatenate(x) == y).all() for x, y in zip(list(zip(*parts))[1:], whole[1:]))
    # Blocks hold fewer questions where these are long; no question is lost or split.
    monkeypatch.setattr(search, "STEMS", 40)
    blocks = search.asked_blocks(spark.createDataFrame(pairs, "query_id int, term string"))
    assert sorted(q for b in blocks for q in b.names) == list(range(12)) and len(blocks) > 3
    assert sum(int(b.n.sum()) for b in blocks) == len(pairs)
