import ast
import math
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from lectern.llm import queries, toxicity

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def compare(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(map(repr, (tuple(r[x] for x in cols) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_oracles(spark):
    for name in queries.ORACLE_SQL:
        compare(spark, name)


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names


def test_nothing_outside_imports_llm():
    for f in [*ROOT.glob("lectern/**/*.py"), ROOT / "bench.py"]:
        if "llm" in f.parts or not f.exists():
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f


def plain_score(model, text):
    """The highest window's sum over all its subsequences, one by one."""
    from itertools import combinations

    sym, windows, _ = toxicity.symbols([text])
    long = dict(zip(model.long.codes.tolist(), model.long.weights.tolist(), strict=True))
    sums = []
    for a, b in windows.tolist():
        total = 0.0
        for p in range(a, b):
            reach = range(p + 1, min(p + toxicity.SPAN, len(sym)))
            for more, table, factor in ((toxicity.ORDER - 1, model.weights, 1.0), (toxicity.ORDER, long, toxicity.LONGER)):
                for rest in combinations(reach, more):
                    places = (p, *rest)
                    if all(sym[q] for q in places):
                        code = 0
                        for q in places:
                            code = code << toxicity.BITS | int(sym[q])
                        w = table.get(code, 0.0) if isinstance(table, dict) else float(table[code])
                        total += w * factor * toxicity.DECAY ** (places[-1] - p + 1)
        sums.append(total + model.per_symbol * (b - a) + model.bias)
    score = 1 / (1 + math.exp(-min(30, max(-30, model.slope * max(sums) + model.offset))))
    assert abs(score - model.scores([text])[0]) < 1e-3
    return score


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its brute-force form, on its own input."""
    from tests.llm.test_dedup import WS, brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {"documents": docs.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
        current.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = current.collect()
        if name != "packing":
            assert current.columns == docs.columns
    assert len(rows["documents"]) >= len(rows["toxicity"]) > 0.8 * len(rows["documents"])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    stayed = {r.doc_id for r in rows["toxicity"]}
    short = sorted(rows["documents"], key=lambda r: len(r.text))[:25]
    for r in short:
        assert (plain_score(model, r.text) < 0.3) == (r.doc_id in stayed)
    assert {WS.sub("", r.text) for r in rows["toxicity"]} == {WS.sub("", r.text) for r in rows["exact_dedup"]}
    assert len(rows["exact_dedup"]) == len({WS.sub("", r.text) for r in rows["toxicity"]})
    want = brute_components(rows["exact_dedup"])
    assert {r.doc_id for r in rows["near_dedup"]} == {i for i, (_, c) in want.items() if i == c}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    want = Counter(i for (i,) in c.sql(f"SELECT doc_id FROM ({queries.mix_sql(100)})").fetchall())
    assert Counter(r.doc_id for r in rows["mixing"]) == want
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["mixing"]}
    assert len(corpus_pipeline.STAGES) == 5
