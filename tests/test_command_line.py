from ferrule.__main__ import main
from ferrule.operators import sinks

from .oracle import SF


def test_list_and_run(spark, tmp_path, capsys):
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out.split()
    main(["run", "keep_first_order", SF, f"{tmp_path}/o", "--format", "csv"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").columns == ["o_custkey", "o_orderkey", "o_totalprice"]


def test_split_and_report(spark, tmp_path):
    queries = spark.createDataFrame([(f"q{i}", f"text {i // 2}", "ab"[i % 2]) for i in range(40)], "query_id string, search_query string, level string")
    pairs = spark.createDataFrame([(f"q{i}", f"i{i % 7}") for i in range(40)], "query_id string, item_id string")
    corpus = spark.createDataFrame([(f"i{i}",) for i in range(6)], "item_id string")
    for name, df in (("queries", queries), ("pairs", pairs), ("corpus", corpus)):
        df.write.parquet(f"{tmp_path}/{name}")
    given = [x for n in ("queries", "pairs", "corpus") for x in (f"--{n}", f"{tmp_path}/{n}")] + ["--benchmark", f"{tmp_path}/queries", "--strata", "level", "--n", "8"]
    main(["split", *given, "--out", f"{tmp_path}/a", "--native-only"])
    main(["split", *given, "--out", f"{tmp_path}/b", "--exclude", f"{tmp_path}/a"])
    a, b = ({r.query_id: r for r in spark.read.parquet(f"{tmp_path}/{x}/queries").collect()} for x in "ab")
    assert len(a) == len(b) == 8 and not a.keys() & b.keys() and all(int(q[1:]) % 7 != 6 for q in a)
    assert len({r.search_query for r in b.values()}) == 8
    assert sinks.read_metadata(spark, f"{tmp_path}/a/metadata")["picked"] == 8
    pairs.selectExpr("*", "1 AS rank").write.parquet(f"{tmp_path}/found")
    main(["report", "--predictions", f"{tmp_path}/found", "--truth", f"{tmp_path}/pairs", "--segments", f"{tmp_path}/queries", "--out", f"{tmp_path}/r", "--columns", "level"])
    rows = spark.read.option("header", True).csv(f"{tmp_path}/r").collect()
    assert {(r.segment, r.value, r.n, r.recall) for r in rows} == {("ALL", None, "40", "1.0"), ("level", "a", "20", "1.0"), ("level", "b", "20", "1.0")}
