"""Command line: ``python -m ferrule list | run | split | report``.  Tables are folders of Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, sinks, split
from .plans import catalog, stages  # noqa: F401  stages adds its queries


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ferrule")
    by = out.add_subparsers(dest="command", required=True)
    by.add_parser("list", help="names of the queries over the test tables")
    run = by.add_parser("run", help="writes the rows of a query")
    run.add_argument("name")
    run.add_argument("tables", help="folder of the tables")
    run.add_argument("out")
    run.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    hold = by.add_parser("split", help="holds queries out by strata")
    for name in ("queries", "pairs", "corpus", "benchmark", "out"):
        hold.add_argument(f"--{name}", required=True)
    hold.add_argument("--strata", nargs="+", default=split.STRATA)
    hold.add_argument("--n", type=int, default=5000)
    hold.add_argument("--seed", type=int, default=13)
    hold.add_argument("--text", default="search_query")
    hold.add_argument("--exclude", nargs="*", default=[], help="folders of earlier splits")
    hold.add_argument("--native-only", action="store_true", help="only sessions whose items are all in the corpus")
    say = by.add_parser("report", help="recall of predictions, by segments")
    for name in ("predictions", "truth", "segments", "out"):
        say.add_argument(f"--{name}", required=True)
    say.add_argument("--columns", nargs="+", required=True)
    say.add_argument("--k", type=int, default=metrics.K)
    return out


def make_split(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """The held-out queries and pairs and the evaluation corpus, and how the strata were met."""
    queries, pairs, corpus, bench = (spark.read.parquet(x) for x in (a.queries, a.pairs, a.corpus, a.benchmark))
    pool = split.exclude(queries, [spark.read.parquet(f"{x}/queries") for x in a.exclude], "query_id")
    if a.native_only:
        pool = pool.join(split.native_only(pairs, corpus, "query_id", "item_id"), "query_id", "left_semi")
    targets = split.targets(bench, a.strata, a.n)
    picked = sinks.write_parquet(split.stratified_pick(pool, targets, a.strata, "query_id", a.text, a.seed), f"{a.out}/queries")
    parts = split.load(queries, pairs, picked, corpus, "query_id", "item_id")
    out = {"queries": picked, "pairs": sinks.write_parquet(parts.val_pairs, f"{a.out}/pairs"), "corpus": sinks.write_parquet(parts.corpus, f"{a.out}/corpus")}
    out["strata"] = sinks.write_parquet(split.diagnostics(picked, targets, a.strata), f"{a.out}/strata")
    sinks.write_metadata({"n": a.n, "seed": a.seed, "exclude": a.exclude, "native_only": a.native_only, "picked": picked.count()}, spark, f"{a.out}/metadata")
    return out


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    if a.command == "run":
        rows = catalog.QUERIES[a.name](spark, a.tables)
        rows.write.mode("overwrite").format(a.format).options(**({"header": True} if a.format == "csv" else {})).save(a.out)
    elif a.command == "split":
        make_split(spark, a)
    else:
        per = metrics.recall_per_query(spark.read.parquet(a.predictions), spark.read.parquet(a.truth), "query_id", "item_id", k=a.k)
        rows = metrics.recall_report(per, spark.read.parquet(a.segments), "query_id", a.columns)
        sinks.write_csv(rows.withColumn("recall", F.round("recall", 6)), a.out)


if __name__ == "__main__":
    main()
