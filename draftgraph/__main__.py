"""Commands over tables of drawings; run with spark-submit or ``python -m draftgraph``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .operators import evaluate, validate
from .plans import extract
from .sources import drawings, pdf, readers, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="draftgraph")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *options: tuple):
        sub = commands.add_parser(name, help=help)
        for o in options:
            sub.add_argument(o[0], **(o[1] if len(o) > 1 else {"required": True}))
        return sub

    command("extract", "paths and text blocks (Parquet) to documents", ("--paths",), ("--texts",), ("--out",), ("--config", {}), ("--format", {"default": "json"}))
    command("pdf", "PDF files to paths and text blocks", ("--folder",), ("--out",), ("--page", {"type": int}), ("--max-plans", {"type": int}))
    command("check", "errors of documents", ("--documents",))
    command("references", "cross-reference statistics of documents", ("--documents",))
    command("evaluate", "walls against marked drawings", ("--walls",), ("--marks",), ("--perp-tol", {"type": float, "default": 6.0}), ("--parallel-tol", {"type": float, "default": 5.0}))
    command("benchmark", "the same over a batch, with wider tolerances", ("--walls",), ("--marks",), ("--perp-tol", {"type": float, "default": 12.0}), ("--parallel-tol", {"type": float, "default": 10.0}))
    command("report", "summary of documents", ("--documents",), ("--out",))
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"draftgraph {a.command}").getOrCreate()
    if a.command == "extract":
        config = Config.from_yaml(a.config) if a.config else DEFAULT
        paths, blocks = spark.read.parquet(a.paths), spark.read.parquet(a.texts)
        name = F.concat(F.lit("plan-"), F.col("plan_id").cast("string"))
        plans = paths.groupBy("plan_id").agg(F.max(F.greatest("x0", "x1")).alias("width"), F.max(F.greatest("y0", "y1")).alias("height")).select("plan_id", name.alias("source_pdf"), "width", "height")
        docs, errors = extract.run(paths, blocks, plans, config)
        valid, invalid = validate.split_valid(docs, errors)
        sinks.write_documents(valid, a.out, a.format)
        return 1 if sinks.write_invalid(invalid, f"{a.out.rstrip('/')}-invalid") else 0
    if a.command == "pdf":
        pages = pdf.read_pages(readers.plan_files(spark, a.folder, most=a.max_plans), a.page).withColumn("plan_id", F.abs(F.xxhash64("plan")))
        d = pages.filter("error IS NULL").select("plan_id", F.col("height").alias("page_height"), F.posexplode("drawings").alias("ord", "d")).select("plan_id", "ord", "d.*", "page_height", F.lit(0).alias("page_num"))
        drawings.paths_of(d).write.mode("overwrite").parquet(f"{a.out}/paths")
        t = pages.filter("error IS NULL").select("plan_id", "height", F.posexplode("texts").alias("ord", "t"))
        box = F.col("t.bbox")
        t.select("plan_id", "ord", "t.text", box[0].alias("bx0"), (F.col("height") - box[3]).alias("by0"), box[2].alias("bx1"), (F.col("height") - box[1]).alias("by1"), F.lit(0).alias("page_num")).write.mode("overwrite").parquet(f"{a.out}/texts")
        pages.select("plan", "plan_id", F.coalesce("error", F.lit("ok")).alias("status")).write.mode("overwrite").parquet(f"{a.out}/runs")
        return 0
    if a.command in ("evaluate", "benchmark"):
        walls, marks = spark.read.parquet(a.walls), spark.read.parquet(a.marks)
        scores = evaluate.wall_scores(evaluate.claim(evaluate.claim_candidates(walls, marks, a.perp_tol, a.parallel_tol)), walls, marks)
        print(sinks.markdown(scores, "Walls") + "\n" + sinks.markdown(evaluate.macro_average(scores), "Averages"))
        return 0
    docs = readers.documents(spark, a.documents)
    if a.command == "check":
        errors = validate.validate(docs)
        print(sinks.markdown(errors, "Errors"))
        return 1 if errors.limit(1).count() else 0
    if a.command == "references":
        x = docs.select("plan_id", F.posexplode("cross_references").alias("ord", "x")).select("plan_id", "ord", F.lit(0).alias("k"), "x.source_text_region_id", "x.target_sheet", "x.target_detail")
        r = docs.select("plan_id", F.explode("text_regions").alias("r")).select("plan_id", "r.text_region_id", "r.text", "r.classification")
        rows = evaluate.enriched_references(x, r)
        print(sinks.markdown(evaluate.corpus_references(rows), "Corpus") + "\n" + sinks.markdown(evaluate.shared_targets(rows), "Shared targets"))
        return 0
    summary = evaluate.document_summary(docs)
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(sinks.markdown(summary.select("plan_id", *[c for c in summary.columns if c.startswith("n_")]), "Drawings") + "\n" + sinks.markdown(evaluate.coverage(summary), "Coverage"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
