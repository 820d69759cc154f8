"""Command lines: ``python -m pagemill.cli ask|sweep|probe|ocr-bench|db ...``. Each prints a report and gives an exit code."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import service
from pagemill.operators import answering, ocrbench, pages, retrieval
from pagemill.plugins import EMBEDDERS, RERANKERS, Extractive
from pagemill.sources import files
from pagemill.sources.tables import read_table


def _service(spark: SparkSession, args: argparse.Namespace) -> service.Service:
    """A service over a data directory, whose chunks are embedded as they are asked for."""
    embedder = EMBEDDERS[args.embedder]()
    documents = read_table(spark, args.data, "documents")
    chunks = pages.latest(read_table(spark, args.data, "chunks").select("id", "document_id", "page_no", "char_start", "char_end", "text", "embed_text", "created_at"), ["id"], "created_at")
    named = documents.select(F.col("id").alias("document_id"), "filename")
    points = embedder.embed(chunks.withColumnRenamed("id", "chunk_id").join(named, "document_id", "left"), "embed_text").withColumn("model", F.lit(embedder.model_id))
    collections = spark.createDataFrame([("pages_main", embedder.model_id, embedder.dim)], "name string, model string, dim int")
    runs = spark.createDataFrame([], "document_id string, stage string, status string, attempt int")
    return service.Service(
        spark, documents, read_table(spark, args.data, "document_pages"), runs, points, collections, embedder=embedder, reranker=RERANKERS[args.reranker](), generator=Extractive(),
        threshold=args.threshold)


def ask(spark: SparkSession, args: argparse.Namespace) -> int:
    s = _service(spark, args)
    if args.retrieval_only:
        rows = answering.candidate_details(s.retrieve(args.question, args.document_id).withColumn("question", F.lit(args.question))).collect()
        for r in rows:
            print(f"gate {r['gate_score']:8.4f}  dense {r['dense_score']:7.4f}  page {r['page_no']}  {r['preview']}")
        best = rows[0]["gate_score"] if rows else None
        print("gate would: " + ("ABSTAIN (nothing retrieved)" if best is None else f"{'ANSWER' if best >= args.threshold else 'ABSTAIN'} (best {best:.4f} against {args.threshold})"))
        if not s.reranker.thresholdable:
            print("scores of this re-ranker aren't calibrated, so the gate's verdict means nothing")
        return 0
    print(json.dumps(s.ask(args.question, args.document_id, args.threshold), ensure_ascii=False, indent=1, default=str))
    return 0


def best_scores(s: service.Service, questions: DataFrame) -> DataFrame:
    """question, answerable, best: the best dense score of each question, all questions in one pass over the points."""
    asked = s.embedder.embed(questions.select("question").distinct(), "question", "dense")
    hits = retrieval.knn_batch(asked, s.points.withColumn("chunk_id", F.col("chunk_id").cast("string")), 1, "question", "chunk_id", "dense", same=True)
    return questions.join(hits.select(F.col("q").alias("question"), F.col("score").alias("best")), "question", "left")


def sweep(spark: SparkSession, args: argparse.Namespace) -> int:
    s = _service(spark, args)
    scored = best_scores(s, files.read_questions(spark, args.questions))
    if not args.uncalibrated:
        answering.check_sweep(scored, s.reranker.thresholdable)
    table = answering.threshold_sweep(scored)
    print(f"{'cutoff':>9} {'answered':>9} {'rejected':>9} {'leaked':>7}")
    for r in table.collect():  # one row a distinct score of the questions
        print(f"{r['cutoff']:9.3f} {r['answered']:9d} {r['rejected']:9d} {r['leaked']:7d}")
    best = answering.best_cutoff(table).collect()
    print(f"lowest cutoff without a leak: {best[0]['cutoff']:.3f}" if best else "no cutoff rejects every unanswerable question")
    if args.out:
        Path(args.out).write_text("[" + ",\n".join(scored.toJSON().toLocalIterator()) + "]", encoding="utf-8")
    return 0


def probe(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = pages.latest(read_table(spark, args.data, "document_pages").select("document_id", "page_no", "updated_at", "raw_text", "quality"), ["document_id", "page_no"], "updated_at")
    verdicts = pages.probe_verdict(pages.decoded_quality(rows, "raw_text"))
    for r in verdicts.orderBy("document_id").toLocalIterator():
        print(f"{r['document_id']}  {r['verdict']}")
    return 0


def ocr_bench(spark: SparkSession, args: argparse.Namespace) -> int:
    """Outputs are a Parquet table of page_no, engine, text, seconds; gold texts are files named page_0001.txt and so on."""
    wanted = spark.read.parquet(args.outputs)
    most = wanted.agg(F.max("page_no")).collect()[0][0] or 0
    numbers = files.read_pages_selection(args.pages, most)
    keys, out = ["page_no"], Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    wanted = wanted.where(F.col("page_no").isin(numbers))
    if args.make_gold_template:
        print("\n".join(files.write_gold_templates(str(out), [f"page_{n:04d}" for n in numbers], "Type the printed text of the page below, all of it.")))
        return 0
    gold = spark.createDataFrame([], "page_no int, gold_text string")
    if args.gold:
        gold = files.read_gold(spark, f"{args.gold}/page_*.txt").select(F.regexp_extract("path", r"page_(\d+)\.txt$", 1).cast("int").alias("page_no"), "gold_text")
    pairs = ocrbench.consensus(wanted, keys)
    scores = ocrbench.page_scores(wanted, gold, keys)
    files.write_report(ocrbench.ranking(ocrbench.quality_signals(wanted, keys), ocrbench.mean_agreement(pairs, keys), scores, wanted.select("engine", "seconds"), keys), str(out / "report"), "OCR engines")
    files.write_report(ocrbench.worst_pairs(pairs, keys), str(out / "disagreement"), "Least agreement by page", most=100_000)
    for r in ocrbench.side_by_side(wanted, keys).toLocalIterator():
        (out / f"page_{r['page_no']:04d}.compare.txt").write_text(r["compared"], encoding="utf-8")
    print((out / "report.md").read_text())
    for r in ocrbench.high_error(scores).collect():
        print(f"page {r['page_no']}, {r['engine']}: CER above 1, does the gold text cover the whole page?")
    return 0


def db(spark: SparkSession, args: argparse.Namespace) -> int:
    applied = spark.read.parquet(args.applied) if Path(args.applied).exists() else spark.createDataFrame([], "filename string, applied_at timestamp")
    if args.action == "migrate":
        done = files.migrate(spark, args.folder, applied)
        done.join(applied.select("filename"), "filename", "left_anti").write.mode("append").parquet(args.applied)
        applied = done
    pending = files.pending_migrations(spark, [p.name for p in Path(args.folder).glob("*.sql")], applied)
    print(json.dumps(files.health(spark) | {"pending": pending}))
    return 0 if args.action == "migrate" or not pending else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, run in (("ask", ask), ("sweep", sweep)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("question" if name == "ask" else "questions")
        p.add_argument("--data", required=True, help="folder of the tables")
        p.add_argument("--embedder", choices=sorted(EMBEDDERS), default="fake")
        p.add_argument("--reranker", choices=sorted(RERANKERS), default="passthrough")
        p.add_argument("--threshold", type=float, default=0.0)
        if name == "ask":
            p.add_argument("--document-id")
            p.add_argument("--retrieval-only", action="store_true")
        else:
            p.add_argument("--out")
            p.add_argument("--uncalibrated", action="store_true", help="sweep over scores that aren't calibrated all the same")
    p = sub.add_parser("probe")
    p.set_defaults(run=probe)
    p.add_argument("--data", required=True)
    p = sub.add_parser("ocr-bench")
    p.set_defaults(run=ocr_bench)
    p.add_argument("outputs")
    p.add_argument("--pages", default="all")
    p.add_argument("--gold")
    p.add_argument("--out", required=True)
    p.add_argument("--make-gold-template", action="store_true")
    p = sub.add_parser("db")
    p.set_defaults(run=db)
    p.add_argument("action", choices=["migrate", "status"])
    p.add_argument("folder")
    p.add_argument("--applied", required=True, help="Parquet table of the migrations that were applied")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
