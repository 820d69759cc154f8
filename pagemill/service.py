"""The application's calls over a set of tables: upload, list, inspect, run stages, ask. Thin wrappers; every answer is a DataFrame or a plain dict."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, HTTPServer
from itertools import chain, islice
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import answering, pages, retrieval, stages
from pagemill.plugins import Embedder, Generator, HashedEmbedder, Passthrough, Reranker
from pagemill.functions.hashing import uuid5
from pagemill.sources import files
from pagemill.sources.shared import write_through

ABSTAIN = "No answer could be found in the documents."


@dataclass
class Service:
    spark: SparkSession
    documents: DataFrame
    document_pages: DataFrame
    runs: DataFrame
    points: DataFrame
    collections: DataFrame
    collection: str = "pages_main"
    embedder: Embedder = field(default_factory=HashedEmbedder)
    reranker: Reranker = field(default_factory=Passthrough)
    generator: Generator | None = None
    threshold: float = 0.0
    storage: str | None = None
    stage_functions: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def health(self) -> dict:
        return files.health(self.spark) | {"stages_missing": [s for s in stages.STAGES if s not in self.stage_functions]}

    def upload(self, folder: str, language: str = "bn") -> DataFrame:
        """Store the new contents of a folder of PDFs; every file comes out with the document it is stored as and whether it made it (of equal files one does).

        A stored document's stages are pending from then on, as ``ensure_stage_runs`` gives them to every document.
        """
        found = files.read_uploads(self.spark, folder)
        new = files.new_uploads(found, self.documents)
        now = self.spark.range(1).select(F.current_timestamp()).collect()[0][0]
        stored = new.select(
            uuid5(F.col("sha256")).alias("id"), "filename", "sha256", F.col("path").alias("storage_path"), "byte_size", F.lit(language).alias("language"), F.lit(False).alias("review_required"),
            F.lit(now).cast("timestamp").alias("uploaded_at"))
        stored = write_through(stored, "uploads")
        kept = self.documents.where("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("id"))
        made = stored.select("sha256", "id", F.col("storage_path").alias("own"))
        out = found.join(kept.unionByName(made.select("sha256", "id")), "sha256").join(made.select("sha256", "own"), "sha256", "left")
        answer = write_through(out.select("id", "filename", F.substring("sha256", 1, 12).alias("sha12"), "byte_size", F.coalesce(F.col("own") == F.col("path"), F.lit(False)).alias("created")), "uploaded")
        for name in self.documents.columns:  # what the table has beyond an upload's columns is null
            if name not in stored.columns:
                stored = stored.withColumn(name, F.lit(None).cast(self.documents.schema[name].dataType))
        self.documents = self.documents.unionByName(stored.select(*self.documents.columns))
        return answer

    def list_documents(self) -> DataFrame:
        return pages.listing(self.documents)

    def document(self, document_id: str) -> dict:
        row = self.documents.where(F.col("id") == document_id).limit(1).collect()
        if not row:
            raise LookupError(document_id)
        own = self.document_pages.where(F.col("document_id") == document_id)
        return {
            "document": row[0].asDict(),
            "stages": [r.asDict() for r in self._stage_rows(document_id)],
            "next_runnable": next((r["stage"] for r in stages.next_runnable(self._runs(document_id)).collect()), None),
            "pages": [r.asDict() for r in own.select("page_no", "source", "trustworthy", F.length("text").alias("chars")).orderBy("page_no").collect()],
        }

    def _runs(self, document_id: str | None = None) -> DataFrame:
        """The runs of all documents or one, with a pending row for each stage that was never run."""
        docs, runs = (t if document_id is None else t.where(F.col(k) == document_id) for t, k in ((self.documents, "id"), (self.runs, "document_id")))
        return stages.with_book(stages.ensure_stage_runs(docs, runs))

    def _stage_rows(self, document_id: str) -> list:
        own = self._runs(document_id)
        rows = stages.with_blockers(own).join(own.select("document_id", "stage", *stages.BOOK), ["document_id", "stage"]).withColumn("implemented", F.col("stage").isin(*self.stage_functions))
        return rows.orderBy("pos").collect()

    def artifact(self, document_id: str, stage: str) -> str:
        """The stage's stored result, from inside the storage folder only."""
        row = self.runs.where((F.col("document_id") == document_id) & (F.col("stage") == stage)).select("output_ref").limit(1).collect() if "output_ref" in self.runs.columns else []
        if not row or not row[0][0] or not self.storage:
            raise LookupError("no artifact for that stage")
        return files.read_artifact(self.storage, row[0][0])

    def page(self, document_id: str, page_no: int, raw: bool = False) -> str:
        row = self.document_pages.where((F.col("document_id") == document_id) & (F.col("page_no") == page_no)).select(F.coalesce("raw_text" if raw else "text", F.lit("")).alias("t")).limit(1).collect()
        if not row:
            raise LookupError(f"{document_id}:{page_no}")
        return row[0]["t"]

    def review(self) -> DataFrame:
        return pages.review_queue(self.documents)

    def run_stage(self, document_id: str, stage: str, force: bool = False) -> DataFrame:
        if stage not in stages.STAGES:
            raise LookupError(stage)
        if stage not in self.stage_functions:
            raise NotImplementedError(stage)
        if not self.documents.where(F.col("id") == document_id).limit(1).collect():
            raise LookupError(document_id)
        wanted = self.spark.createDataFrame([(document_id, stage)], "document_id string, stage string")
        row = stages.with_blockers(self._runs(document_id)).where(F.col("stage") == stage).collect()[0]
        if not row["forced" if force else "manual"]:
            raise RuntimeError(f"cannot run {stage}: " + ("; ".join(row["blockers"]) or f"it is {row['status']}"))
        self.runs = write_through(stages.run_stage(self._runs(), wanted, self.stage_functions[stage], force), "runs")
        done = self.runs.where(F.col("document_id") == document_id)
        failed = done.where((F.col("stage") == stage) & (F.col("status") == "failed")).select("error").collect()
        if failed:
            raise StageFailed(failed[0][0])
        return done

    def advance(self, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
        self.runs = stages.advance(self._runs(), stage)
        return self.runs

    def advance_document(self, document_id: str, max_stages: int | None = None) -> list[str]:
        """Run the document's stages until one blocks; the names of those that ran. A stage that fails or has no function stops it."""
        ran: list[str] = []
        for _ in range(len(stages.STAGES) if max_stages is None else max_stages):
            due = stages.next_runnable(self._runs(document_id)).collect()
            if not due:
                break
            self.run_stage(document_id, due[0]["stage"])
            ran.append(due[0]["stage"])
        return ran

    def retrieve(self, question: str, document_id: str | None = None) -> DataFrame:
        row = self.embedder.embed(self.spark.createDataFrame([(question,)], "q string"), "q", "v").collect()[0]
        return retrieval.retrieve(self.points, self.collections, self.collection, question, list(row["v"]), self.embedder.model_id, self.reranker, document_id=document_id)

    def ask(self, question: str, document_id: str | None = None, threshold: float | None = None) -> dict:
        """The gate comes first: the generator is called only for a question that passes it. The answer carries what decided it: each candidate's scores, the threshold, each claim's overlaps."""
        least = self.threshold if threshold is None else threshold
        hits = write_through(self.retrieve(question, document_id).withColumn("question", F.lit(question)), "hits")
        asked = self.spark.createDataFrame([(question,)], "question string")
        gated = answering.gate(asked, retrieval.score_summary(hits, ["question"]), least)
        row = gated.collect()[0]
        candidates = answering.candidate_details(hits).drop("question").collect()  # at most the re-ranker's k
        found = {
            "threshold": least, "best_score": row["best_score"], "embedder": self.embedder.model_id, "reranker": type(self.reranker).__name__, "thresholdable": self.reranker.thresholdable,
            "candidates": [r.asDict() for r in candidates], "claims": []}
        if row["abstain_reason"] or self.generator is None:
            return {"question": question, "answered": False, "text": ABSTAIN, "citations": [], "abstain_reason": row["abstain_reason"] or "no generator is configured", "warnings": [], "diagnostics": found}
        spans = answering.number_spans(hits)
        made = write_through(self.generator.generate(answering.span_block(spans)).withColumn("payload", F.from_json("payload", answering.PAYLOAD)), "payload")
        claims = answering.check_claims(made, spans)
        out = answering.outcomes(gated, made, claims, self.reranker.thresholdable).collect()[0].asDict()
        found["claims"] = [r.asDict() for r in claims.orderBy("pos").drop("question").collect()]
        cited = [c["chunk_id"] for c in found["claims"] if c["grounded"]] if out["answered"] else []
        payloads = {r["chunk_id"]: r["citation"].asDict() for r in hits.where(F.col("chunk_id").isin(cited)).select("chunk_id", answering.citation(hits)).collect()} if cited else {}
        return out | {"question": question, "text": out["text"] or ABSTAIN, "citations": [payloads[c] for c in dict.fromkeys(cited)], "diagnostics": found}


class StageFailed(Exception):
    """A stage that raised; its run is stored as failed."""


def status_of(error: Exception) -> int:
    """The HTTP status of an error."""
    return 404 if isinstance(error, LookupError) else 501 if isinstance(error, NotImplementedError) else 409 if isinstance(error, RuntimeError) else 500


def rows(df: DataFrame) -> Iterator[str]:
    """All rows as JSON objects, fetched a partition at a time. The first is fetched at once, so that a query that fails does so before anything is answered."""
    lines = df.toJSON().toLocalIterator()
    return chain(list(islice(lines, 1)), lines)


def respond(service: Service, method: str, url: str, body: dict | None = None) -> tuple[int, object]:
    """(status, answer) of one request; of a table the answer is an iterator over all its rows."""
    parts, query = [p for p in urlparse(url).path.split("/") if p], parse_qs(urlparse(url).query)
    try:
        match (method, parts):
            case ("GET", ["health"]):
                return 200, service.health()
            case ("GET", ["documents"]):
                return 200, rows(service.list_documents())
            case ("POST", ["documents"]):
                return 200, rows(service.upload((body or {})["folder"], (body or {}).get("language", "bn")))
            case ("GET", ["documents", doc]):
                return 200, service.document(doc)
            case ("GET", ["documents", doc, "pages", n]):
                return 200, {"text": service.page(doc, int(n), query.get("raw", ["0"])[0] in ("1", "true"))}
            case ("POST", ["documents", doc, "stages", stage, "run"]):
                return 200, rows(service.run_stage(doc, stage, (body or {}).get("force", False)))
            case ("POST", ["documents", doc, "advance"]):
                return 200, {"ran": service.advance_document(doc, (body or {}).get("max_stages"))}
            case ("GET", ["documents", doc, "artifacts", stage]):
                return 200, {"text": service.artifact(doc, stage)}
            case ("POST", ["ask"]):
                return 200, service.ask((body or {})["question"], (body or {}).get("document_id"), (body or {}).get("threshold"))
            case ("GET", ["review"]):
                return 200, rows(service.review())
        return 404, {"error": "no such route"}
    except Exception as error:
        return status_of(error), {"error": str(error)}


def handle(service: Service, method: str, url: str, body: dict | None = None) -> tuple[int, object]:
    """(status, answer) of one request, tables as lists of all rows."""
    try:
        status, out = respond(service, method, url, body)
        return status, [json.loads(x) for x in out] if isinstance(out, Iterator) else out
    except Exception as error:
        return status_of(error), {"error": str(error)}


def serve(service: Service, port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = respond(service, method, self.path, json.loads(raw) if raw else None)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            if not isinstance(out, Iterator):
                self.wfile.write(json.dumps(out, ensure_ascii=False, default=str).encode())
                return
            # an answer that breaks off has no closing bracket, so it can't be taken for a whole one
            self.wfile.write(b"[")
            for n, line in enumerate(out):
                self.wfile.write((", " * (n > 0) + line).encode())
            self.wfile.write(b"]")

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
