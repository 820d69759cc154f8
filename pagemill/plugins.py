"""Boundaries to external systems, each with a local implementation: embedders, re-rankers, generators, OCR engines, PDF readers."""

from __future__ import annotations

import hashlib
import importlib.util
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.hashing import hashed_vector, l2


class Embedder(ABC):
    """Texts to unit vectors. ``embed`` adds ``out`` to the frame and keeps its rows."""

    dim: int
    model_id: str

    def available(self) -> bool:
        return True

    @abstractmethod
    def embed(self, df: DataFrame, text: str, out: str = "dense") -> DataFrame: ...


class HashedEmbedder(Embedder):
    """Deterministic vectors without a model, by builtin expressions alone. A null text counts as empty."""

    def __init__(self, dim: int = 256):
        self.dim, self.model_id = dim, f"fake:{dim}"

    def embed(self, df: DataFrame, text: str, out: str = "dense") -> DataFrame:
        return df.withColumn(out, l2(hashed_vector(F.coalesce(F.col(text), F.lit("")), self.dim)))


class ModelEmbedder(Embedder):
    """A model loaded once a task; ``load`` returns a function from a list of texts to vectors. Batches of ``batch`` texts."""

    def __init__(self, name: str, dim: int, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 8):
        self.name, self.dim, self.load, self.batch, self.model_id = name, dim, load, batch, f"{name}:{dim}"

    def embed(self, df: DataFrame, text: str, out: str = "dense") -> DataFrame:
        load, size = self.load, self.batch

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                texts = [t or "" for t in s]
                yield pd.Series([v for i in range(0, len(texts), size) for v in model(texts[i : i + size])])

        return df.withColumn(out, l2(run(F.col(text))))


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"fake": HashedEmbedder}


def embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise KeyError(f"unknown embedder {name}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]()


class Reranker(ABC):
    """Adds rerank_score to hits. Scores of a thresholdable re-ranker can be compared with a fixed threshold."""

    thresholdable = True

    @abstractmethod
    def score(self, hits: DataFrame, question: str) -> DataFrame: ...


class Passthrough(Reranker):
    thresholdable = False

    def score(self, hits: DataFrame, question: str) -> DataFrame:
        return hits.withColumn("rerank_score", F.lit(None).cast("double"))


class CrossEncoder(Reranker):
    """A pair model loaded once a task; ``load`` returns a function from (question, passages) to scores."""

    def __init__(self, load: Callable[[], Callable[[str, list[str]], list[float]]]):
        self.load = load

    def score(self, hits: DataFrame, question: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                yield pd.Series(model(question, [t or "" for t in s]) if len(s) else [], dtype="float64")

        return hits.withColumn("rerank_score", run(F.col("text")))


RERANKERS: dict[str, Callable[[], Reranker]] = {"passthrough": Passthrough}


class Generator(ABC):
    """Answers with cited claims: the JSON payload (sufficient, answer, claims of claim, span_id, quote) for a question and its span block."""

    @abstractmethod
    def generate(self, df: DataFrame, question: str = "question", spans: str = "span_block", out: str = "payload") -> DataFrame: ...


class Extractive(Generator):
    """An answer without a model: the first sentence of each of the first ``most`` spans is a claim that quotes itself. No span is insufficient."""

    def __init__(self, most: int = 2):
        self.most = most

    def generate(self, df: DataFrame, question: str = "question", spans: str = "span_block", out: str = "payload") -> DataFrame:
        blocks = F.slice(F.regexp_extract_all(F.col(spans), F.lit(r"(?s)\[S\d+\] \(page [^)]*\)\n.*?(?=\n\n\[S\d+\] \(page |$)"), F.lit(0)), 1, self.most)

        def claim(block: Column) -> Column:
            quote = F.regexp_extract(F.regexp_replace(block, r"^[^\n]*\n", ""), r"(?s)^\s*(.*?(?:[।?!.](?=\s|$)|$))", 1)
            return F.struct(quote.alias("claim"), F.regexp_extract(block, r"^\[(S\d+)\]", 1).alias("span_id"), quote.alias("quote"))

        claims = F.transform(blocks, claim)
        text = F.array_join(F.transform(claims, lambda c: c["claim"]), " ")
        return df.withColumn(out, F.to_json(F.struct((F.size(claims) > 0).alias("sufficient"), text.alias("answer"), claims.alias("claims"))))


class OcrEngine(ABC):
    """Page images to text. ``run`` takes (page key, png) rows and gives text and seconds."""

    name: str

    def available(self) -> bool:
        return True

    @abstractmethod
    def run(self, images: DataFrame) -> DataFrame: ...


class PdfReader(ABC):
    """Binary PDF rows (path, content) to page rows (path, page_no, raw_text, fonts)."""

    @abstractmethod
    def pages(self, files: DataFrame) -> DataFrame: ...


class Textlayer(OcrEngine):
    """Not OCR: the text that a PDF has itself, as what engines are compared with. ``run`` takes rows with raw_text instead of an image."""

    name = "textlayer"

    def run(self, images: DataFrame) -> DataFrame:
        return images.withColumns({"text": F.coalesce("raw_text", F.lit("")), "seconds": F.lit(0.0)})


def open_pdf(content: bytes) -> Any:
    """A document of the pymupdf package, which is needed only where PDFs are parsed."""
    import pymupdf

    return pymupdf.open(stream=content, filetype="pdf")


class LocalPdfReader(PdfReader):
    """Pages, text spans and fonts of PDF files, parsed a file at a time in Python workers. ``opener`` gives a document from a file's bytes (pymupdf's by default).

    A file that can't be parsed gives no page; ``faults`` tells it with the error.
    """

    def __init__(self, opener: Callable[[bytes], Any] = open_pdf):
        self.opener = opener

    def available(self) -> bool:
        return self.opener is not open_pdf or importlib.util.find_spec("pymupdf") is not None

    def _each(self, files: DataFrame, schema: str, rows: Callable[[Any], Iterator[tuple]], faults: bool = False) -> DataFrame:
        opener, columns = self.opener, [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path, content in zip(pdf["path"], pdf["content"]):
                    out: list[tuple] = []
                    try:
                        doc = opener(bytes(content))
                        found = [] if faults else [(path, *r) for r in rows(doc)]
                        if faults:
                            list(rows(doc))
                        out = found
                    except Exception as problem:
                        out = [(path, f"{type(problem).__name__}: {problem}")] if faults else []
                    yield pd.DataFrame(out, columns=columns, dtype=object)

        return files.select("path", "content").mapInPandas(run, schema)

    @staticmethod
    def _texts(doc: Any) -> Iterator[tuple]:
        for n in range(doc.page_count):
            yield n + 1, doc[n].get_text()

    def pages(self, files: DataFrame) -> DataFrame:
        """path, page_no, raw_text."""
        return self._each(files, "path string, page_no int, raw_text string", self._texts)

    def faults(self, files: DataFrame) -> DataFrame:
        """path, error of the files that can't be parsed."""
        return self._each(files, "path string, error string", self._texts, faults=True)

    def spans(self, files: DataFrame) -> DataFrame:
        """path, page_no, font, text: what each font draws."""

        def rows(doc: Any) -> Iterator[tuple]:
            for n in range(doc.page_count):
                for block in doc[n].get_text("dict").get("blocks", []):
                    for line in block.get("lines", []):
                        for span in line.get("spans", []):
                            yield n + 1, span.get("font"), span.get("text", "")

        return self._each(files, "path string, page_no int, font string, text string", rows)

    def fonts(self, files: DataFrame) -> DataFrame:
        """path, page_no, xref, font_name, font_object: the fonts of each page and their definitions."""

        def rows(doc: Any) -> Iterator[tuple]:
            for n in range(doc.page_count):
                for font in doc[n].get_fonts(full=True):
                    yield n + 1, font[0], font[3], doc.xref_object(font[0])

        return self._each(files, "path string, page_no int, xref int, font_name string, font_object string", rows)

    def render(self, files: DataFrame, folder: str, dpi: int = 300) -> DataFrame:
        """path, page_no, image: PNG files of the pages in a folder that all workers see, named by content, page and resolution; one that is there already isn't made again."""

        def rows(doc: Any) -> Iterator[tuple]:
            key = getattr(doc, "key", None) or hashlib.sha256(doc.tobytes()).hexdigest()[:16]
            Path(folder).mkdir(parents=True, exist_ok=True)
            for n in range(doc.page_count):
                target = Path(folder) / f"{key}_{n + 1:04d}_{dpi}.png"
                if not target.exists():
                    doc[n].get_pixmap(dpi=dpi).save(str(target))
                yield n + 1, str(target)

        return self._each(files, "path string, page_no int, image string", rows)
