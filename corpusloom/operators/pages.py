"""The page pipeline: one parse a page, all requested outputs from it, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.functions.dom import Document, parse, unescape_ended
from corpusloom.functions.extract import extract
from corpusloom.functions.filters import FILTERS, apply_filter, chunks
from corpusloom.functions.js import words
from corpusloom.functions.markdown import variants
from corpusloom.functions.scrape import PARTS, ScrapeOptions, remove_overlays, scrape
from corpusloom.session import dealt, ship

LINK = "struct<href:string,text:string,title:string,base_domain:string>"
MEDIA = "struct<src:string,alt:string,desc:string,score:int,type:string,group_id:int,format:string,width:int>"
FIELDS = {
    "cleaned_html": "string",
    "markdown": "struct<raw_markdown:string,markdown_with_citations:string,references_markdown:string,fit_markdown:string,fit_html:string>",
    "links": f"struct<internal:array<{LINK}>,external:array<{LINK}>>",
    "media": f"struct<images:array<{MEDIA}>,videos:array<{MEDIA}>,audios:array<{MEDIA}>>",
    "tables": "array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>",
    "metadata": "struct<title:string,description:string,keywords:string,author:string,canonical:string,robots:string>",
    "extracted": "string",
    "word_count": "int",
}
ALL = tuple(FIELDS)
#: Rows and bytes of text that a Python worker works on before it hands its results on.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones, so that results of many rows never pile up; a longer text has a piece of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= PIECE_ROWS or held + n > PIECE_BYTES):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield b.slice(start)


def process_html(html: str, url: str, outputs: tuple[str, ...] = ALL, content_filter: str = "readability", filter_options: dict | None = None, scrape_options: ScrapeOptions = ScrapeOptions(), schema: dict | None = None, citations: bool = True, overlays: bool = False, ended_references: bool = False) -> dict:
    """One page. The filter and the extraction see the page before it is cleaned; overlays=True takes banners and dialogs out first, ended_references=True leaves references without a semicolon in texts as they are."""
    doc = parse(html or "", unescape_ended if ended_references else unescape)
    try:
        return _processed(doc, url, outputs, content_filter, filter_options, scrape_options, schema, citations, overlays)
    finally:
        doc.release()


def _processed(doc: Document, url: str, outputs: tuple[str, ...], content_filter: str, filter_options: dict | None, scrape_options: ScrapeOptions, schema: dict | None, citations: bool, overlays: bool) -> dict:
    if overlays:
        remove_overlays(doc)
    wants_text = "markdown" in outputs or "word_count" in outputs
    fit = apply_filter(doc, content_filter, filter_options) if "markdown" in outputs and content_filter != "none" else ""
    out: dict = {}
    if "extracted" in outputs and schema:
        try:
            out["extracted"] = json.dumps(extract(doc, schema), ensure_ascii=False)
        except Exception as e:
            out["extracted"] = json.dumps({"error": str(e)}, ensure_ascii=False)
    parts = tuple(p for p in PARTS if p in outputs or (p == "cleaned_html" and wants_text))
    out |= scrape(doc, url, scrape_options, parts) if parts else {}
    if wants_text:
        out["markdown"] = variants(out["cleaned_html"], url, fit, citations)
        out["word_count"] = len(words(out["markdown"]["raw_markdown"]))
    return {k: out.get(k) for k in outputs}


def process(pages: DataFrame, outputs: tuple[str, ...] = ALL, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = (), deal: bool = True, **options) -> DataFrame:
    """Rows (keep.., url, success, error, outputs..). Only the columns needed are read; a page that fails gives an error row.

    Pages are dealt over all tasks first; deal=False leaves them as they lie, for a caller that has dealt them.
    """
    if options.get("content_filter", "readability") not in FILTERS:
        raise ValueError(f"Unknown content filter: {options['content_filter']}")
    ship(pages.sparkSession)
    schema = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keep), "url string", "success boolean", "error string", *(f"{k} {FIELDS[k]}" for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__html"):
            rows = []
            for html, url in zip(b.column("__html").to_pylist(), b.column("__url").to_pylist()):
                try:
                    rows.append({"url": url, "success": True, "error": None, **process_html(html, url or "", outputs, **options)})
                except Exception as e:
                    rows.append({"url": url, "success": False, "error": str(e), **dict.fromkeys(outputs)})
            # Kept columns stay in Arrow as they are.
            made = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], names=[*keep, *(f.name for f in arrow)])

    chosen = pages.select(*keep, F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    own = ", ".join(["url string", "success boolean", "error string", *(f"{k} {FIELDS[k]}" for k in outputs)])
    arrow = to_arrow_schema(StructType.fromDDL(own))
    return (dealt(chosen) if deal else chosen).mapInArrow(run, schema)


def links(pages: DataFrame, keep: tuple[str, ...] = (), include_external: bool = True, **options) -> DataFrame:
    """One row per distinct link of a page: (keep.., url, kind, ordinal, href, text, title, base_domain)."""
    done = process(pages, ("links",), keep=keep, **options)
    inside = F.transform("links.internal", lambda x: F.struct(F.lit("internal").alias("kind"), x.alias("l")))
    outside = F.transform("links.external", lambda x: F.struct(F.lit("external").alias("kind"), x.alias("l")))
    every = F.concat(inside, outside) if include_external else inside
    return done.select(*keep, "url", F.posexplode(every).alias("ordinal", "x")).select(*keep, "url", F.col("x.kind").alias("kind"), "ordinal", "x.l.href", "x.l.text", "x.l.title", "x.l.base_domain")


def table_cells(pages: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per table cell: (keep.., url, table_no, row_no, column_no, header, cell, caption)."""
    t = process(pages, ("tables",), keep=keep, **options).select(*keep, "url", F.posexplode("tables").alias("table_no", "t"))
    r = t.select(*keep, "url", "table_no", "t.headers", "t.caption", F.posexplode("t.rows").alias("row_no", "row"))
    c = r.select(*keep, "url", "table_no", "row_no", "headers", "caption", F.posexplode("row").alias("column_no", "cell"))
    return c.select(*keep, "url", "table_no", "row_no", "column_no", F.try_element_at("headers", F.col("column_no") + 1).alias("header"), "cell", "caption")


def images(pages: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    m = process(pages, ("media",), keep=keep, **options)
    return m.select(*keep, "url", F.posexplode("media.images").alias("ordinal", "i")).select(*keep, "url", "ordinal", "i.*")


def page_chunks(pages: DataFrame, keep: tuple[str, ...] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per innermost block of text: (keep.., url, chunk_no, tag, text, html)."""
    ship(pages.sparkSession)
    schema = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keep), "url string", "chunk_no int", "tag string", "text string", "html string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__html"):
            at, rows = [], []
            for i, html in enumerate(b.column("__html").to_pylist()):
                doc = parse(html or "")
                for n, (e, text) in enumerate(chunks(doc)):
                    at.append(i)
                    rows.append((n, e.tag, text, e.outer_html))
                doc.release()
            at = pa.array(at, pa.int64())
            made = [pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (*keep, "__url")), *made], names=[*keep, "url", "chunk_no", "tag", "text", "html"])

    return dealt(pages.select(*keep, F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))).mapInArrow(run, schema)


def rendered_or_raw(pages: DataFrame, rendered_col: str = "rendered_html", html_col: str = "html") -> DataFrame:
    """Use rendered HTML where there is some; render_fallback tells where there was none."""
    gone = F.col(rendered_col).isNull()
    return pages.withColumn("render_fallback", F.when(gone, F.lit("no rendered page"))).withColumn(html_col, F.coalesce(F.col(rendered_col), F.col(html_col)))


def word_count_col(markdown: Column) -> Column:
    from corpusloom.functions.js import WS_CLASS

    return F.size(F.filter(F.split(markdown, WS_CLASS + "+"), lambda x: x != ""))
