"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import text as T
from leafwork.functions import paths
from leafwork.functions.paths import document_type_of, extension
from leafwork.operators import analyze, extract, files, jobs, office, outcomes, outputs, parts
from leafwork.plans import flows
from leafwork.plans.converters import convert_documents as convert
from leafwork.session import new_folder
from leafwork.sources import listing, ranges, readers, writers
from leafwork.streaming import levels, streams
from leafwork.workload import archives
from leafwork.workload import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHUNK = 1_000
MAX_MB = 0.5
#: What the jobs of ``_stored`` ask for; no office files among them.
JOB_TYPES = ["txt", "csv", "rtf"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", "text")


def _utf8(text: Column) -> Column:
    return text.cast("binary")


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- sources -----------------------------------------------------------------


def _job_columns(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("ftp_port", F.col("ftp_port").cast("long"))


@query
def parse_jobs(spark, sf_dir):
    return _job_columns(jobs.parse_jobs(I.messages(spark, sf_dir)))


@query
def jobs_stream(spark, sf_dir):
    """The pages table read as a stream of messages, landed and read back."""
    stream = I.table_stream(spark, sf_dir, "pages").select("page_id", F.expr(I.MESSAGE).alias("value"))
    landed = new_folder(spark, "jobs")
    streams.start_jobs_stream(
        stream, landed, new_folder(spark, "jobs-log"), available_now=True
    ).awaitTermination()
    return spark.read.parquet(landed).select(
        "page_id", "job_id", "document_type", "location_type", "converter", "error",
        F.col("rejected").cast("boolean").alias("rejected"),
    )


@query
def scan_inbox(spark, sf_dir):
    return files.scan_inbox(I.inbox(spark, sf_dir).drop("text"), C.SCAN_MAX_FILES).select(
        "key", "size_bytes", "ext", "document_type"
    )


@query
def scan_summary(spark, sf_dir):
    return files.scan_summary(I.inbox(spark, sf_dir).drop("text"), C.SCAN_MAX_FILES)


def _stored_documents(spark: SparkSession, sf_dir: str) -> str:
    """Write each document as a text file and each page as an HTML file."""
    base = new_folder(spark, "inbox")
    rows = (
        _documents(spark, sf_dir)
        .select(
            F.concat(F.lit("txt/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
                "output_key"
            ),
            "text",
        )
        .unionByName(
            I.table(spark, sf_dir, "pages").select(
                F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".HTML")).alias(
                    "output_key"
                ),
                F.col("html").alias("text"),
            )
        )
    )
    writers.write_objects(rows, base).write.mode("overwrite").format("noop").save()
    return base


@query
def read_documents(spark, sf_dir):
    """One object per document written, then found and read back."""
    base = _stored_documents(spark, sf_dir)
    found = readers.read_documents(spark, base, readers.extensions_of(["txt", "html"]))
    return found.select(
        "key", "size_bytes", "document_type", F.sha2("content", 256).alias("sha")
    )


@query
def fetch_objects(spark, sf_dir):
    """The same objects fetched by the keys of a table; some more keys name nothing."""
    base = _stored_documents(spark, sf_dir)
    docs, number = _documents(spark, sf_dir), F.col("doc_id").cast("string")
    keys = docs.select("doc_id", F.concat(F.lit("txt/"), number, F.lit(".txt")).alias("key"))
    lost = docs.where("doc_id % 50 = 0").select("doc_id", F.concat(F.lit("gone/"), number, F.lit(".txt")).alias("key"))
    found = readers.fetch_objects(keys.unionByName(lost), base)
    return found.select("doc_id", "key", F.sha2("content", 256).alias("sha"))


@query
def infer_doc_type(spark, sf_dir):
    return files.infer_doc_type(I.inbox(spark, sf_dir).select("doc_id", "key"))


@query
def url_extension(spark, sf_dir):
    return files.url_extension(I.table(spark, sf_dir, "pages").select("page_id", "url"))


@query
def key_suffix(spark, sf_dir):
    """What follows the last dot of an object key, folders included."""
    keys = I.inbox(spark, sf_dir).select("doc_id", "key")
    return keys.withColumn("suffix", paths.key_suffix(F.col("key")))


@query
def expand_jobs(spark, sf_dir):
    """Messages that hold one job or an array of jobs, one row per job."""
    batches = I.table(spark, sf_dir, "pages").select("page_id", F.expr(I.BATCH_MESSAGE).alias("value"))
    parsed = jobs.parse_jobs(jobs.expand_batches(batches))
    return parsed.select("page_id", "job_id", "document_type", "location_type", "url", "error")


# --- sinks ---------------------------------------------------------------------


@query
def output_keys(spark, sf_dir):
    parsed = jobs.parse_jobs(I.messages(spark, sf_dir)).where(F.col("error").isNull())
    return jobs.output_keys(parsed, I.OUTPUT_BUCKET)


@query
def key_collisions(spark, sf_dir):
    """Watch keys that more than one file of the inbox would be written under."""
    found = I.inbox(spark, sf_dir).select(
        jobs.watch_key(F.regexp_replace("key", "[0-9]+", "n")).alias("output_key")
    )
    return jobs.key_collisions(found)


@query
def last_writer(spark, sf_dir):
    """Of the files that share an output key, the one with the highest id."""
    found = I.inbox(spark, sf_dir).select(
        jobs.watch_key(F.regexp_replace("key", "[0-9]+", "n")).alias("output_key"), "doc_id", "text"
    )
    last = writers.last_writer(found, "output_key", "doc_id")
    return last.select("output_key", "doc_id", F.sha2(_utf8(F.col("text")), 256).alias("sha"))


def _receipts(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Carried out once, by writing the receipts."""
    folder = new_folder(spark, "receipts")
    writers.write_table(receipts, folder)
    return spark.read.schema(receipts.schema).parquet(folder)


@query
def move_objects(spark, sf_dir):
    """Stored documents moved to the archive; some more are not where they should be."""
    base = _stored_documents(spark, sf_dir)
    docs, number = _documents(spark, sf_dir), F.col("doc_id").cast("string")
    there = docs.select(F.concat(F.lit("txt/"), number, F.lit(".txt")).alias("source_key"))
    lost = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("gone/lost-"), number, F.lit(".txt")).alias("source_key"))
    sources = there.unionByName(lost)
    moves = sources.withColumn("dest_key", jobs.archive_key(F.col("source_key")))
    return _receipts(spark, writers.move_objects(moves, base))


@query
def delete_objects(spark, sf_dir):
    """Stored documents deleted, then what is left in the store."""
    base = _stored_documents(spark, sf_dir)
    number = F.col("doc_id")
    done = _receipts(spark, writers.delete_objects(
        _documents(spark, sf_dir).where(number % 3 != 0).select(
            F.concat(F.lit("txt/"), number.cast("string"), F.lit(".txt")).alias("key")
        ),
        base,
    ))
    left = readers.read_documents(spark, base, readers.extensions_of(["txt", "html"]))
    return done.select("key", F.lit(True).alias("deleted"), "error").unionByName(
        left.select("key", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("error"))
    )


@query
def write_text(spark, sf_dir):
    """Texts written as a table split by type, then read back."""
    folder = new_folder(spark, "texts")
    rows = I.inbox(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("job_id"),
        document_type_of(F.lower(extension(F.col("key")))).alias("document_type"),
        "text",
    )
    writers.write_table(
        rows.withColumn("output_key", jobs.text_key(F.col("job_id"))), folder, ["document_type"]
    )
    return spark.read.parquet(folder).select(
        "output_key",
        F.coalesce("document_type", F.lit("")).alias("document_type"),
        F.char_length("text").cast("long").alias("total_chars"),
        F.sha2(_utf8(F.col("text")), 256).alias("sha"),
    )


@query
def metadata_json(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("job_id"),
        F.lit("txt").alias("document_type"),
        "text",
    )
    analyzed = analyze.analyze_text(docs)
    return outputs.metadata_json(
        analyzed, I.GENERATED_AT, jobs.flow_key(F.col("job_id"), "text.txt")
    ).select("job_id", "metadata")


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.assemble_pages(I.page_rows(spark, sf_dir))


def _conversation_job() -> Column:
    return F.concat(F.lit("conv-"), F.col("doc_id").cast("string"))


@query
def write_pages(spark, sf_dir):
    """Pages written as a table under their keys, then read back."""
    folder = new_folder(spark, "pages")
    docs = _assembled(spark, sf_dir).select(_conversation_job().alias("job_id"), "text")
    writers.write_table(outputs.split_pages(docs, job_id="job_id"), folder)
    return spark.read.parquet(folder).select("page_key", "page_no", "text")


@query
def archive_processed(spark, sf_dir):
    done = I.inbox(spark, sf_dir).select("key", F.expr(I.FILE_SUCCESS).alias("success"))
    return files.archive_processed(done)


# --- predicates ------------------------------------------------------------------


@query
def validate_jobs(spark, sf_dir):
    checked = jobs.validate_jobs(jobs.parse_jobs(I.messages(spark, sf_dir)))
    return checked.select("page_id", "job_id", "location_type", "error")


@query
def route_converter(spark, sf_dir):
    typed = files.infer_doc_type(I.inbox(spark, sf_dir).select("doc_id", "key"))
    return jobs.route_converter(typed).select("doc_id", "document_type", "converter", "error")


@query
def validate_document(spark, sf_dir):
    """Every document; some more rows are empty, lost, or longer than the limit."""
    docs, number = _documents(spark, sf_dir), F.col("doc_id") % 50
    bad = docs.where(number < 3).select(
        (-1 - F.col("doc_id")).alias("doc_id"),
        F.when(number == 0, "").when(number == 2, F.repeat("text", F.ceil(F.lit(600_000) / F.octet_length("text")).cast("int"))).alias("text"),
    )
    rows = docs.unionByName(bad).select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.validate_document(rows, max_mb=MAX_MB).drop("content")


@query
def sniff_mime(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        _utf8(F.col("text")).alias("content"),
    )
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        _utf8(F.col("html")).alias("content"),
    )
    return files.sniff_mime(docs.unionByName(pages)).select("id", "mime_type")


@query
def select_outputs(spark, sf_dir):
    """Pages and analytics switched off: only full text is left in the plan."""
    docs = _assembled(spark, sf_dir).select(
        _conversation_job().alias("job_id"), F.lit("pdf").alias("document_type"), "text"
    )
    return flows.multi_format_output(
        docs, I.OUTPUT_BUCKET, I.GENERATED_AT, pages=False, analytics=False
    )


# --- extraction --------------------------------------------------------------------


@query
def html_to_text(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select("page_id", "html")
    return extract.html_to_text(pages)


@query
def csv_to_text(spark, sf_dir):
    """Every document read as a CSV file."""
    return extract.csv_to_text(_documents(spark, sf_dir), rows_per_chunk=20)


def _legacy_bytes() -> Column:
    """UTF-8 with a mark and CRLF; Latin-1 where that has all characters, else UTF-16; UTF-8 with CR."""
    text = F.col("text")
    return (
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.unhex(F.lit("EFBBBF")), _utf8(F.replace(text, F.lit("\n"), F.lit("\r\n")))),
        )
        .when((F.col("doc_id") % 3 == 1) & text.rlike(r"\A[\x00-\x7f\xa0-\xff]*+\z"), F.encode(text, "ISO-8859-1"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .otherwise(_utf8(F.replace(text, F.lit("\n"), F.lit("\r"))))
    )


@query
def decode_text(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", _legacy_bytes().alias("content"))
    return extract.decode_text(docs)


def _archives(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return archives.build_archives(I.table(spark, sf_dir, "documents"), kind)


@query
def docx_to_text(spark, sf_dir):
    return office.docx_to_text(_archives(spark, sf_dir, "docx"))


@query
def xlsx_to_text(spark, sf_dir):
    return office.xlsx_to_text(_archives(spark, sf_dir, "xlsx"))


@query
def pptx_to_text(spark, sf_dir):
    return office.pptx_to_text(_archives(spark, sf_dir, "pptx"))


@query
def odt_to_text(spark, sf_dir):
    return office.odt_to_text(_archives(spark, sf_dir, "odt"))


@query
def unpack_office(spark, sf_dir):
    elements = office.unpack_office(_archives(spark, sf_dir, "docx"))
    return elements.groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("elements"),
        F.sum(F.size("cells")).cast("long").alias("cells"),
        F.max("chunk_no").alias("last_chunk"),
    ).withColumn("cells", F.coalesce("cells", F.lit(0)))


@query
def assemble_pages(spark, sf_dir):
    return _assembled(spark, sf_dir)


@query
def assemble_frames(spark, sf_dir):
    return extract.assemble_frames(I.frame_rows(spark, sf_dir))


@query
def chunk_text(spark, sf_dir):
    return extract.chunk_text(_documents(spark, sf_dir), size=CHUNK)


@query
def line_parts(spark, sf_dir):
    """Documents cut at line ends into parts of about 500 characters; summed up."""
    parts = extract.line_parts(_documents(spark, sf_dir), size=500)
    return parts.groupBy("doc_id").agg(
        F.sum(F.char_length("text")).cast("long").alias("total_chars"),
        F.count_if(~F.endswith(F.col("text"), F.lit("\n"))).alias("open_parts"),
    )


@query
def batch_rows(spark, sf_dir):
    """Lines of every document, 50 to a chunk."""
    lines = F.split("text", "\n", -1)
    return extract.batch_rows(
        extract.explode_once(_documents(spark, sf_dir), lines, "row_no", "text", 1)
    )


@query
def concat_chunks(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return extract.concat_chunks(extract.chunk_text(docs, size=CHUNK), documents=docs).select(
        "doc_id", "part_no", "total_chars", "pages_processed", "text"
    )


@query
def document_totals(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    chunks = extract.chunk_text(docs, size=CHUNK)
    return extract.document_totals(extract.concat_chunks(chunks, chunks_per_part=4, documents=docs))


def _mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML, every document as text, CSV or DOCX; a few more rows are of an
    unknown type or lost."""
    number = F.col("doc_id")
    docs = I.table(spark, sf_dir, "documents")
    plain = docs.where(number % 3 != 2).select(
        F.concat(F.lit("d"), number.cast("string")).alias("doc_id"),
        F.when(number % 3 == 1, "csv").otherwise("txt").alias("document_type"),
        _utf8(F.col("text")).alias("content"),
    )
    word = archives.build_archives(docs.where(number % 3 == 2), "docx").select(
        F.concat(F.lit("d"), number.cast("string")).alias("doc_id"), "document_type", "content"
    )
    bad = docs.where(number % 50 < 2).select(
        F.concat(F.when(number % 50 == 0, "rtf").otherwise("lost"), number.cast("string")).alias("doc_id"),
        F.when(number % 50 == 0, "rtf").otherwise("txt").alias("document_type"),
        F.when(number % 50 == 0, _utf8(F.col("text"))).alias("content"),
    )
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"),
        F.lit("html").alias("document_type"),
        _utf8(F.col("html")).alias("content"),
    )
    return plain.unionByName(word).unionByName(bad).unionByName(pages)


@query
def convert_documents(spark, sf_dir):
    return convert(_mixed_documents(spark, sf_dir))


# --- joins ----------------------------------------------------------------------------


def _watched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every listed file with its job, and the results of those of known type."""
    listed = files.infer_doc_type(I.inbox(spark, sf_dir).drop("text")).withColumn(
        "job_id", jobs.watch_job_id(F.col("key"))
    )
    ok = F.expr(I.FILE_SUCCESS)
    results = listed.where(F.col("document_type") != "").select(
        "job_id",
        "key",
        ok.alias("success"),
        F.when(ok, jobs.watch_key(F.col("key"))).alias("output_key"),
        F.when(ok, F.col("size_bytes")).otherwise(0).cast("long").alias("total_chars"),
        F.when(~ok, "conversion failed").alias("error"),
    )
    return listed, results


@query
def watch_results(spark, sf_dir):
    return outcomes.watch_results(*_watched(spark, sf_dir))


def _extractions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two extractions of full length per document; see ``inputs.STANDARD_TEXT``."""
    docs = _documents(spark, sf_dir)
    n_chars = F.expr(I.visible_chars("text")).alias("total_chars")
    standard = docs.select(
        "doc_id",
        F.expr(I.EXTRACTION_TYPE).alias("document_type"),
        F.expr(I.STANDARD_TEXT).alias("text"),
    ).select("*", n_chars)
    enhanced = docs.select("doc_id", F.expr(I.ENHANCED_TEXT).alias("text")).select("*", n_chars)
    return standard, enhanced


@query
def best_extraction(spark, sf_dir):
    return outcomes.best_extraction(*_extractions(spark, sf_dir))


# --- analytics ------------------------------------------------------------------------


@query
def text_stats(spark, sf_dir):
    return analyze.text_stats(_documents(spark, sf_dir)).drop("text")


def _joined_words(df: DataFrame) -> DataFrame:
    return df.withColumn("top_words", F.array_join("top_words", " "))


@query
def top_words(spark, sf_dir):
    return _joined_words(analyze.top_words(_documents(spark, sf_dir)).drop("text"))


@query
def language_hint(spark, sf_dir):
    return analyze.language_hint(_documents(spark, sf_dir)).drop("text")


@query
def language_hint_all_words(spark, sf_dir):
    return analyze.language_hint(_documents(spark, sf_dir), mode="all_words").drop("text")


@query
def structure_flags(spark, sf_dir):
    return analyze.structure_flags(_assembled(spark, sf_dir)).select(
        "doc_id", "has_tables", "has_images"
    )


@query
def images_extracted(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("image")
    docs = _assembled(spark, sf_dir).select("doc_id", kind.alias("document_type"), "text")
    return analyze.images_extracted(docs).drop("text")


@query
def analyze_text(spark, sf_dir):
    return _joined_words(analyze.analyze_text(_documents(spark, sf_dir)).drop("text"))


@query
def analyze_parts(spark, sf_dir):
    """Conversations as one document per role, every turn a part of it: three
    documents hold all rows."""
    turns = I.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("doc_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("part_no"),
        F.concat(F.col("text"), F.lit("\n")).alias("text"),
    )
    return _joined_words(analyze.analyze_parts(turns))


@query
def analyze_line_parts(spark, sf_dir):
    """Documents analysed part by part give what the whole gives."""
    parts = extract.line_parts(_documents(spark, sf_dir), size=500)
    return _joined_words(analyze.analyze_parts(parts))


@query
def batch_progress(spark, sf_dir):
    return outcomes.batch_progress(I.event_results(spark, sf_dir))


@query
def watch_summary(spark, sf_dir):
    return outcomes.watch_summary(*_watched(spark, sf_dir))


def _newest_event(spark: SparkSession, sf_dir: str) -> Column:
    return I.table(spark, sf_dir, "events").agg(F.max("ts").alias("now")).scalar()


@query
def retention_report(spark, sf_dir):
    return files.retention_report(I.event_files(spark, sf_dir), _newest_event(spark, sf_dir))


@query
def status_summary(spark, sf_dir):
    return outcomes.status_summary(I.runs(spark, sf_dir)).withColumn(
        "workflow_type", F.coalesce("workflow_type", F.lit("*"))
    )


@query
def prefix_counts(spark, sf_dir):
    return files.prefix_counts(I.event_files(spark, sf_dir))


# --- pages, top lists ---------------------------------------------------------------------


@query
def split_pages(spark, sf_dir):
    return outputs.split_pages(_assembled(spark, sf_dir).select("doc_id", "text"))


@query
def split_part_pages(spark, sf_dir):
    """Parts of two pages each: numbers run on across parts."""
    parts = extract.assemble_pages(I.page_rows(spark, sf_dir), pages_per_part=2)
    return outputs.split_part_pages(parts)


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """Texts cut every ``size`` characters, wherever that is: (doc_id, part_no, text)."""
    return extract.chunk_text(rows, size=size).withColumnRenamed("chunk_no", "part_no")


@query
def split_cut_pages(spark, sf_dir):
    """Pages of documents cut every 150 characters, also inside markers."""
    whole = extract.concat_chunks(_assembled(spark, sf_dir).select("doc_id", F.col("part_no").alias("chunk_no"), "text"))
    return outputs.split_part_pages(_pieces(whole.select("doc_id", "text"), 150))


@query
def csv_parts_to_text(spark, sf_dir):
    """Every document as a CSV file with quoted cells, cut every 997 characters."""
    rows = _documents(spark, sf_dir).select("doc_id", F.expr(I.CSV_TEXT).alias("text"))
    return parts.csv_parts_to_text(_pieces(rows, 997), rows_per_chunk=20)


@query
def html_part_texts(spark, sf_dir):
    """Every page cut every 700 characters, its text put together again."""
    pages = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    texts = parts.html_part_texts(_pieces(pages, 700)).withColumnRenamed("part_no", "chunk_no")
    return extract.concat_chunks(texts, chunks_per_part=1 << 40).select(F.col("doc_id").alias("page_id"), "text")


@query
def decode_parts(spark, sf_dir):
    """The files of ``decode_text`` in parts of 100 bytes, cut inside characters and line ends."""
    files = _documents(spark, sf_dir).select("doc_id", _legacy_bytes().alias("content"))
    planned = ranges.byte_ranges(files.withColumn("size_bytes", F.octet_length("content").cast("long")), 100)
    cut = planned.withColumn("content", F.substr("content", F.col("offset").cast("int") + 1, F.col("length").cast("int")))
    texts = parts.decode_parts(cut).withColumnRenamed("part_no", "chunk_no")
    return extract.concat_chunks(texts, chunks_per_part=1 << 40).select("doc_id", "text")


@query
def read_parts(spark, sf_dir):
    """Stored documents and pages found by tasks and read in ranges of 1 000 bytes."""
    found = ranges.read_parts(spark, _stored_documents(spark, sf_dir), [".txt", ".html"], part_bytes=1_000)
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "content")))
    return found.groupBy("key", "size_bytes", "document_type").agg(
        F.count("content").alias("parts"), F.max("error").alias("error"), ordered.alias("_parts")
    ).select(
        "key", "size_bytes", "document_type", "parts", "error",
        F.sha2(F.aggregate("_parts.content", F.lit(b""), lambda a, b: F.concat(a, b)), 256).alias("sha"),
    )


@query
def scan_changes(spark, sf_dir):
    """Three runs over a store: documents, then half of the pages as well, then a third of the
    documents gone and a seventh of the pages written anew, longer."""
    base, manifest = new_folder(spark, "watched"), new_folder(spark, "manifest")
    texts = _documents(spark, sf_dir).select(
        "doc_id", F.format_string("txt/%02d/%d.txt", F.col("doc_id") % 20, F.col("doc_id")).alias("output_key"), "text"
    )
    pages = I.table(spark, sf_dir, "pages").select(
        "page_id", F.format_string("web/%d.html", F.col("page_id")).alias("output_key"), F.col("html").alias("text")
    )

    def put(rows: DataFrame) -> None:
        writers.write_objects(rows, base).write.mode("overwrite").format("noop").save()

    put(texts)
    first = listing.scan_changes(spark, base, manifest)
    put(pages.where("page_id % 2 = 0"))
    second = listing.scan_changes(spark, base, manifest)
    gone = texts.where("doc_id % 3 = 0").select(F.col("output_key").alias("key"))
    writers.delete_objects(gone, base).write.mode("overwrite").format("noop").save()
    put(pages.where("page_id % 14 = 0").withColumn("text", F.concat("text", F.lit("<!-- again -->"))))
    third = listing.scan_changes(spark, base, manifest)
    runs = [r.select(F.lit(n).cast("long").alias("run"), "key", "size_bytes", "document_type", "change") for n, r in enumerate((first, second, third), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query
def recent_jobs(spark, sf_dir):
    return outcomes.recent_jobs(I.runs(spark, sf_dir)).withColumns(
        {"start_time": _stamp(F.col("start_time")), "close_time": _stamp(F.col("close_time"))}
    )


# --- streams, events, status ------------------------------------------------------------------


@query
def folder_watch_stream(spark, sf_dir):
    """Stored documents and pages found by tasks, picked up as a stream and converted."""
    base = _stored_documents(spark, sf_dir)
    landed = new_folder(spark, "watch")
    types = ["txt", "html"]
    streams.start_folder_watch(
        readers.stream_found(
            spark, base, new_folder(spark, "watch-manifest"), new_folder(spark, "watch-feed"),
            readers.extensions_of(types), max_files=10_000,
        ),
        landed,
        new_folder(spark, "watch-log"),
        types=types,
        available_now=True,
    ).awaitTermination()
    return spark.read.parquet(landed).select(
        "key", "job_id", "document_type", "success", "output_key", "total_chars", "text"
    )


@query
def lifecycle_events(spark, sf_dir):
    told = outputs.lifecycle_events(I.event_jobs(spark, sf_dir), I.event_results(spark, sf_dir))
    return told.select("event", "job_id", "payload")


@query
def latest_status(spark, sf_dir):
    return outcomes.latest_status(I.status_log(I.table(spark, sf_dir, "events")))


@query
def latest_status_stream(spark, sf_dir):
    """The same from the events table read as a stream."""
    stream = I.table_stream(spark, sf_dir, "events")
    changes = new_folder(spark, "status")
    streams.start_latest_status(
        I.status_log(stream), changes, new_folder(spark, "status-log"), available_now=True
    ).awaitTermination()
    return streams.current_status(spark.read.parquet(changes))


@query
def latest_status_levels(spark, sf_dir):
    """The same without streaming state, in twelve micro-batches merged as they come together."""
    events = I.table(spark, sf_dir, "events")
    log = I.status_log(events)
    source, table = new_folder(spark, "status-source"), new_folder(spark, "status-levels")
    log.repartition(12, "event_id").write.parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    levels.start_status_levels(stream, table, new_folder(spark, "status-log"), fan=3, available_now=True).awaitTermination()
    return levels.status_now(spark, table, log.schema)


@query
def step_outcomes(spark, sf_dir):
    """The log as two streams: views start steps, purchases and errors end them, six hours at
    most. A last event far on lets the watermark pass all others."""
    events = I.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), "event_type", "ts")
    source = new_folder(spark, "steps")
    last = [events.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("job_id"), F.lit(t).alias("event_type"),
                          F.expr("ts + INTERVAL 400 DAYS").alias("ts")).limit(1) for t in ("view", "error")]
    events.unionByName(last[0]).unionByName(last[1]).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    started = stream.where("event_type = 'view'").select(F.col("event_id").alias("start_id"), "job_id", "ts")
    ended = stream.where("event_type IN ('purchase', 'error')").select("job_id", "ts", (F.col("event_type") == "purchase").alias("success"))
    table = new_folder(spark, "outcomes")
    streams.start_step_outcomes(
        started, ended, table, new_folder(spark, "outcomes-log"), available_now=True, limit="6 HOURS"
    ).awaitTermination()
    found = spark.read.parquet(table).where("job_id >= 0")
    return found.select("start_id", "job_id", "outcome", _stamp(F.col("finished_at")).alias("finished_at"))


@query
def dedupe_runs(spark, sf_dir):
    """``dedupe_jobs`` in three runs over a third of the log each, which share a key table."""
    log, table = I.status_log(I.table(spark, sf_dir, "events")).select("job_id", "ts", "event_id"), new_folder(spark, "keys")
    runs = [levels.first_seen(log.where(F.col("event_id") % 3 == k), table, k, ["ts", "event_id"], fan=2) for k in range(3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("job_id", "event_id")


@query
def dedupe_jobs(spark, sf_dir):
    log = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        "event_type",
        "ts",
        "event_id",
    )
    return jobs.dedupe_jobs(log, ["ts", "event_id"]).select("job_id", "event_type", "event_id")


@query
def dedupe_stream(spark, sf_dir):
    """The events table read as a stream of jobs, each job id let through once."""
    stream = I.table_stream(spark, sf_dir, "events")
    landed = new_folder(spark, "first-jobs")
    log = I.status_log(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    first = streams.dedupe_stream(log, "ts", within="3650 days").select("job_id")
    (
        first.writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", new_folder(spark, "first-jobs-log"))
        .start(landed).awaitTermination()
    )
    return spark.read.schema(first.schema).parquet(landed)


# --- end to end -------------------------------------------------------------------------------------


def _stored(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A job per row (name, case, text) and the store it points into: case 1 is CSV,
    2 of unknown type, 3 without a bucket, 4 lost; all others are text."""
    case, name = F.col("case"), F.col("name")
    key = F.concat(F.lit("in/"), name, F.lit(".txt"))
    kind = F.when(case == 1, "csv").when(case == 2, "rtf").otherwise("txt")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("doc-"), name).alias("job_id"),
            kind.alias("document_type"),
            F.lit("s3").alias("location_type"),
            F.when(case != 3, "inbox").otherwise("").alias("s3_bucket"),
            F.when(case == 4, F.concat(F.lit("lost/"), key)).otherwise(key).alias("s3_key"),
        )
    )
    accepted = jobs.validate_jobs(jobs.parse_jobs(cases.select(body.alias("value"))))
    return accepted, cases.select(key.alias("key"), _utf8(F.col("text")).alias("content"))


def _stored_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A good job per document; a few more jobs are bad."""
    number = F.col("doc_id")
    docs = _documents(spark, sf_dir)
    bad = docs.where(number % 50 < 3).select(
        F.concat(F.lit("bad-"), number.cast("string")).alias("name"), (2 + number % 50).alias("case"), "text"
    )
    good = docs.select(number.cast("string").alias("name"), (number % 2).alias("case"), "text")
    return _stored(good.unionByName(bad))


@query
def convert_batch(spark, sf_dir):
    return flows.convert_batch(*_stored_jobs(spark, sf_dir), I.OUTPUT_BUCKET, types=JOB_TYPES)


def _flow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text; a few more are empty."""
    docs = _documents(spark, sf_dir)
    number = F.col("doc_id").cast("string")
    empty = docs.where(F.col("doc_id") % 50 == 0).select(
        F.concat(F.lit("doc-empty-"), number).alias("job_id"), F.lit("").alias("text")
    )
    both = docs.select(F.concat(F.lit("doc-"), number).alias("job_id"), "text").unionByName(empty)
    return both.select("job_id", F.lit("txt").alias("document_type"), _utf8(F.col("text")).alias("content"))


def _flow_columns(flow: DataFrame) -> DataFrame:
    return flow.select(
        "job_id", "success", "error", "text_key", "metadata_key", "metadata", "total_chars",
        "pages_processed", "language_hint",
    )


@query
def document_flow(spark, sf_dir):
    return _flow_columns(flows.document_flow(_flow_documents(spark, sf_dir), I.GENERATED_AT, types=["txt"]))


@query
def flow_completed_events(spark, sf_dir):
    flow = flows.document_flow(_flow_documents(spark, sf_dir), I.GENERATED_AT, types=["txt"])
    return outputs.flow_completed_events(flow.where(F.col("success")))


@query
def multi_format_output(spark, sf_dir):
    docs = _assembled(spark, sf_dir).select(
        _conversation_job().alias("job_id"), F.lit("pdf").alias("document_type"), "text"
    )
    out = flows.multi_format_output(docs, I.OUTPUT_BUCKET, I.GENERATED_AT)
    listed = F.array_join(
        F.transform(F.map_entries("pages"), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        " ",
    )
    return out.withColumn("pages", listed).withColumn("analytics", F.to_json("analytics"))


def _inbox_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox files; those named as office files hold plain text and so fail."""
    return I.inbox(spark, sf_dir).select("key", _utf8(F.col("text")).alias("content"))


@query
def folder_watch(spark, sf_dir):
    run = flows.folder_watch(
        I.inbox(spark, sf_dir).drop("text"), _inbox_store(spark, sf_dir)
    )
    return run.results.select(
        "key", "success", "output_key", "total_chars", F.col("error").isNotNull().alias("failed")
    )


@query
def folder_watch_summary(spark, sf_dir):
    return flows.folder_watch(
        I.inbox(spark, sf_dir).drop("text"), _inbox_store(spark, sf_dir)
    ).summary


@query
def retry_escalation(spark, sf_dir):
    return flows.retry_escalation(*_extractions(spark, sf_dir), I.OUTPUT_BUCKET).select(
        "doc_id", "escalated", "attempt", "chosen", "total_chars", "output_bucket", "output_key"
    )


@query
def conversion_with_events(spark, sf_dir):
    return flows.conversion_with_events(*_stored_jobs(spark, sf_dir), I.OUTPUT_BUCKET, types=JOB_TYPES).select(
        "event", "job_id", "payload"
    )


@query
def maintenance(spark, sf_dir):
    return flows.maintenance(
        I.event_files(spark, sf_dir), _newest_event(spark, sf_dir), max_age_hours=24 * 7
    )
