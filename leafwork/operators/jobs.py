"""Job messages: parse, check, route, name their outputs, drop repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import text as T
from leafwork.functions.paths import base_name, literal_map, or_default

TEXT_FIELDS = [
    "s3_bucket", "s3_key", "s3_endpoint_url", "url", "ftp_host", "ftp_path",
    "output_s3_bucket", "output_s3_key",
]
# Fields that hold text or null; anything else is an error.
CHECKED_TEXT_FIELDS = ["job_id", *TEXT_FIELDS, "ftp_user", "auth_username", *C.SECRET_FIELDS]
INTEGER_PATTERN = r"\A\s*[+-]?[0-9]+(?:\.0+)?\s*\z"
# A secret in text that is no JSON object: its value, or all that follows the start of a list.
SECRET_PATTERN = (
    r"(?s)(\"(?:" + "|".join(C.SECRET_FIELDS) + r")\"\s*:\s*)(?:\"(?:[^\"\\]++|\\.)*+\"?|[\[{].*|[^,}\s]++)"
)


def mask_secrets(raw: Column) -> Column:
    return F.regexp_replace(raw, SECRET_PATTERN, '$1"***"')


def _masked_object(raw: Column, keys: Column, values: Column) -> Column:
    """A JSON object without its secrets: masked where they stand, put together again if one
    is a list or an object, or its name is spelled so that the pattern does not see it."""
    shown = F.zip_with(
        keys,
        values,
        lambda k, v: F.concat(
            F.regexp_extract(F.to_json(F.array(k)), r"(?s)\A\[(.*)\]\z", 1), F.lit(":"),
            F.when(k.isin(C.SECRET_FIELDS), '"***"').otherwise(F.to_json(v)),
        ),
    )
    secret = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isin(C.SECRET_FIELDS))
    nested = F.exists(secret, lambda e: F.schema_of_variant(e["v"]).rlike("^(?:ARRAY|OBJECT)"))
    seen = F.size(secret) == F.regexp_count(raw, F.lit(SECRET_PATTERN))
    again = F.concat(F.lit("{"), F.array_join(F.reverse(shown), ","), F.lit("}"))
    return F.when(seen & ~nested, mask_secrets(raw)).otherwise(again)


def _json_object(raw: Column) -> Column:
    """The members of ``raw`` if it is one JSON object and nothing else, null otherwise.

    Readers stop at the end of a value, so what follows it is seen only from outside: text
    that closes a list around it early cannot close an object too.
    """
    listed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,variant>>")
    member = F.from_json(F.concat(F.lit('{"m":'), raw, F.lit("}")), "m map<string,variant>")["m"]
    whole = raw.rlike(r"\A\s*\{") & member.isNotNull()
    return F.when(whole, T.let(listed, lambda o: F.when(F.size(o) == 1, F.get(o, 0))))


def stable_id(value: Column) -> Column:
    """Twelve hex characters that depend on the message only, so a replay of
    the same message gets the same id."""
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 12)


def _enum_error(name: str, value: Column, allowed: list[str]) -> Column:
    return F.when(value.isNull(), F.lit(f"{name} is required")).when(
        ~value.isin(allowed), F.concat(F.lit(f"unknown {name}: "), value)
    )


def parse_jobs(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to typed job rows; rejects keep ``raw`` (masked) and ``error``.

    A message is one JSON object; of members of one name the last counts. Unknown fields are ignored, ``ftp_port`` accepts numeric text, absent
    ``ftp_port`` and ``auth_type`` take their defaults while an explicit null is
    an error. Credentials never leave this step. Other input columns are kept.
    """
    kept = [c for c in messages.columns if c != value]
    raw = F.col(value).cast("string")
    # Members from the last to the first: the first found is the last given.
    members = T.let(
        _json_object(raw),
        lambda o: F.struct(
            raw.alias("_raw"), F.reverse(F.map_keys(o)).alias("_keys"), F.reverse(F.map_values(o)).alias("_values")
        ),
    )
    parsed = messages.select(*kept, members.alias("_parsed"))
    # Reading the parsed struct through a generator stops later filters from
    # being pushed below it, which would parse the text again for every field.
    fields = parsed.select(*kept, F.inline_outer(F.array("_parsed")))
    f = F.col("_keys")

    def member(name: str) -> str:
        return f"get(_values, CAST(array_position(_keys, '{name}') AS INT) - 1)"

    def value_of(name: str) -> Column:
        return F.expr(f"try_variant_get({member(name)}, '$', 'string')")

    def not_text(name: str) -> Column:
        return F.expr(
            f"CASE WHEN schema_of_variant({member(name)}) NOT IN ('STRING', 'VOID') "
            f"THEN '{name} is not text' END"
        )

    port_given = F.array_contains(f, F.lit("ftp_port"))
    auth_given = F.array_contains(f, F.lit("auth_type"))
    port = F.regexp_extract(value_of("ftp_port"), r"([+-]?[0-9]+)", 1).try_cast("int")
    error = (
        F.when(f.isNull(), F.lit("message is not a JSON object")).otherwise(
            F.coalesce(
                _enum_error("document_type", value_of("document_type"), C.DOCUMENT_TYPES),
                _enum_error("location_type", value_of("location_type"), C.LOCATION_TYPES),
                F.when(
                    auth_given, _enum_error("auth_type", value_of("auth_type"), C.AUTH_TYPES)
                ),
                F.when(
                    port_given
                    & ~F.coalesce(value_of("ftp_port").rlike(INTEGER_PATTERN), F.lit(False)),
                    F.lit("ftp_port is not an integer"),
                ),
                F.when(port_given & port.isNull(), F.lit("ftp_port is out of range")),
                *[not_text(name) for name in CHECKED_TEXT_FIELDS],
            )
        )
    )
    return (
        fields.withColumn("error", error)
        .select(
            *kept,
            or_default(value_of("job_id"), stable_id(F.col("_raw"))).alias("job_id"),
            value_of("document_type").alias("document_type"),
            value_of("location_type").alias("location_type"),
            *[value_of(name).alias(name) for name in TEXT_FIELDS],
            F.coalesce(port, F.lit(C.DEFAULT_FTP_PORT)).alias("ftp_port"),
            F.when(F.col("error").isNull(), F.coalesce(value_of("auth_type"), F.lit("none"))).alias(
                "auth_type"
            ),
            F.when(
                F.col("error").isNotNull(),
                F.when(
                    F.arrays_overlap(f, T.literal_array(C.SECRET_FIELDS)), _masked_object(F.col("_raw"), f, F.col("_values"))
                ).otherwise(
                    F.when(f.isNull(), mask_secrets(F.col("_raw"))).otherwise(F.col("_raw"))
                ),
            ).alias("raw"),
            F.col("error"),
        )
    )


def expand_batches(messages: DataFrame, value: str = "value") -> DataFrame:
    """A message holding a JSON array of jobs becomes one message per job."""
    kept = [c for c in messages.columns if c != value]
    raw = F.col(value).cast("string")
    as_array = F.when(raw.rlike(r"\A\s*\["), F.from_json(raw, "array<string>"))
    return messages.select(
        *kept, F.explode_outer(F.coalesce(as_array, F.array(raw))).alias(value)
    )


def validate_jobs(jobs: DataFrame, local_path: str | None = None) -> DataFrame:
    """Check the fields each location needs; an earlier error is kept.

    Rows with a non-empty ``local_path`` column skip the location checks.
    """

    def missing(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).isNull()

    location = F.col("location_type")
    rule = (
        F.when(location == "local", F.lit("LOCAL location requires a local_file_path"))
        .when(
            (location == "s3") & (missing("s3_bucket") | missing("s3_key")),
            F.lit("s3_bucket and s3_key are required for S3 location"),
        )
        .when((location == "url") & missing("url"), F.lit("url is required for URL location"))
        .when(
            (location == "ftp") & (missing("ftp_host") | missing("ftp_path")),
            F.lit("ftp_host and ftp_path are required for FTP location"),
        )
    )
    if local_path is not None:
        rule = F.when(missing(local_path), rule)
    prior = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumn("error", F.coalesce(prior, rule))


def split_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the ``error`` column."""
    return jobs.where(F.col("error").isNull()), jobs.where(F.col("error").isNotNull())


def route_converter(jobs: DataFrame) -> DataFrame:
    """Add the converter family; an unknown type becomes an error."""
    family = F.try_element_at(literal_map(C.CONVERTER_FAMILIES), F.col("document_type"))
    unsupported = F.when(
        family.isNull(),
        F.concat(
            F.lit("Unsupported document type: "), F.coalesce(F.col("document_type"), F.lit(""))
        ),
    )
    prior = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumn("converter", family).withColumn(
        "error", F.coalesce(prior, unsupported)
    )


# --- output keys ------------------------------------------------------------


def text_key(job_id: Column, override: Column | None = None) -> Column:
    key = F.concat(F.lit(C.CONVERTED_PREFIX), job_id, F.lit(".txt"))
    return key if override is None else or_default(override, key)


def watch_key(source_key: Column, prefix: str = C.CONVERTED_PREFIX) -> Column:
    """The old extension stays: ``report.pdf`` gives ``report.pdf.txt``."""
    return F.concat(F.lit(prefix), base_name(source_key), F.lit(".txt"))


def watch_job_id(source_key: Column) -> Column:
    return F.concat(F.lit(C.WATCH_JOB_PREFIX), F.replace(source_key, F.lit("/"), F.lit("-")))


def archive_key(source_key: Column, prefix: str = C.PROCESSED_PREFIX) -> Column:
    return F.concat(F.lit(prefix), base_name(source_key))


def flow_key(job_id: Column, name: str, prefix: str = C.FLOW_PREFIX) -> Column:
    return F.concat(F.lit(prefix), job_id, F.lit("/" + name))


def page_key(job_id: Column, page_no: Column, prefix: str = C.MULTI_PREFIX) -> Column:
    """The job id appears twice, before and after ``pages``."""
    return F.concat(
        F.lit(prefix), job_id, F.lit("/pages/"), job_id, F.lit("/"),
        F.format_string("page_%04d.txt", page_no),
    )


def object_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def output_keys(jobs: DataFrame, default_bucket: str) -> DataFrame:
    """Every key a job's outputs are written under."""
    job, key = F.col("job_id"), F.col("s3_key")
    return jobs.select(
        "job_id",
        or_default(F.col("output_s3_bucket"), F.lit(default_bucket)).alias("output_bucket"),
        text_key(job, F.col("output_s3_key")).alias("output_key"),
        watch_job_id(key).alias("watch_job_id"),
        watch_key(key).alias("watch_key"),
        archive_key(key).alias("archive_key"),
        flow_key(job, "text.txt").alias("flow_text_key"),
        flow_key(job, "metadata.json").alias("flow_metadata_key"),
        flow_key(job, "full_text.txt", C.MULTI_PREFIX).alias("full_text_key"),
        flow_key(job, "metadata.json", C.MULTI_PREFIX).alias("multi_metadata_key"),
        page_key(job, F.lit(1)).alias("first_page_key"),
    )


def key_collisions(keys: DataFrame, key: str = "output_key") -> DataFrame:
    """Keys more than one row would be written under. The count combines before
    the shuffle, so one very common key stays cheap."""
    return keys.groupBy(key).agg(F.count(F.lit(1)).alias("writers")).where(F.col("writers") > 1)


def dedupe_jobs(jobs: DataFrame, order_by: list[str], key: str = "job_id") -> DataFrame:
    """The earliest row per job id.

    An aggregate rather than a window: every task keeps one row per id before
    the shuffle, so an id that fills a third of the table moves a few rows.
    """
    first = F.min_by(F.struct(*jobs.columns), F.struct(*order_by)).alias("first")
    return jobs.groupBy(F.col(key).alias("_key")).agg(first).select("first.*")
