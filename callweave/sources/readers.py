"""Readers for transcripts, recogniser output, call records, leads, analyses and upload listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave import constants as C
from callweave.functions.clean import normalize_mobile, trim_blank
from callweave.functions.text import detect_language, stt_language
from callweave.operators.calls import conform_cdr, crosswalk_table
from callweave.operators.calls_metadata import numeric_stem

LEAD_TYPE = T.StructType([T.StructField(f, T.LongType() if f == "age" else T.StringType()) for f in C.LEAD_FIELDS]
                         + [T.StructField("grounded_fields", T.ArrayType(T.StringType()))])
ANALYSIS_TYPE = T.StructType([
    T.StructField("call_id", T.StringType()), T.StructField("call_date", T.StringType()),
    T.StructField("lead", LEAD_TYPE), T.StructField("disposition", T.StringType()),
    T.StructField("disposition_confidence", T.DoubleType()), T.StructField("disposition_rationale", T.StringType()),
    T.StructField("sentiment", T.StringType()), T.StructField("sentiment_confidence", T.DoubleType()),
    T.StructField("escalation", T.BooleanType()), T.StructField("model", T.StringType()),
])
CALL_ID_IN_PATH = r"(?:call_id=([^/]+)/[^/]*|([^/]+?)(?:\.[^./]*)?)$"


def call_id_of(path: Column) -> Column:
    """Call id of a file: its ``call_id=`` folder, else its name without suffix."""
    found = [F.nullif(F.regexp_extract(path, CALL_ID_IN_PATH, i), F.lit("")) for i in (1, 2)]
    return F.coalesce(*found)


# --- transcripts -------------------------------------------------------------------
def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, value): one row per file of a folder tree."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        call_id_of(F.col("_metadata.file_path")).alias("call_id"), "value")


BUNDLE = "call_id string, value string"


def bundled_files(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, value): the files of a folder of bundles, JSON lines that hold the call id and the text of one file each.

    A file a call costs a listing, an opening and a task's attention each; uploads by the hundred thousand are bundled first.
    """
    return spark.read.schema(BUNDLE).json(path)


def speaker_label(c: Column) -> Column:
    token = F.upper(trim_blank(c))
    return (F.when(token.isin(C.AGENT_ALIASES), F.lit("AGENT")).when(token.isin(C.CUSTOMER_ALIASES), F.lit("CUSTOMER"))
            .otherwise(F.lit("UNKNOWN")))


def transcript_turns(files: DataFrame) -> DataFrame:
    """Turns of transcript files with a ``reject`` reason (null for good turns).

    A file must be a JSON list; turns that are no object, have no text or a
    confidence outside [0, 1] are rejected one by one.
    """
    turns = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    opened = files.select("call_id", F.posexplode_outer(turns).alias("idx", "item"), turns.isNull().alias("no_list"))
    get = lambda f, k="string": F.try_variant_get("item", f"$.{f}", k)
    text = trim_blank(F.coalesce(get("text"), F.lit("")))
    given = F.lower(trim_blank(get("language")))
    shaped = opened.where("no_list or idx is not null").select(
        "call_id", F.col("idx").cast("bigint").alias("idx"), "no_list", F.schema_of_variant("item").alias("kind"),
        speaker_label(get("speaker")).alias("speaker"),
        F.coalesce(get("start_ts", "double"), F.lit(0.0)).alias("start_ts"),
        F.coalesce(get("end_ts", "double"), F.lit(0.0)).alias("end_ts"), text.alias("text"), given.alias("given"),
        F.coalesce(get("confidence", "double"), F.lit(1.0)).alias("confidence"), F.to_json(get("words", "variant")).alias("words"))
    reject = (
        F.when(F.col("no_list"), F.lit("not_a_list"))
        .when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), F.lit("not_an_object"))
        .when(F.col("text") == "", F.lit("empty_text"))
        .when(~F.col("confidence").between(0.0, 1.0), F.lit("bad_confidence")))
    language = F.when(F.col("given").isin(C.LANGUAGES), F.col("given")).otherwise(detect_language(F.col("text")))
    return shaped.select(
        "call_id", "idx", "speaker", "start_ts", "end_ts", "text", language.alias("language"), "confidence",
        F.when(F.col("words").startswith("["), F.col("words")).alias("words"), reject.alias("reject"))


def read_transcripts(spark: SparkSession, path: str, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(utterances, rejects) of a folder of transcript JSON files, or of bundles of them."""
    turns = transcript_turns((bundled_files if bundled else whole_files)(spark, path))
    return turns.where("reject is null").drop("reject"), turns.where("reject is not null").select("call_id", "idx", "reject")


def read_line_transcripts(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """``SPEAKER [mm:ss]: text`` files; a turn ends where the next one starts.

    Lines of one file stay together in one row, so order is the file's own.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    shape = r"^\s*([A-Za-z_0-9]+)\s*\[(\d+):(\d{2})\]:\s?(.*)$"
    marked = F.filter(lines, lambda x: x.rlike(shape))
    seconds = lambda x: (F.regexp_extract(x, shape, 2).cast("double") * 60 + F.regexp_extract(x, shape, 3).cast("double"))
    turns = F.transform(marked, lambda x, i: F.struct(
        i.cast("bigint").alias("idx"), speaker_label(F.regexp_extract(x, shape, 1)).alias("speaker"), seconds(x).alias("start_ts"),
        seconds(F.get(marked, i + 1)).alias("end_ts"), F.regexp_extract(x, shape, 4).alias("text")))
    rows = (bundled_files if bundled else whole_files)(spark, path).select("call_id", F.inline(turns))
    return rows.withColumn("end_ts", F.coalesce("end_ts", "start_ts"))


# --- recogniser output -------------------------------------------------------------
def diarized_utterances(payloads: DataFrame) -> DataFrame:
    """Hosted recogniser payloads (call_id, payload, duration_seconds) as utterances.

    Diarized entries when any has text, else one turn from the flat transcript.
    """
    doc = F.try_parse_json("payload")
    get = lambda col, f, k="string": F.try_variant_get(col, f"$.{f}", k)
    entries = F.coalesce(get("doc", "diarized_transcript.entries", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    kept = F.filter(F.transform(entries, lambda e: F.struct(
        trim_blank(F.coalesce(get(e, "transcript"), F.lit(""))).alias("text"), get(e, "speaker_id").alias("speaker_id"),
        F.coalesce(get(e, "start_time_seconds", "double"), F.lit(0.0)).alias("start_ts"),
        F.coalesce(get(e, "end_time_seconds", "double"), F.lit(0.0)).alias("end_ts"))), lambda x: x["text"] != "")
    flat = F.struct(trim_blank(F.coalesce(get("doc", "transcript"), F.lit(""))).alias("text"), F.lit(None).cast("string").alias("speaker_id"),
                    F.lit(0.0).alias("start_ts"), F.col("duration_seconds").alias("end_ts"))
    staged = payloads.withColumn("doc", doc).withColumn("kept", kept)
    turns = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.filter(F.array(flat), lambda x: x["text"] != ""))
    rows = staged.select("call_id", get("doc", "language_code").alias("code"), F.posexplode(turns).alias("idx", "t"))
    return rows.select(
        "call_id", F.col("idx").cast("bigint").alias("idx"), F.lit("UNKNOWN").alias("speaker"), "t.speaker_id", "t.start_ts", "t.end_ts", "t.text",
        stt_language(F.col("code"), F.col("t.text"), redetect_other=False).alias("language"), F.lit(C.DIARIZED_CONFIDENCE).alias("confidence"))


def segment_utterances(segments: DataFrame) -> DataFrame:
    """Recogniser segments as utterances; confidence from the mean log-probability."""
    confidence = F.when(F.col("avg_logprob").isNull(), F.lit(C.SEGMENT_DEFAULT_CONFIDENCE)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp("avg_logprob"))))
    rows = segments.withColumn("text", trim_blank(F.coalesce("text", F.lit("")))).where("text <> ''")
    return rows.select("call_id", "idx", F.lit("UNKNOWN").alias("speaker"), F.coalesce("start", F.lit(0.0)).alias("start_ts"),
                       F.coalesce("stop", F.lit(0.0)).alias("end_ts"), "text",
                       stt_language(F.col("language_code"), F.col("text"), redetect_other=True).alias("language"),
                       confidence.alias("confidence"))


# --- call records, leads, analyses ------------------------------------------------------
def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, quoted line breaks kept, with ``ordinal``: the place of the row by file and row."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def read_cdr(spark: SparkSession, path: str, columns: dict[str, str] = C.CDR_COLUMNS) -> DataFrame:
    """Call-detail CSV, every cell text, typed by :func:`conform_cdr`; ``ordinal`` orders rows for :func:`last_wins`."""
    return conform_cdr(_csv(spark, path), columns)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads CSV with the normalised mobile and ``ordinal`` for first-seen order."""
    return _csv(spark, path).withColumn("_norm_mobile", normalize_mobile(F.col("MOBILE_NO")))


def crosswalk(spark: SparkSession) -> DataFrame:
    return crosswalk_table(spark)


def read_analyses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Analysis documents with an explicit schema; the id falls back to the file stem, the lead's fields become columns.

    A file is one document, laid out in any way, or with ``lines`` one document per line.  Files and lines that are no JSON
    are left out.
    """
    kind = T.StructType([*ANALYSIS_TYPE.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=not lines)
    rows = rows.withColumn("call_id", F.coalesce("call_id", call_id_of(F.col("_metadata.file_path")))).where(F.col("_broken").isNull())
    flat = [F.col(f"lead.{name}") for name in ANALYSIS_TYPE["lead"].dataType.names]
    return rows.select(*[c for c in ANALYSIS_TYPE.names if c != "lead"], *flat)


# --- upload listing --------------------------------------------------------------------
def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files below a folder; their content is never read.

    Spark leaves empty files out of every file scan, so an outside inventory is
    needed to see those rejected.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def classify_uploads(listing: DataFrame, is_transcript: bool | None = None, most_bytes: int = C.UPLOAD_MAX_BYTES) -> DataFrame:
    """Accept or reject listed files: known suffix, not empty, not too large."""
    name = F.trim(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1))
    named = listing.withColumn("name", F.when(name == "", F.lit("upload")).otherwise(name))
    suffix = F.lower(F.regexp_extract("name", r"[^.](\.[^.]+)$", 1))
    kind = F.when(suffix.isin(C.TRANSCRIPT_EXTENSIONS), F.lit(True)).when(suffix.isin(C.AUDIO_EXTENSIONS), F.lit(False))
    reason = (F.when(kind.isNull(), F.lit("unsupported_media_type")).when(F.col("length") > most_bytes, F.lit("file_too_large"))
              .when(F.col("length") == 0, F.lit("empty_file")))
    chosen = kind if is_transcript is None else F.when(kind.isNotNull(), F.lit(is_transcript))
    return named.select("path", "name", chosen.alias("is_transcript"), numeric_stem(F.col("name")).alias("recording_id"),
                        reason.isNull().alias("accepted"), reason.alias("reason"))


def split_source_uri(c: Column) -> list[Column]:
    """Scheme, bucket and key of an object-store address; null for other schemes."""
    scheme = F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))
    known = scheme.isin("minio", "s3")
    return [F.when(known, scheme).alias("scheme"), F.when(known, F.try_parse_url(c, F.lit("HOST"))).alias("bucket"),
            F.when(known, F.ltrim(F.try_parse_url(c, F.lit("PATH")), F.lit("/"))).alias("key")]
