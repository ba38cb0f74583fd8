"""Sources: every layout the engine reads, as lazily scanned DataFrames with explicit schemas."""


from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pystrip

SENTENCES = "sentence string"
ARTICLES = "id string, article string, abstract string"
MULTI_DOCUMENT = "single_documents array<struct<raw_text: string>>, summary string"
SHARDS = "src_txt array<string>, tgt_txt string"
SAMPLES = "sampleId string, input string, outputs array<struct<content: string, metadata: struct<generator: string>>>, createdAt timestamp, updatedAt timestamp"
GENERATED = "sampleId string, input string, output string"


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a malformed line is an error. Otherwise it becomes a row with the line in `_corrupt_record`."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    kind = schema if strict else f"{schema}, _corrupt_record string"
    return spark.read.schema(kind).option("mode", mode).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """A record store: Parquet with an explicit ordinal `row_id`."""
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: str | None = None, line_breaks: bool = True) -> DataFrame:
    """RFC 4180 CSV as strings: quotes doubled inside quotes, line breaks inside quotes; a last record without a line end counts.
    A file whose fields may hold line breaks is one task; without `line_breaks` it is split."""
    if len(sep) != 1:
        raise ValueError("sep must be one character")
    reader = spark.read.option("header", header).option("multiLine", line_breaks).option("quote", '"').option("escape", '"').option("sep", sep).option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


FORMATS = ("json", "jsonlines", "records", "csv")


def load(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A scan chosen by the name of its format; an unknown name is an error."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {FORMATS}")
    if kind == "records":
        return records(spark, path)
    if kind == "csv":
        return csv(spark, path, schema=schema)
    if schema is None:
        raise ValueError("a JSON scan needs a schema")
    return json_array(spark, path, schema) if kind == "json" else jsonl(spark, path, schema)


def in_memory(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A list of records as a dataset, with their places as `row_id`."""
    numbered = [{"row_id": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, f"row_id long, {schema}")


def sentences(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, SENTENCES).where("sentence <> ''")


def multi_document(spark: SparkSession, path: str) -> DataFrame:
    """input (all documents' texts, joined by a space), output."""
    raw = jsonl(spark, path, MULTI_DOCUMENT)
    return raw.select(F.array_join(F.transform("single_documents", lambda d: d["raw_text"]), " ").alias("input"), F.col("summary").alias("output"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: every file below a folder, whole."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def tree_order(path: Column) -> Column:
    """A key in whose order a tree is walked: of each folder first its folders, then its files, both by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.concat(F.when(i < F.size(parts) - 1, "0").otherwise("1"), x))


def labelled(files: DataFrame) -> DataFrame:
    """path, input, output of files with 'Summary: ...\\nContent:\\n...'; others are dropped. Order is by path, if asked for."""
    pattern = r"(?s)Summary: (.*?)\nContent:\n(.*)"
    hit = files.where(F.regexp_like("value", F.lit(pattern)))
    return hit.select("path", pystrip(F.regexp_extract("value", pattern, 2)).alias("input"), pystrip(F.regexp_extract("value", pattern, 1)).alias("output"))


def segmented(files: DataFrame) -> DataFrame:
    """path, input, output of files whose parts stand between blank lines: the second is the summary, the third the text."""
    parts = F.split(F.regexp_replace("value", r"[^\S\n]+(?=\n|$)", ""), "\n\n")
    return files.select("path", F.get(parts, F.lit(2)).alias("input"), F.get(parts, F.lit(1)).alias("output"))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """input (sentences joined by a space), output, of JSON-lines shards."""
    raw = jsonl(spark, path, SHARDS)
    return raw.select(F.array_join("src_txt", " ").alias("input"), F.col("tgt_txt").alias("output"))


def rankings(lines: DataFrame, value: str = "value") -> DataFrame:
    """`lines` with `ranking`: '2, 1, 3' as integers; white space around them does not matter."""
    return lines.withColumn("ranking", F.transform(F.split(value, ","), lambda x: pystrip(x).cast("int")))


def lines(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """value: stripped lines; blank ones are dropped unless kept. For worker pools and key files, which stay out of tables."""
    out = spark.read.text(path).select(pystrip(F.col("value")).alias("value"))
    return out if keep_empty else out.where("value <> ''")


def index_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, idx of a file that holds one JSON list of ordinals."""
    value = spark.read.text(path, wholetext=True)
    return value.select(F.posexplode(F.from_json("value", "array<bigint>")).alias("pos", "idx"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, model, completion of a tree <sample>/<model>.txt; prompts are left out."""
    parts = F.split("path", "/")
    model = F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "")
    rows = whole_files(spark, path).where(F.endswith("path", F.lit(".txt")))
    return rows.select(F.element_at(parts, -2).alias("sample_id"), model.alias("model"), F.col("value").alias("completion")).where("model <> 'prompt'")


def processed_ids(spark: SparkSession, path: str, id: str, schema: str) -> DataFrame:
    """The distinct ids of an earlier run's output; none where there is no output yet."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).select(id)
    return jsonl(spark, path, schema).select(id).distinct()


def document_store_uri(host: str, port: int, user: str | None = None, password: str | None = None) -> str:
    """A document database's address with escaped credentials."""
    login = f"{quote_plus(user)}:{quote_plus(password or '')}@" if user else ""
    return f"mongodb://{login}{host}:{port}"


def document_store(spark: SparkSession, uri: str, database: str, collection: str, schema: str) -> DataFrame:
    """All documents of a collection. Needs the store's Spark connector on the class path; without it, Spark says so."""
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection)
    return reader.schema(schema).load()


def mapped_strings(column: Column, kind: T.DataType, f) -> Column:
    """A nested value with `f` put on every string in it that is not empty; map keys, nulls and other types stay."""
    if isinstance(kind, T.StringType):
        return F.when(column != "", f(column)).otherwise(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: mapped_strings(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: mapped_strings(v, kind.valueType, f))
    if isinstance(kind, T.StructType):
        fields = [mapped_strings(column[x.name], x.dataType, f).alias(x.name) for x in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def with_mapped_strings(frame: DataFrame, f) -> DataFrame:
    """Every column of `frame`, with `f` on all strings inside."""
    return frame.select(*(mapped_strings(F.col(x.name), x.dataType, f).alias(x.name) for x in frame.schema.fields))
