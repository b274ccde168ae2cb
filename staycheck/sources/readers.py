"""Sources. Schemas are declared, never inferred."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycheck.operators.ranking import ranked

RESERVATION = (
    "submission_id string, reservation_id string, hotel_id string, guest_ref string, "
    "nationality_iso2 string, adults int, children int, rooms int, nights int, room_nights int, "
    "arrival_date date, departure_date date, status string, rate_code string")
NODE = (
    "run_id string, seq bigint, node string, phase string, outcome string, duration_ms bigint, "
    "model_calls bigint, input_tokens bigint, output_tokens bigint, detail string")
TRACE = (
    "run_id string, seq bigint, agent string, prompt_version string, input_tokens bigint, "
    "output_tokens bigint, cache_read_tokens bigint, duration_ms bigint, output_json string, "
    "error string, tool_calls array<struct<name:string,allowed:boolean>>")
ROUTING = ("run_id string, seq bigint, node string, agent string, disposition string, "
           "needed boolean, reason string")


def read_reservations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows that can be read; reservation_defects has the others of a CSV file."""
    if fmt == "csv":
        return _reservation_lines(spark, path).filter(F.size("unreadable") == 0).drop("unreadable", "file")
    return spark.read.schema(RESERVATION).format(fmt).load(path)


def reservation_defects(spark: SparkSession, path: str) -> DataFrame:
    """CSV lines that lack a value, or hold one of another type: file, ids and the columns concerned."""
    return _reservation_lines(spark, path).filter(F.size("unreadable") > 0).select(
        "submission_id", "file", "reservation_id", "unreadable")


def _reservation_lines(spark: SparkSession, path: str) -> DataFrame:
    kinds = dict(c.split() for c in RESERVATION.split(", "))
    raw = spark.read.schema(", ".join(f"{c} string" for c in kinds)).option("header", True).csv(path)
    parsed = {c: F.col(c).try_cast(kind) for c, kind in kinds.items()}
    bad = F.array_compact(F.array(*[F.when(value.isNull(), c) for c, value in parsed.items()]))
    return raw.withColumns({"unreadable": bad, "file": F.substring_index("_metadata.file_path", "/", -1)}
                           ).withColumns(parsed)


INVENTORY_COLUMNS = {"hotel_id", "day", "rooms_total", "rooms_out_of_order"}


INVENTORY_FIELDS = ("submission_id", "hotel_id", "day", "rooms_total", "rooms_out_of_order", "rooms_available", "note")
MAX_COLUMNS = 64


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, with their file and place."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id")).filter("trim(value) <> ''")
    return lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number below the header of their file (the header is 0).

    Lines are numbered inside each split and the splits of a file are added up, so a large file is not
    gathered in one task."""
    numbered = ranked(lines, ["_path"], ["_start"], ["_id"], "_n")
    return numbered.select("_path", (F.col("_n") - 1).cast("int").alias("row_no"), "value")


def _cells() -> Column:
    """The cells of a line. They are read as one array after the line is parsed: asked for one by one, Spark
    would parse the line for each of them."""
    schema = ", ".join(f"c{i} string" for i in range(MAX_COLUMNS))
    return F.transform(F.array(F.from_csv(_filled(), F.lit(schema))), lambda c: F.array(*[c[f"c{i}"] for i in range(MAX_COLUMNS)]))[0]


def _filled() -> Column:
    """The line with as many empty cells at its end as the schema has columns more than it: they are read as null,
    as the missing ones are, but a line of another length is malformed to Spark, which takes some fifteen times as
    long. A line whose quotes aren't plain (each around a whole cell, none inside) or that has a backslash stays as
    it is, since its end may lie inside a quoted cell."""
    plain = F.regexp_replace("value", r'(^|,)"[^"\\]*"(?=,|\z)', "$1")
    commas = F.length(plain) - F.length(F.translate(plain, ",", ""))
    return F.when(~plain.rlike(r'["\\]') & (commas < MAX_COLUMNS), F.concat(
        "value", F.repeat(F.lit(","), F.lit(MAX_COLUMNS - 1) - commas))).otherwise(F.col("value"))


def _headers(lines: DataFrame) -> DataFrame:
    """The first line of each file, in lower case."""
    first = lines.groupBy("_path").agg(F.min_by("value", F.struct("_start", "_id")).alias("value"))
    return first.select("_path", F.transform(_cells(), lambda c: F.lower(F.trim(c))).alias("header"))


def _layouts(lines: DataFrame) -> DataFrame:
    """What each file's header says, worked out once a file and not for each of its lines: file, _path, the required
    columns it lacks (missing), the columns it names twice (repeated) and the place of each column (at; null:
    absent)."""
    fields = F.array(*[F.lit(c) for c in INVENTORY_FIELDS])
    required = F.array(*[F.lit(c) for c in sorted(INVENTORY_COLUMNS)])
    return _headers(lines).select(
        F.substring_index("_path", "/", -1).alias("file"), "_path", F.array_except(required, "header").alias("missing"),
        F.array_sort(F.filter(fields, lambda c: F.size(F.filter("header", lambda h: h == c)) > 1)).alias("repeated"),
        F.struct(*[F.nullif(F.array_position("header", c).cast("int"), F.lit(0)).alias(c) for c in INVENTORY_FIELDS]).alias("at"))


def inventory_defects(spark: SparkSession, path: str) -> DataFrame:
    """Inventory files whose header lacks a required column, or names one twice: file, _path, missing, repeated.
    They give no rows."""
    named = _layouts(_raw_lines(spark, path))
    return named.filter((F.size("missing") > 0) | (F.size("repeated") > 0)).select("file", "_path", "missing", "repeated")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Daily inventory files with the 1-based number of each data row in its file.

    Columns are placed by each file's own header, so files may order and extend them as they like; a file
    that lacks one gives no rows (inventory_defects names it) and stops no other. A hotel files for itself
    where no submission_id column says otherwise.
    """
    lines = _raw_lines(spark, path)
    good = _layouts(lines).filter((F.size("missing") == 0) & (F.size("repeated") == 0)).select("_path", "file", "at")
    placed = _numbered(lines).filter("row_no > 0").withColumn("cells", _cells()).drop("value").join(good, "_path")

    def cell(name: str) -> Column:
        return F.try_element_at("cells", F.col("at")[name])

    raw = placed.select(
        F.coalesce(cell("submission_id"), cell("hotel_id")).alias("submission_id"),
        *[cell(c).alias(c) for c in INVENTORY_FIELDS[1:]], "file", "row_no")
    return parse_inventory(raw)


def parse_inventory(raw: DataFrame) -> DataFrame:
    """Inventory text to values; `unreadable` names the cells that hold something else, so a bad
    figure is never mistaken for an absent one."""
    rooms = ("rooms_total", "rooms_out_of_order", "rooms_available")
    parsed = {c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("int")) for c in rooms}
    parsed["day"] = F.when(F.col("day").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("day", "yyyy-MM-dd"))
    bad = [F.when((F.trim(c) != "") & value.isNull(), c) for c, value in parsed.items()]
    return raw.withColumn("unreadable", F.array_compact(F.array(*bad))).withColumns(parsed)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth documents, one JSON file each, as (hotel_id, metric_key, value)."""
    docs = spark.read.schema("hotel_id string, metrics map<string,decimal(38,10)>").option(
        "multiLine", True).json(path)
    return docs.select("hotel_id", F.explode("metrics").alias("metric_key", "value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no (from 1) of the lines below a folder, files in the order of their names: the order
    write_json_lines gave them. Lines are counted per split, so no task holds a whole file."""
    lines = spark.read.text(path).select(
        "value", F.lit(0).alias("_all"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    return ranked(lines, ["_all"], ["_path", "_start"], ["_id"], "line_no").select("value", "line_no")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTING).json(path)


def discover_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with name, size and content, ready for intake."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", "length",
                        "content")
