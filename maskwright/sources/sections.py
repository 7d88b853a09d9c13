"""Reading text units: ``session, seq, section, role, surface, field_name, text``."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import MARK, fence, hits

SECTIONS = (
    "session string, seq bigint, section int, role string, surface string, "
    "field_name string, text string"
)


def read_sections(
    spark: SparkSession, path: str, *, session: str, seq: str, text: str,
    role: str | None = None, format: str = "parquet", stream_schema=None,
) -> DataFrame:
    """Any table as sections; with ``stream_schema``, as a stream."""
    reader = spark.readStream.schema(stream_schema) if stream_schema else spark.read
    rows = reader.format(format).load(path)
    return rows.select(
        F.expr(session).cast("string").alias("session"),
        F.expr(seq).cast("bigint").alias("seq"),
        F.lit(0).alias("section"),
        (F.expr(role) if role else F.lit("user")).alias("role"),
        F.lit("prompt").alias("surface"),
        F.lit(None).cast("string").alias("field_name"),
        F.expr(text).alias("text"),
    )


def sections_from_messages(requests: DataFrame, messages: str = "messages") -> DataFrame:
    """Flatten ``session, seq, messages`` (JSON) into ordered sections.

    Content is a string or a list of blocks: text, tool result (string or
    nested blocks) and document (title, context, text data).
    """
    each = requests.select(
        "session", "seq",
        F.posexplode(F.from_json(messages, "array<struct<role:string,content:string>>")).alias("m", "msg"),
    ).select("session", "seq", "m", F.col("msg.role").alias("role"), F.col("msg.content").alias("content"))
    block = (
        "struct<type:string,text:string,content:string,title:string,context:string,"
        "source:struct<type:string,data:string>>"
    )
    is_list = F.col("content").startswith("[")
    one = F.array(F.struct(F.lit("prompt").alias("surface"), F.col("content").alias("text")))

    def texts(b):
        nested = F.transform(
            F.filter(F.from_json(b["content"], f"array<{block}>"), lambda n: n["text"].isNotNull()),
            lambda n: F.struct(F.lit("tool_output").alias("surface"), n["text"].alias("text")),
        )
        result = F.when(b["content"].startswith("["), nested).otherwise(
            F.array(F.struct(F.lit("tool_output").alias("surface"), b["content"].alias("text")))
        )
        doc = F.array(
            *[
                F.struct(F.lit("document").alias("surface"), part.alias("text"))
                for part in (b["title"], b["context"], F.when(b["source"]["type"] == "text", b["source"]["data"]))
            ]
        )
        return (
            F.when(b["type"] == "text", F.array(F.struct(F.lit("prompt").alias("surface"), b["text"].alias("text"))))
            .when(b["type"] == "tool_result", result)
            .when(b["type"] == "document", doc)
        )

    blocks = F.flatten(
        F.filter(F.transform(F.from_json("content", f"array<{block}>"), texts), lambda a: a.isNotNull())
    )
    parts = F.filter(F.when(is_list, blocks).otherwise(one), lambda p: p["text"].isNotNull())
    flat = each.select(
        "session", "seq", "m", "role", F.posexplode(parts).alias("j", "p")
    ).select("session", "seq", "m", "j", "role", "p.*")
    # Sections are numbered inside one request: its own small, bounded group.
    number = F.row_number().over(
        Window.partitionBy("session", "seq").orderBy("m", "j")
    )
    return flat.select(
        "session", "seq", (number - 1).alias("section"), "role", "surface",
        F.lit(None).cast("string").alias("field_name"), "text",
    )


#: Fixed value: an annotated span in a labelled corpus.
ANNOTATION = r"\[\[([A-Z0-9_]+)\|(.+?)\]\]"


def unpack(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip ``[[TYPE|value]]`` marks; add ``gold`` with offsets in the result."""
    found = hits(F.col(text), ANNOTATION, f"{MARK}$2﷑$1{MARK}")
    plain = F.regexp_replace(text, ANNOTATION, "$2")
    gold = F.transform(
        found,
        lambda h: F.struct(
            h["after"].alias("entity_type"), h["start"].alias("start"),
            (h["start"] + F.length(h["value"])).cast("int").alias("end"),
        ),
    )
    return df.withColumn("gold", fence(gold)).withColumn(text, plain)


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled corpus: sections (doc, section, surface, format, language, text)
    and gold (doc, section, entity_type, start, end). Duplicate ids, and marks
    left over, fail the job."""
    raw = spark.read.option("multiLine", True).schema(
        "id string, language string, format string, text string, sections array<struct<surface:string,text:string>>"
    ).json(path)
    twice = raw.groupBy("id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("duplicate corpus ids")
    parts = F.coalesce("sections", F.array(F.struct(F.lit("prompt").alias("surface"), F.col("text").alias("text"))))
    flat = raw.select(
        F.col("id").alias("doc"), "format", "language", F.posexplode(parts).alias("section", "p")
    ).select("doc", "format", "language", "section", "p.surface", "p.text")
    done = unpack(flat)
    done = done.withColumn(
        "text", F.when(F.col("text").contains("[["), F.raise_error(F.lit("malformed corpus annotation"))).otherwise(F.col("text"))
    )
    gold = done.select("doc", "section", F.explode("gold").alias("g")).select("doc", "section", "g.*")
    return done.drop("gold"), gold
