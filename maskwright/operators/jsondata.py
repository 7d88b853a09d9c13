"""JSON columns: mask and restore every string and key, keep the rest.

A JSON text is split at its string tokens by one pattern. Strings are masked
as texts of their own; everything between them is passed on byte for byte.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import placeholders as P
from ..functions.spans import MARK, hits, let

#: Fixed value: one JSON string token.
STRING = r'"(?:[^"\\]++|\\.)*+"'
TOKEN = "struct<start:int,end:int,raw:string,text:string,is_key:boolean,name:string>"


def string_tokens(body: Column) -> Column:
    """Every string of a JSON text: offsets, decoded text, whether it is a key,
    and for a value the key it belongs to."""
    # What stands before each string says what it is: only a key is followed
    # by a colon.
    found = hits(body, f"({STRING})(?=(\\s*:?))", f"{MARK}$1\ufdd1$2{MARK}")
    parsed = lambda raw: F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")
    # Without an escape the text is what is between the quotes.
    decode = lambda raw: F.when(raw.contains("\\"), parsed(raw)).otherwise(F.substr(raw, F.lit(2), F.length(raw) - 2))

    def items(found):
        keys = F.transform(
            found,
            lambda h: F.struct(
                h["start"].cast("int").alias("start"),
                (h["start"] + F.length(h["value"])).cast("int").alias("end"),
                h["value"].alias("raw"),
                decode(h["value"]).alias("text"),
                h["after"].contains(":").alias("is_key"),
            ),
        )
        return let(
            keys,
            lambda ks: F.transform(
                ks,
                lambda k, i: k.withField(
                    "name",
                    F.when(~k["is_key"] & F.get(ks, i - 1)["is_key"], F.get(ks, i - 1)["text"]),
                ),
            ),
        )

    return let(found, items)


def to_json_string(text: Column) -> Column:
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substr(quoted, F.lit(6), F.length(quoted) - 6)


def valid(body: Column) -> Column:
    return F.call_function("try_parse_json", body).isNotNull()


def _leaf_schema(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    parsed = df.select(*keys, F.call_function("try_parse_json", F.col(column)).alias("_v"))
    return parsed.select(
        *keys, F.expr("cast(array() as array<string>)").alias("path"), F.col("_v").alias("v")
    )


def leaves(df: DataFrame, keys: list[str], column: str, max_depth: int = X.MAX_JSON_DEPTH) -> DataFrame:
    """``path, kind, value`` of every leaf, one level of the tree at a time.

    Stops at the level where nothing is nested any more; a value nested over
    ``max_depth`` levels fails the job, as it is refused, never cut.
    """
    level = _leaf_schema(df, keys, column)
    done = None
    for _ in range(max_depth + 1):
        kind = F.expr("schema_of_variant(v)")
        shaped = level.withColumn("_k", kind)
        nested = F.col("_k").rlike("^(?:OBJECT|ARRAY)<.+>$") & ~F.col("_k").rlike("^(?:OBJECT|ARRAY)<(?:VOID)?>$")
        flat = shaped.where(~nested).select(
            *keys, "path",
            F.when(F.col("_k") == "STRING", "string").when(F.col("_k") == "BOOLEAN", "bool")
            .when(F.col("_k") == "VOID", "null")
            .when(F.col("_k").rlike("^(?:OBJECT|ARRAY)"), "empty").otherwise("number").alias("kind"),
            F.expr("cast(v as string)").alias("value"),
        )
        done = flat if done is None else done.unionByName(flat)
        deeper = shaped.where(nested)
        if deeper.isEmpty():
            return done
        level = _explode(deeper, keys)
    raise ValueError("JSON nested too deeply")


def _explode(deeper: DataFrame, keys: list[str]) -> DataFrame:
    """One level down: every member of every object or array."""
    deeper.createOrReplaceTempView("_maskwright_level")
    names = ", ".join(f"`{k}`" for k in keys)
    return deeper.sparkSession.sql(
        f"SELECT {names}, concat(path, array(coalesce(e.key, cast(e.pos AS string)))) AS path, e.value AS v "
        "FROM _maskwright_level, LATERAL variant_explode(v) AS e"
    )


def keys_of(body: Column) -> Column:
    """The distinct keys of a JSON text, at any depth."""
    return let(string_tokens(body), lambda t: F.array_distinct(F.transform(F.filter(t, lambda x: x["is_key"]), lambda x: x["text"])))


def key_collisions(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Rows in which two keys of one object became the same text.

    An object that had n distinct keys must still have n; compared by its
    path, level by level.
    """
    count = lambda c, n: leaves_keys(df, keys, c).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    return (
        count(before, "_n").join(count(after, "_m"), keys, "left")
        .where(F.coalesce("_m", F.lit(0)) < F.col("_n")).select(*keys)
    )


def leaves_keys(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct leaf paths of a JSON column."""
    return leaves(df, keys, column).select(*keys, "path").distinct()


def numbers_to_refuse(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with a number that would be masked if it were text."""
    from .detect import detect

    numbers = leaves(df, keys, column).where(F.col("kind") == "number")
    return detect(numbers, "value").where(F.size("spans") > 0).select(*keys).distinct()


def restore_json_in_row(body: Column, restore_text) -> Column:
    """Restore inside each string of a JSON text; other text as a whole.

    ``restore_text`` restores one string; only strings that change are
    rewritten, with JSON escapes.
    """
    edits = lambda tokens: F.filter(
        F.transform(
            tokens,
            lambda t: let(
                restore_text(t["text"]),
                lambda r: F.struct(
                    t["start"].alias("start"), t["end"].alias("end"),
                    F.when(r != t["text"], to_json_string(r)).alias("new"),
                ),
            ),
        ),
        lambda e: e["new"].isNotNull(),
    )
    inside = let(string_tokens(body), lambda t: let(edits(t), lambda e: P.splice(body, e)))
    return F.when(valid(body), inside).otherwise(restore_text(body))
