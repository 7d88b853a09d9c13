"""The registered queries: every operator over the given tables.

Where the tables hold no value of some kind, texts are derived from their
rows (one or a few a row), so the work still grows with the tables.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii, secrets
from ..functions import placeholders as P
from ..functions.spans import SPANS, span
from ..operators import checks, evaluate, intervals, jsondata, known, ledger, normalize, review, search, vault
from ..operators.detect import detect, validate
from ..operators.resolve import greedy, merge_islands, resolve, resolve_leftmost, resolve_overlaps
from ..operators.restore import restore, restore_rows, trace_masks
from ..sources import registry as reg
from ..sources.sections import sections_from_messages, unpack
from ..streaming import activity
from .masking import KEYS, mask_rows, mask_sessions
from .runtime import dealt, pin, small, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark, sf, *more):
    """Customers that texts are derived from: the work is in the texts, not in reading."""
    return dealt(table(spark, sf, "customer").select("c_custkey", "c_name", *more))


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def sections(spark, sf):
    """Documents as sections: one session a source."""
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.lit(0).alias("section"), "text"
    )
    return spread(rows, "seq")


def _flat(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.explode("spans").alias("s")).select(
        key, "s.entity_type", F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"), "s.value",
    )


def rule_query(name, *rules, text_table="documents", key="doc_id", text="text"):
    def run(spark, sf):
        rows = table(spark, sf, text_table).select(key, F.col(text).alias("text"))
        spans = F.flatten(F.array(*[r(F.col("text")) for r in rules]))
        return _flat(rows.select(key, pii.dedupe(pii.shrink_phones(spans)).alias("spans")), key)

    return run


# --- texts derived from customer rows ---------------------------------------

def _hex():
    return F.md5(F.col("c_name"))


def _digits(n):
    return F.lpad(F.col("c_custkey").cast("string"), n, "0")


def _luhn_card():
    """A 16-digit card number with its check digit."""
    body = F.concat(F.lit("400000"), _digits(9))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(15)),
        F.lit(0),
        lambda a, i: a
        + F.when(
            i % 2 == 1,
            F.substr(body, i, F.lit(1)).cast("int") * 2
            - F.when(F.substr(body, i, F.lit(1)).cast("int") > 4, 9).otherwise(0),
        ).otherwise(F.substr(body, i, F.lit(1)).cast("int")),
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban():
    bban = _digits(18)
    rest = F.concat(bban, F.lit("131400")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
    check = F.lpad((98 - rest).cast("int").cast("string"), 2, "0")
    return F.concat(F.lit("DE"), check, bban)


def notes():
    """name: (text, entity type, value) as columns over customer."""
    lit, cat = F.lit, F.concat
    v = _hex()
    ssn = cat((F.col("c_custkey") % 500 + 100).cast("string"), lit("-45-"), F.lpad((F.col("c_custkey") % 9000 + 1000).cast("string"), 4, "0"))
    bare = F.replace(ssn, lit("-"), lit(""))
    card = _luhn_card()
    printed = F.concat_ws(" ", *[F.substr(card, lit(i), lit(4)) for i in (1, 5, 9, 13)])
    ip6 = cat(lit("2001:db8::"), F.lower(F.hex(F.col("c_custkey") % 65536)), lit(":1"))
    return {
        "ssn": (cat(lit("number "), ssn, lit(" on file")), "SSN", ssn),
        "ssn_labelled": (cat(lit("Social Security Number: "), bare), "SSN", bare),
        "iban": (cat(lit("pay to "), _iban(), lit(". Thanks")), "IBAN", _iban()),
        "ipv6": (cat(lit("host ["), ip6, lit("] up")), "IPV6", ip6),
        "card_printed": (cat(lit("paid by "), printed, lit(", ok")), "CREDIT_CARD", printed),
        "phone_abroad": (
            cat(lit("ring +44 20 7946 "), _digits(4), lit(" 24h")), "PHONE",
            cat(lit("+44 20 7946 "), _digits(4)),
        ),
        "api_key_prefix": (cat(lit("use sk-"), v, lit(" today")), "API_KEY", cat(lit("sk-"), v)),
        "auth_header": (cat(lit("Authorization: Bearer "), v, lit("\nHost: x")), "TOKEN", v),
        "labelled_secret": (cat(lit('DB_PASSWORD="'), v, lit('"\nPORT=1')), "PASSWORD", v),
        "private_key": (
            cat(lit("key:\n-----BEGIN PRIVATE KEY-----\n"), v, lit("\n-----END PRIVATE KEY-----\nend")), "PRIVATE_KEY",
            cat(lit("-----BEGIN PRIVATE KEY-----\n"), v, lit("\n-----END PRIVATE KEY-----")),
        ),
        "url_credential": (cat(lit("postgresql://user:"), v, lit("@db.example.test/app")), "CREDENTIAL", cat(lit("user:"), v)),
        "cookie": (cat(lit("Cookie: theme=dark; sessionid="), v, lit("; lang=en")), "TOKEN", v),
        "escaped_secret": (cat(lit('{"body":"{\\"password\\":\\"'), v, lit('\\"}"}')), "PASSWORD", v),
        "block_secret": (cat(lit("password: |\n  "), v, lit("\nretries: 3")), "PASSWORD", cat(lit("  "), v)),
    }


def derived_query(name):
    def run(spark, sf):
        text, _, _ = notes()[name]
        rows = customers(spark, sf).select("c_custkey", text.alias("text"))
        return _flat(detect(rows), "c_custkey").select("c_custkey", "entity_type", "value")

    return run


def detect_field(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", _hex().alias("text"), F.lit("apiKey").alias("name"))
    return _flat(detect(rows, field="name"), "c_custkey").select("c_custkey", "entity_type", "value")


def detect_custom(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("ref "), "s_name", F.lit(".")).alias("text"))
    found = detect(rows, patterns={"SUPPLIER": r"Supplier#\d{9}"})
    return _flat(found, "s_suppkey").select("s_suppkey", "entity_type", "value")


def detect_literal(spark, sf):
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("see [EMAIL_"), F.col("s_suppkey") + 1, F.lit("] and row[COL_1]")).alias("text")
    )
    types = F.array(F.lit("EMAIL"), F.lit("PERSON"))
    spans = pii.detect_literal(F.col("text"), types)
    return _flat(rows.select("s_suppkey", spans.alias("spans")), "s_suppkey").select("s_suppkey", "entity_type", "value")


def _words(spark, sf):
    """A registry: the longer words of the benchmark passages."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("value"))
    return words.distinct().select(F.lit("PERSON").alias("entity_type"), "value")


def detect_registry(spark, sf):
    found = search.find_values(
        documents(spark, sf), _words(spark, sf).select("value", F.lit(True).alias("token")), ["doc_id"], token="token"
    )
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


# --- masking, vault, restore -------------------------------------------------

def mask_documents(spark, sf):
    out = mask_rows(documents(spark, sf), warnings=False)
    return out.select("doc_id", "masked", F.size("entities").cast("bigint").alias("entities"))


def mask_round_trip(spark, sf):
    """A model that repeats what it is told: only placeholders reach it, values come back."""
    from .masking import round_trip

    out = round_trip(documents(spark, sf), lambda told: F.concat(F.lit("You said: "), told))
    return out.select("doc_id", F.md5("restored").alias("digest"), F.md5("reply").alias("told"))


def mask_entity_view(spark, sf):
    from .masking import entity_view

    out = entity_view(mask_rows(documents(spark, sf), warnings=False), ["doc_id"])
    return out.select("doc_id", "placeholder", "value", "entity_type", "start", "end")


def mask_documents_warnings(spark, sf):
    """The leak check of the flagship: values left visible, by type."""
    out = mask_rows(documents(spark, sf))
    return out.select("doc_id", F.size("warnings").cast("bigint").alias("warnings"))


def mask_source_sessions(spark, sf):
    return mask_sessions(sections(spark, sf)).masked.select("session", "seq", "masked")


def vault_values(spark, sf):
    return mask_sessions(sections(spark, sf)).vault.select("session", "entity_type", "number", "placeholder", "value")


def vault_global(spark, sf):
    rows = sections(spark, sf).withColumn("session", F.lit("all"))
    return mask_sessions(rows).vault.select("entity_type", "number", "placeholder", "value")


def _name_entities(spark, sf):
    """Orders as entities: the customer of each order, in order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    names = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(names, orders.o_custkey == names.c_custkey).select(
        F.col("o_orderpriority").alias("session"), F.col("c_name").alias("value"),
        F.col("c_mktsegment").alias("entity_type"), F.col("o_orderkey").alias("seq"),
        F.lit(0).alias("section"), F.lit(0).alias("start"),
    )


def vault_assign(spark, sf):
    """Two batches: the second continues the numbers of the first."""
    rows = _name_entities(spark, sf)
    half = rows.agg((F.max("seq") / 2).cast("bigint").alias("cut"))
    rows = rows.join(F.broadcast(half), rows.seq >= 0)
    first = pin(vault.assign(rows.where("seq <= cut")))
    second = vault.assign(rows.where("seq > cut"), first)
    return first.unionByName(second).select("session", "entity_type", "number", "placeholder", "value")


def vault_sizes(spark, sf):
    return vault.sizes(vault.first_seen_values(_name_entities(spark, sf)))


def vault_lookup(spark, sf):
    rows = _name_entities(spark, sf)
    full = pin(vault.assign(rows))
    asked = pin(rows.select("session", "value", "entity_type", "seq"))
    return vault.placeholders_for(asked, full).select("session", "seq", "placeholder")


def vault_clear(spark, sf):
    full = vault.assign(_name_entities(spark, sf))
    return vault.sizes(vault.clear(full, "5-LOW"))


def _sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    none = spark.createDataFrame([], vault.SESSIONS)
    return vault.touch(none, e), e


def vault_touch(spark, sf):
    sessions, _ = _sessions(spark, sf)
    return sessions.select("session", F.unix_seconds("last_used").alias("last_used"))


def vault_purge(spark, sf):
    sessions, events = _sessions(spark, sf)
    now = events.agg(F.max("ts")).first()[0]
    left = vault.purge({"uses": events}, sessions, 0.5, now)
    return left["uses"].groupBy("session").agg(F.count(F.lit(1)).alias("uses"))


def restore_documents(spark, sf):
    out = restore_rows(mask_rows(documents(spark, sf), warnings=False, literals=True))
    return out.select("doc_id", F.md5("restored").alias("digest"), F.col("restored_count").cast("bigint").alias("restored"))


def _masked_sessions(spark, sf):
    out = mask_sessions(sections(spark, sf))
    return out.masked.select(*KEYS, F.col("masked").alias("text")), out.vault


def restore_sessions(spark, sf):
    text, full = _masked_sessions(spark, sf)
    return restore(text, full, KEYS).select("seq", F.md5("restored").alias("digest"), F.col("restored_count").cast("bigint").alias("restored"))


def restore_tolerant(spark, sf):
    """Replies that write ``[type 01]`` for ``[TYPE_1]``."""
    text, full = _masked_sessions(spark, sf)
    written = text.withColumn("text", F.regexp_replace("text", r"\[([A-Z]+)_([0-9]+)\]", "[$1 0$2]"))
    out = restore(written, full, KEYS)
    return out.select("seq", F.md5("restored").alias("digest"), F.size("repaired").cast("bigint").alias("repaired"))


def restore_unknown(spark, sf):
    """What is reported when the vault has lost its phone numbers."""
    text, full = _masked_sessions(spark, sf)
    out = restore(text, full.where(F.col("entity_type") != "PHONE"), KEYS, tolerant=False)
    return out.select("seq", F.explode("unknown").alias("placeholder"))


def trace_documents(spark, sf):
    out = trace_masks(pin(mask_rows(documents(spark, sf), warnings=False)))
    return out.select("doc_id", F.explode("traced").alias("t"), "exact").select(
        "doc_id", "t.entity_type", F.col("t.start").cast("bigint").alias("start"), F.col("t.end").cast("bigint").alias("end"), "exact"
    )


def leak_check(spark, sf):
    """Against the unmasked text, every known value is a leak."""
    out = mask_sessions(sections(spark, sf))
    return known.leak_check(sections(spark, sf), out.vault, text="text").select("session", "seq", "entity_type", "value")


def mask_known(spark, sf):
    """Values glued to other text, as a reply may write them."""
    out = mask_sessions(sections(spark, sf))
    glued = sections(spark, sf).withColumn("masked", F.replace("text", F.lit(" "), F.lit("x")))
    return known.mask_known(glued, out.vault).select("seq", "masked")


def withhold_lines(spark, sf):
    out = mask_sessions(sections(spark, sf))
    held = known.withhold_lines(sections(spark, sf).withColumnRenamed("text", "masked"), out.vault)
    return held.select("seq", "masked")


def count_private_values(spark, sf):
    out = mask_sessions(sections(spark, sf))
    payloads = table(spark, sf, "documents").select(
        F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.lit(0).alias("section"), "text",
        F.col("lang").alias("destination"),
    )
    places = payloads.select("destination").distinct().select(
        "destination", F.when(F.col("destination") == "en", "shell").when(F.col("destination") == "fr", "local").otherwise("remote").alias("kind")
    )
    return known.decide(known.count_private_values(payloads, out.vault), places).select("seq", "private_values", "decision")


def folded_match(spark, sf):
    c = table(spark, sf, "customer")
    names = c.select(F.concat(F.lit("col_"), F.lower(F.replace("c_name", F.lit("#"), F.lit("#-")))).alias("name"))
    return known.folded_match(names, c.select(F.col("c_name").alias("value")), min_length=8)


def placeholder_like_input(spark, sf):
    rows = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("mail s"), "s_suppkey", F.lit("@example.com about [EMAIL_"), F.col("s_suppkey") + 1,
                 F.lit("] or [email "), F.col("s_suppkey") + 1, F.lit("] or [Figure 2]")).alias("text"),
    )
    out = mask_rows(rows)
    text = checks.render_warnings(F.col("warnings"), redact=True)
    return out.select("s_suppkey", F.explode(text).alias("warning"))


def quarantine(spark, sf):
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "see [EMAIL_1]").otherwise("nothing here").alias("text")
    )
    _, bad = checks.route(pin(mask_rows(rows).select("s_suppkey", "warnings")))
    return bad.select("s_suppkey")


def literal_types(spark, sf):
    return vault.literal_types(mask_sessions(sections(spark, sf)).vault)


# --- spans as tables ---------------------------------------------------------

def _line_spans(spark, sf):
    """Line items as spans of their order: overlapping in many ways."""
    l = table(spark, sf, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("doc"),
        ((F.col("l_linenumber") * 37 + F.col("l_partkey")) % 120).cast("int").alias("start"),
        (F.col("l_suppkey") % 3).cast("int").alias("priority"),
        F.col("l_returnflag").alias("entity_type"),
        (F.col("l_quantity").cast("int") % 25 + 1).alias("size"),
    ).distinct().select("doc", "start", (F.col("start") + F.col("size")).alias("end"), "entity_type", "priority")


def _line_arrays(spark, sf):
    one = F.struct(
        "start", "end", F.repeat(F.lit("x"), F.col("end") - F.col("start")).alias("value"), "entity_type",
        F.lit("made").alias("source"), "priority", F.ascii("entity_type").alias("rule"),
    )
    return _line_spans(spark, sf).groupBy("doc").agg(F.collect_list(one).alias("spans"))


def merge_overlaps(spark, sf):
    best = merge_islands(_line_spans(spark, sf), ["doc"])
    return best.select("doc", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("members").alias("members"))


def resolve_spans(spark, sf):
    kept = _line_arrays(spark, sf).select("doc", F.explode(resolve_overlaps(F.col("spans"))).alias("s"))
    return kept.select("doc", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), "s.entity_type")


def resolve_spans_leftmost(spark, sf):
    kept = _line_arrays(spark, sf).select("doc", F.explode(resolve_leftmost(F.col("spans"))).alias("s"))
    return kept.select("doc", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))


def _text_of_lines(spark, sf):
    """All line items as spans of one text (of ten million orders each)."""
    at = F.col("doc") % 10_000_000 * 128
    return _line_spans(spark, sf).select(
        (F.col("doc") / 10_000_000).cast("bigint").alias("text"), (at + F.col("start")).cast("int").alias("start"),
        (at + F.col("end")).cast("int").alias("end"), F.repeat(F.lit("x"), F.col("end") - F.col("start")).alias("value"),
        "entity_type", F.lit("made").alias("source"), "priority", F.ascii("entity_type").alias("rule"),
    )


def resolve_one_text(spark, sf):
    """Rounds decide the islands of more than four spans that may reach over parts of the text."""
    kept = intervals.resolve_table(_text_of_lines(spark, sf), ["text"], few=4)
    return kept.select("text", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "entity_type")


def merge_partial_spans(spark, sf):
    out = intervals.merge_partial_table(_text_of_lines(spark, sf), ["text"], few=4)
    return out.select(
        "text", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "entity_type", "source", "members"
    )


def dedupe_spans(spark, sf):
    out = _line_arrays(spark, sf).select("doc", pii.dedupe(F.concat("spans", "spans")).alias("spans"))
    return out.select("doc", F.explode("spans").alias("s")).select(
        "doc", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), "s.entity_type"
    )


# --- normalization -----------------------------------------------------------

def normalize_documents(spark, sf):
    out = mask_rows(documents(spark, sf), warnings=False)
    e = pin(out.select(F.explode("entities").alias("e")).select("e.entity_type", "e.value").distinct())
    keyed = e.where(F.col("entity_type").isin("EMAIL", "PHONE", "CREDIT_CARD"))
    return keyed.select("entity_type", "value", normalize.value_key(F.col("entity_type"), F.col("value")).alias("key"))


def normalize_derived(spark, sf):
    n = notes()
    rows = table(spark, sf, "customer").select(
        "c_custkey", n["iban"][2].alias("iban"), n["ipv6"][2].alias("ipv6"), n["card_printed"][2].alias("card")
    )
    return rows.select(
        "c_custkey", normalize.key_iban(F.lower("iban")).alias("iban_key"),
        normalize.key_ipv6(F.upper("ipv6")).alias("ipv6_key"), normalize.key_card(F.col("card")).alias("card_key"),
    )


def unify_spellings(spark, sf):
    """Two spellings of one number in a session share a placeholder."""
    d = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    c = customers(spark, sf, "c_mktsegment").select(
        F.col("c_mktsegment").alias("session"), F.col("c_custkey").alias("seq"), F.lit(0).alias("section"),
        F.concat(F.lit("(212) 555-"), d, F.lit(" or 212.555."), d).alias("text"),
    )
    out = mask_sessions(c, normalize=True)
    return out.entities.select("session", "seq", "value", "placeholder")


# --- registry, sources -------------------------------------------------------

def _registry(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("value"))
    s = table(spark, sf, "supplier").select(F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("value"))
    return c.unionByName(s)


def registry_counts(spark, sf):
    return reg.registry_counts(_registry(spark, sf))


def registry_errors(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("value"), F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("entity_type"))
    k = F.col("s_suppkey") % 5
    bad = table(spark, sf, "supplier").select(
        F.when(k == 0, F.repeat(F.lit(" "), F.col("s_suppkey"))).when(k == 1, F.concat("s_name", F.lit("\n2"))).otherwise(F.col("s_name")).alias("value"),
        F.when(k == 2, "bad type").when(k == 3, "LITERAL").otherwise("PERSON").alias("entity_type"),
    )
    return reg.registry_errors(p.distinct().unionByName(bad)).select("entity_type", "value", "reason")


def registry_changes(spark, sf):
    base = _registry(spark, sf)
    p = table(spark, sf, "part").select(F.lit("PART").alias("entity_type"), F.col("p_name").alias("value"))
    gone = table(spark, sf, "supplier").select(F.col("s_name").alias("value"))
    return reg.registry_counts(reg.registry_remove(reg.registry_add(base, p), gone))


def messages_to_sections(spark, sf):
    """Conversations packed as JSON requests, then flattened again."""
    c = table(spark, sf, "conversations")
    packed = c.groupBy("conv_id").agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
            )
        ).alias("messages")
    ).select(F.col("conv_id").cast("string").alias("session"), F.lit(0).cast("bigint").alias("seq"), "messages")
    return sections_from_messages(packed).select("session", F.col("section").cast("bigint").alias("section"), "role", "text")


def blocks_to_sections(spark, sf):
    """Turns as lists of blocks: text, tool results of either kind, and documents."""
    t, k = F.col("text"), F.concat(F.lit("title "), "conv_id")
    one = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    blocks = F.concat(
        F.lit("["), F.to_json(one(type=F.lit("text"), text=t)), F.lit(","),
        F.to_json(one(type=F.lit("tool_result"), content=F.concat(F.lit("out "), t))), F.lit(","),
        F.to_json(one(type=F.lit("tool_result"), content=F.array(one(type=F.lit("text"), text=F.concat(F.lit("nested "), t)), one(type=F.lit("image"), text=F.lit(None).cast("string"))))),
        F.lit(","), F.to_json(one(type=F.lit("image"), url=k)), F.lit(","),
        F.to_json(one(type=F.lit("document"), title=k, context=F.lit("ctx"), source=one(type=F.lit("text"), data=t))), F.lit("]"),
    )
    message = F.concat(F.lit('[{"role":"user","content":'), blocks, F.lit("}]"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), message.alias("messages"))
    return sections_from_messages(rows).select("session", "seq", F.col("section").cast("bigint").alias("section"), "surface", "text")


def detect_validated(spark, sf):
    """Every span of every rule stands in its text as it says."""
    return _flat(validate(detect(documents(spark, sf))), "doc_id")


def code_values(spark, sf):
    """Values that read as code: references, echoes of the name, dotted names, paths; and secrets, which do not."""
    k = F.col("c_custkey")
    kinds = [
        F.concat(F.lit("${SECRET_"), k, F.lit("}")), _hex(), F.lit("password"), F.concat(F.lit("settings_"), k, F.lit(".api_key")),
        F.concat(F.lit("/etc/app/"), k), F.concat(F.lit("x-"), _hex(), F.lit("!")),
    ]
    rows = table(spark, sf, "customer").select("c_custkey", F.get(F.array(*kinds), (k % 6).cast("int")).alias("value"))
    return rows.select("c_custkey", secrets.is_code_value(F.col("value"), F.lit("db_password")).alias("code"))


def unify_second_batch(spark, sf):
    """A second batch that spells the numbers of the first in another way gets their placeholders."""
    d = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    c = customers(spark, sf, "c_mktsegment").select(
        F.col("c_mktsegment").alias("session"), F.col("c_custkey").alias("seq"), F.lit(0).alias("section"), d.alias("d"))
    first = mask_sessions(c.where("seq % 2 = 0").withColumn("text", F.concat(F.lit("(212) 555-"), "d")).drop("d"), normalize=True)
    again = c.withColumn("text", F.concat(F.lit("call 212.555."), "d")).drop("d")
    out = mask_sessions(again, pin(first.vault), normalize=True)
    return out.entities.select("session", "seq", "value", "placeholder")


def cut_leaks(spark, sf):
    """Merged placeholders that hide a part, all or nothing of a value that is known."""
    k, v = F.col("c_custkey"), _hex()
    c = customers(spark, sf, "c_mktsegment").select(
        F.col("c_mktsegment").alias("session"), k.alias("seq"), F.lit(0).alias("section"),
        F.concat(F.lit("ref AB"), v, F.lit(" and CDEFGH")).alias("text"), v.alias("value"),
    )
    part = F.col("seq") % 3
    start = F.when(part == 2, 42).otherwise(4).cast("int")
    end = F.when(part == 0, 20).when(part == 1, 38).otherwise(49).cast("int")
    member = F.struct(F.lit("AB").alias("value"), F.lit("NAME").alias("entity_type"))
    entities = c.select(
        *KEYS, start.alias("start"), end.alias("end"), F.substr("text", start + 1, end - start).alias("value"),
        F.lit("NAME").alias("entity_type"), F.lit("merged").alias("source"), F.array(member).alias("members"),
    )
    full = c.select("session", "value", F.lit("TOKEN").alias("entity_type"), F.concat(F.lit("[TOKEN_"), F.col("seq") + 1, F.lit("]")).alias("placeholder"))
    return known.cut_leaks(entities, c.drop("value"), full).select("session", "seq", "value", "entity_type", "placeholder")


def vault_remembered(spark, sf):
    """Spellings of customers' names: the first placeholder wins; stored and kept ones are left alone."""
    rows = _name_entities(spark, sf)
    full = pin(vault.assign(rows.where("seq % 3 = 0")))
    spelled = rows.withColumn("value", F.when(F.col("seq") % 2 == 0, F.upper("value")).otherwise(F.col("value")))
    spelled = spelled.withColumn("placeholder", F.concat(F.lit("[NAME_"), F.col("seq") + 1, F.lit("]")))
    early = pin(vault.remember(spelled.where("seq % 5 = 0"), full))
    return vault.remember(spelled, full, early).select("session", "value", "entity_type", "placeholder")


def annotated_gold(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("From [[ORG|"), "s_name", F.lit("]] to [[EMAIL|s"), "s_suppkey", F.lit("@example.com]] now")).alias("text")
    )
    return unpack(s).select("s_suppkey", "text", F.explode("gold").alias("g")).select(
        "s_suppkey", "text", "g.entity_type", F.col("g.start").cast("bigint").alias("start"), F.col("g.end").cast("bigint").alias("end")
    )


# --- review ------------------------------------------------------------------

def review_findings(spark, sf):
    v = _hex()
    rows = customers(spark, sf).select(
        F.col("c_custkey"),
        F.explode(
            F.array(
                F.concat(F.lit("Recovery code: "), v, F.lit("-9. Keep it.")),
                F.concat(F.lit("passport number "), F.upper(F.substr(v, F.lit(1), F.lit(8))), F.lit("7, valid")),
                F.concat(F.lit("born 19"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-04-17; ok")),
                F.concat(F.lit("Home address: "), F.col("c_custkey") + 1, F.lit(" Cedar Meadow Road.")),
                F.concat(F.lit("Use "), v, F.lit(" to sign in")),
                F.concat(F.lit("Our webhook url is https://hooks.example.test/"), v, F.lit(".")),
                F.concat(F.lit('{"encoding":"base64","data":"'), F.base64(F.encode(v, "UTF-8")), F.lit('"}')),
            )
        ).alias("text"),
    )
    return review.review(rows).select("c_custkey", "kind", "value")


def review_fragments(spark, sf):
    """A cue in one section makes fragments count in every section of the request."""
    v = _hex()
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("session"),
        F.posexplode(
            F.array(
                F.when(F.col("c_custkey") % 2 == 0, "The secret was split in two parts.").otherwise("Nothing to see."),
                F.concat(F.lit("First part: "), F.substr(v, F.lit(1), F.lit(16)), F.lit("; done")),
            )
        ).alias("section", "text"),
    )
    found = review.review(c, ["session"])
    return review.request_status(c, found, c.where(F.col("session").cast("bigint") % 10 == 0))


def review_unprotected(spark, sf):
    """What is masked already, in every second text, is not proposed again."""
    code = F.concat(_hex(), F.lit("-9"))
    masked = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit(15).alias("start"), F.lit(49).alias("end"))))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Recovery code: "), code, F.lit(". Keep it.")).alias("text"),
        F.coalesce(masked, F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
    )
    return review.review(review.unprotected(rows, "spans").drop("spans")).select("c_custkey", "kind", "value")


def confirm_findings(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("Recovery code: "), F.md5("s_name"), F.lit(" .")).alias("text"), "s_suppkey")
    found = review.review(s)
    yes = found.select("value", (F.col("s_suppkey") % 2 == 0).alias("confirmed"))
    listed = table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.lit("PERSON").alias("entity_type"), F.md5("s_name").alias("value"))
    return review.confirm(found, yes, listed)


# --- JSON, ledger ------------------------------------------------------------

def _json_rows(spark, sf):
    return customers(spark, sf, "c_mktsegment", "c_nationkey").select(
        "c_custkey",
        F.to_json(
            F.struct(
                F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
                F.array(F.concat(F.lit('say "hi" to +1 (212) 555-'), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).alias("notes"),
                F.struct("c_mktsegment", "c_nationkey").alias("more"),
            )
        ).alias("body"),
    )


def json_leaves(spark, sf):
    out = jsondata.leaves(_json_rows(spark, sf), ["c_custkey"], "body")
    return out.select("c_custkey", F.array_join("path", "/").alias("path"), "kind", "value")


def json_masked(spark, sf):
    from .masking import mask_json_rows

    return mask_json_rows(_json_rows(spark, sf), "body").select("c_custkey", "masked_json")


def json_refused(spark, sf):
    """Secrets under their key, and each reason to refuse a row, by turns."""
    from .masking import mask_json_rows

    k, v = F.col("c_custkey"), _hex()
    mail = F.concat(F.lit("c"), k, F.lit("@example.com"))
    bodies = [
        F.concat(F.lit('{"apiKey":"k-'), v, F.lit('","note":"to '), mail, F.lit('","n":12}')),
        F.concat(F.lit('{"a":{"b":[true,null,'), _luhn_card(), F.lit("]}}")),
        F.concat(F.lit('{"note": '), mail),
        F.concat(F.lit('{"'), mail, F.lit('":1,"[EMAIL_1]":2}')),
        F.concat(F.lit('["plain", {"id":"x-'), k, F.lit('"}]')),
    ]
    text = F.get(F.array(*bodies), (k % 5).cast("int"))
    rows = customers(spark, sf).select("c_custkey", text.alias("body"))
    return mask_json_rows(rows, "body").select("c_custkey", "masked_json", "refused")


def json_restored(spark, sf):
    from .masking import mask_json_rows, restore_json_rows

    out = restore_json_rows(mask_json_rows(_json_rows(spark, sf), "body"), "masked_json")
    return out.select("c_custkey", F.col("restored_json"))


def json_numbers_refused(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('{"n":'), F.when(F.col("c_custkey") % 4 == 0, _luhn_card()).otherwise(F.lit("12345")), F.lit("}")).alias("body")
    )
    return jsondata.numbers_to_refuse(rows, ["c_custkey"], "body")


def json_key_collisions(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k, F.lit('{"a":1,"b":2}').alias("before"),
        F.when(k % 5 == 0, '{"a":1,"a":2}').otherwise('{"a":1,"b":2}').alias("after"),
    )
    return jsondata.key_collisions(rows.withColumn("after", F.when(k % 5 == 0, '{"a":1}').otherwise(F.col("after"))), ["c_custkey"], "before", "after")


def _replies(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "role", "text"
    )


def ledger_replay(spark, sf):
    """Even turns were recorded; replies that match are sent as recorded."""
    c = _replies(spark, sf)
    recorded = c.where((F.col("role") == "assistant") & (F.col("seq") % 4 == 1)).select(
        "session", F.col("text").alias("restored"), F.concat(F.lit("recorded "), "text").alias("masked"),
        F.timestamp_seconds(F.col("seq")).alias("used"),
    )
    book = ledger.record(None, ledger.text_rows(recorded))
    out = ledger.replay_replies(c, book)
    return out.select("session", "seq", F.md5(F.coalesce("masked", "text")).alias("digest"))


def ledger_seen(spark, sf):
    c = _replies(spark, sf).select("session", "seq", F.col("text").alias("value"))
    book = ledger.seen_rows(c.where(F.col("seq") % 2 == 0).withColumn("used", F.timestamp_seconds(F.col("seq"))))
    _, unseen = ledger.seen(c, ledger.record(None, book))
    return unseen.select("session", "seq")


def ledger_tools(spark, sf):
    """Tool inputs match whatever their key order and number form."""
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("string").alias("tool_id"),
        F.concat(F.lit('{"a":1,"b":'), "event_id", F.lit("}")).alias("first"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"b":'), "event_id", F.lit(".0, "), F.lit('"a":1}'))).otherwise(F.lit('{"a":2}')).alias("second"),
    )
    keys = ["session", "tool_id"]
    book = ledger.canonical_leaves(e, keys, "first").select(
        "session", F.lit("tool").alias("kind"), F.col("tool_id").alias("key"), "digest", F.lit("recorded").alias("masked"),
        F.timestamp_seconds(F.lit(0)).alias("used"),
    )
    out = ledger.replay_tool_inputs(ledger.canonical_leaves(e, keys, "second"), book)
    return out.where(F.col("replayed").isNotNull()).select("session", "tool_id")


# --- evaluation --------------------------------------------------------------

def _gold_and_spans(spark, sf):
    out = mask_rows(documents(spark, sf), warnings=False)
    spans = pin(out.select(
        F.col("doc_id").alias("doc"), F.lit(0).alias("section"), F.explode("entities").alias("e")
    ).select("doc", "section", "e.entity_type", F.col("e.start").cast("bigint").alias("start"), F.col("e.end").cast("bigint").alias("end")))
    return spans, spans.where("doc % 3 <> 0").unionByName(
        spans.where("doc % 3 = 0").withColumn("end", F.col("end") - 2)
    )


def evaluate_scores(spark, sf):
    gold, spans = _gold_and_spans(spark, sf)
    attributes = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    return evaluate.score(evaluate.outcomes(gold, spans, attributes), ["entity_type", "lang", "source"]).select(
        "entity_type", "lang", "source", "tp", "fp", "fn", "precision", "recall"
    )


def evaluate_coverage(spark, sf):
    gold, spans = _gold_and_spans(spark, sf)
    return evaluate.covered(gold, spans).groupBy("entity_type").agg(F.count(F.lit(1)).alias("covered"))


def _line_gold(spark, sf):
    rows = _line_spans(spark, sf).select("doc", F.lit(0).alias("section"), "entity_type", "start", "end")
    return rows.where("entity_type = 'N'"), rows.where("entity_type = 'A'"), rows.where("entity_type = 'R'")


def evaluate_characters(spark, sf):
    gold, hidden, flagged = _line_gold(spark, sf)
    out = evaluate.character_coverage(gold, hidden, flagged)
    return out.select(
        "doc", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
        *[F.col(c).cast("bigint").alias(c) for c in ("masked_characters", "review_characters", "masked_or_flagged_characters")],
    )


def evaluate_overmasked(spark, sf):
    gold, hidden, _ = _line_gold(spark, sf)
    return evaluate.overmasked(gold, hidden).select("doc", F.col("overmasked_characters").cast("bigint").alias("overmasked_characters"))


def evaluate_leaks(spark, sf):
    gold, hidden, flagged = _line_gold(spark, sf)
    marks = evaluate.character_coverage(gold, hidden, flagged).withColumn(
        "status", F.when(F.col("doc") % 4 == 0, "held").otherwise("ready")
    ).withColumn("format", (F.col("doc") % 7).cast("string"))
    return evaluate.summarize_leaks(marks, ["format", "status"])


def evaluate_restoration(spark, sf):
    out = restore_rows(mask_rows(documents(spark, sf), warnings=False, literals=True))
    return evaluate.restoration_check(out)


def evaluate_latency(spark, sf):
    ms = table(spark, sf, "events").select(F.col("value").alias("ms"))
    return evaluate.latency_stats(ms)


def evaluate_regressions(spark, sf):
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        F.lit("defaults").alias("run"), k.cast("string").alias("id"), F.lit("ready").alias("status"),
        F.array((k % 20).cast("int")).alias("masked_characters"), F.array((k % 20).cast("int")).alias("masked_or_flagged_characters"),
        (k % 3).alias("exact_fp"), (k % 4).alias("exact_fn"), F.lit(0).alias("overmasked_characters"),
        F.lit(0).alias("review_harmless_characters"), F.lit(0).alias("exposed_annotations"), F.lit(True).alias("restored"),
    )
    now = base.withColumns({
        "masked_characters": F.when(F.col("id").cast("bigint") % 10 == 9, F.array(F.lit(0))).otherwise(F.col("masked_characters")),
        "exact_fp": F.when(F.col("id").cast("bigint") % 11 == 0, F.lit(9)).otherwise(F.col("exact_fp")),
        "restored": F.col("id").cast("bigint") % 13 != 0,
    })
    return evaluate.regressions(now, base)


def corpus_fingerprints(spark, sf):
    return documents(spark, sf).select("doc_id", evaluate.fingerprint(F.col("text")).alias("digest"))


# --- activity ----------------------------------------------------------------

def _requests(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "EMAIL").when(F.col("event_type") == "error", "ORDER").otherwise("LITERAL")
    return e.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("forwarded"), (F.col("value") < 100).alias("completed"),
        F.concat(F.lit("see ["), kind, F.lit("_1] and [PHONE_2]")).alias("masked_text"),
    )


SALT = "catalog"


def activity_summary(spark, sf):
    out = activity.activity_summary(_requests(spark, sf), SALT)
    return out.select("session_ref", "requests", "forwarded", "completed", "failed")


def activity_occurrences(spark, sf):
    out = activity.activity_summary(_requests(spark, sf), SALT)
    return out.select("session_ref", F.explode("placeholder_occurrences").alias("entity_type", "n"))


def activity_retention(spark, sf):
    r = _requests(spark, sf)
    now = r.agg(F.max("ts")).first()[0]
    out = activity.activity_summary(r, SALT, now=now, ttl_seconds=600)
    return out.select("session_ref", "requests")


def _probes(events):
    """Even events are probes; odd ones that are no views answer the probe before them."""
    token = (F.col("event_id") / 2).cast("bigint").cast("string")
    probes = events.where("event_id % 2 = 0").select(token.alias("token"), F.col("ts").alias("created"))
    answers = events.where("event_id % 2 = 1 and event_type <> 'view'").select(
        token.alias("token"), "ts", F.lit(True).alias("masked"), (F.col("value") < 100).alias("forwarded"),
        F.lit(True).alias("restored"), F.lit(True).alias("completed"),
    )
    return probes, answers


def _timed_events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")


def probes_verified(spark, sf):
    return activity.verify_probes(*_probes(_timed_events(spark, sf))).select("token", "state")


def stream_probes(spark, sf):
    """Probes and answers as two streams of files; what the stream leaves open is pending."""
    base, events = _folder(spark, "probes"), _timed_events(spark, sf)
    probes, answers = _probes(_arriving(spark, events, "event_id", 3, f"{base}/in"))
    run = (
        activity.verify_probes_stream(probes, answers, keep="2 days").writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    settled = spark.read.schema("token string, created timestamp, state string").parquet(f"{base}/out")
    asked, _ = _probes(events)
    return settled.unionByName(activity.open_probes(asked, settled)).select("token", "state")


def stream_activity(spark, sf):
    """Requests in four files, every seventeenth a file late: counted in time, or in the late sink."""
    from ..sources.store import TableLog

    base, rows = _folder(spark, "activity"), _requests(spark, sf)
    low, high = rows.agg(F.min("request_id"), F.max("request_id")).first()
    step = (high - low + 4) // 4
    come = rows.withColumn("arrival", F.least(F.lit(3), F.floor((F.col("request_id") - low) / step) + (F.col("request_id") % 17 == 0).cast("int")))
    activity.activity_stream(_arriving(spark, come, "arrival", 4, f"{base}/in"), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    log = TableLog(spark, f"{base}/log")
    late = log.read()["late"].groupBy(activity.session_ref(F.col("session"), SALT).alias("session_ref")).agg(F.count(F.lit(1)).alias("late"))
    return activity.activity_totals(log, SALT).join(late, "session_ref", "full").select(
        "session_ref", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "forwarded", "completed", "failed", "late")]
    )


def support_totals(spark, sf):
    return activity.support_totals(activity.activity_summary(_requests(spark, sf), SALT))


# --- streams -----------------------------------------------------------------

def _stream(spark, sf, name, transform, label):
    """Run a stream over a table's files to the end, through a file sink."""
    import uuid

    from .runtime import shared_folder

    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = table(spark, sf, name).schema
    # A table is one file, or a folder of files: a pattern stands for either.
    rows = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")
    run = (
        transform(rows).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _folder(spark, label):
    import uuid

    from .runtime import shared_folder

    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of one arriving file, about; fewer are not cut.
FILE_ROWS = 1_000_000


def _arriving(spark, rows, order, parts, folder):
    """Rows as a stream of files that came one after the other: ``parts`` ranges of ``order``.

    Every range is the same number of files, all of which come in one batch.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - low) * parts / (high - low + 1))
    counts = [n for k, n in rows.groupBy(part.alias("k")).agg(F.count(F.lit(1))).collect() if k is not None]
    # Dealt by turns, each file of a range gets rows if there are many times more rows than files.
    files = max(1, min([spark.sparkContext.defaultParallelism * 4, *[n // FILE_ROWS for n in counts]])) if len(counts) == parts else 1
    for k in range(parts):
        one = rows.where(part == k)
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def stream_masked(spark, sf, parts=3):
    """Documents that come in several batches, one of them twice, masked into a log of tables."""
    from ..sources.store import TableLog
    from ..streaming.mask import mask_batch, mask_stream

    base, rows = _folder(spark, "masked"), sections(spark, sf)
    mask_stream(_arriving(spark, rows, "seq", parts, f"{base}/in"), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    log = TableLog(spark, f"{base}/log")
    again = spark.read.schema(rows.schema).parquet(f"{base}/in/000")
    if mask_batch(log, again, 0) is not None:
        raise AssertionError("a batch that was in the log was written again")
    return log.read()["masked"].select("session", "seq", "masked")


def vault_log(spark, sf):
    """Three batches of orders, a writer that died between them, and one session read from its bucket."""
    from ..sources.store import TableLog

    log, rows = TableLog(spark, _folder(spark, "vault")), _name_entities(spark, sf)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.floor((F.col("seq") - low) * 3 / (high - low + 1))
    for k in range(3):
        own = pin(rows.where(part == k))
        if k:
            log.claim("dead", lease_seconds=0)
        log.claim("next")
        held = log.read(sessions=own).get("values")
        log.append({"values": vault.assign(own, held)}, owner="next", writer="orders", batch=k)
    log.compact(many=2)
    return log.read(session="5-LOW")["values"].select("session", "entity_type", "number", "placeholder", "value")


def stream_restored(spark, sf):
    """Replies in pieces of one to nine characters, restored as they come; the vault is customers'."""
    from ..sources.store import TableLog
    from ..streaming.mask import replies, restore_stream

    base = _folder(spark, "restored")
    number = F.col("c_custkey") + 1
    names = table(spark, sf, "customer").select(
        F.concat(F.lit("s"), number % 7).alias("session"), F.lit("PERSON").alias("entity_type"), number.alias("number"),
        P.format_placeholder(F.lit("PERSON"), number).alias("placeholder"), F.col("c_name").alias("value"),
    )
    TableLog(spark, f"{base}/vault").append({"values": names})
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    c = c if small(c, 10_000) else dealt(c)
    who = (F.col("conv_id") % 20 + 1).cast("string")
    text = F.concat(F.lit("Dear [PERSON_"), who, F.lit("], "), "text", F.lit(" [person 0"), who, F.lit("] [PERSON_"), who, F.lit("0"))
    size = (F.col("conv_id") % 9 + 1).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / size).cast("int")), lambda i: F.substr("t", i * size + 1, size))
    stream = F.concat(F.lit("s"), (F.col("conv_id") % 20 + 1) % 7, F.lit("/"), "conv_id", F.lit("-"), "turn")
    each = c.select(stream.alias("stream_id"), "conv_id", text.alias("t")).select("stream_id", "conv_id", pieces.alias("p"))
    each = each.select("stream_id", "conv_id", F.size("p").alias("n"), F.posexplode("p").alias("seq", "piece")).select(
        "stream_id", "conv_id", F.col("seq").cast("bigint").alias("seq"), "piece", (F.col("seq") == F.col("n") - 1).alias("is_final"))
    # Halves of every reply come in different files.
    stream = _arriving(spark, each.withColumn("half", F.col("seq") % 2), "half", 2, f"{base}/in")
    restore_stream(
        stream, f"{base}/vault", f"{base}/log", f"{base}/checkpoint", session=F.substring_index("stream_id", "/", 1)
    ).awaitTermination()
    return replies(TableLog(spark, f"{base}/log").read()["restored"]).select("stream_id", F.md5("text").alias("digest"))


def stream_settled(spark, sf):
    """Conversations cut in pieces of seven characters, settled again."""
    from ..streaming.mask import settle_stream

    def shape(d):
        # What stands beside a generator is computed for each of its rows: no pieces there.
        last = F.floor((F.length("t") - 1) / 7).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("t", i * 7 + 1, F.lit(7)))
        whole = d.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.concat(F.lit("[PERSON_1] "), "text").alias("t"))
        each = whole.select("stream_id", F.posexplode(pieces).alias("p", "piece"), (last + 1).alias("n"))
        return settle_stream(each.select("stream_id", F.col("p").cast("bigint").alias("seq"), "piece", (F.col("p") == F.col("n") - 1).alias("is_final")))

    out = _stream(spark, sf, "conversations", shape, "settled")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "")
    return out.groupBy("stream_id").agg(F.md5(whole).alias("digest"))


QUERIES = {
    "detect_email": rule_query("email", pii.detect_email),
    "detect_email_pages": rule_query("email", pii.detect_email, text_table="pages", key="page_id", text="html"),
    "detect_phone": rule_query("phone", pii.detect_phone_us, pii.detect_phone_intl),
    "detect_ipv4": rule_query("ipv4", pii.detect_ipv4),
    "detect_card": rule_query("card", pii.detect_card),
    **{f"detect_{name}": derived_query(name) for name in (
        "ssn", "ssn_labelled", "iban", "ipv6", "card_printed", "phone_abroad", "api_key_prefix", "auth_header",
        "labelled_secret", "private_key", "url_credential", "cookie", "escaped_secret", "block_secret")},
}
for _f in (
    detect_field, detect_custom, detect_literal, detect_registry, mask_documents, mask_round_trip, mask_entity_view, mask_documents_warnings,
    mask_source_sessions, vault_values, vault_global, vault_assign, vault_sizes, vault_lookup, vault_clear,
    vault_touch, vault_purge, restore_documents, restore_sessions, restore_tolerant, restore_unknown,
    trace_documents, leak_check, mask_known, withhold_lines, count_private_values, folded_match,
    placeholder_like_input, quarantine, literal_types, merge_overlaps, resolve_spans, resolve_spans_leftmost,
    dedupe_spans, normalize_documents, normalize_derived, unify_spellings, registry_counts, registry_errors,
    registry_changes, messages_to_sections, annotated_gold, review_findings, review_fragments,
    confirm_findings, json_leaves, json_masked, json_refused, json_restored, json_numbers_refused, json_key_collisions,
    ledger_replay, ledger_seen, ledger_tools, evaluate_scores, evaluate_coverage, evaluate_characters,
    evaluate_overmasked, evaluate_leaks, evaluate_restoration, evaluate_latency, evaluate_regressions,
    corpus_fingerprints, activity_summary, activity_occurrences, activity_retention, probes_verified,
    support_totals, blocks_to_sections, detect_validated, code_values, unify_second_batch, cut_leaks, vault_remembered,
    review_unprotected, resolve_one_text, merge_partial_spans, stream_settled, stream_masked, stream_restored, stream_probes, stream_activity, vault_log,
):
    QUERIES[_f.__name__] = _f
