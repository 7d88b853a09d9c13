"""Credential rules: provider keys, headers, labelled values, blocks, URLs.

Each rule is one pass: the label stays, the value becomes the span, and the
label is carried along so that the type can be read from it.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .pii import R_FIELD, R_SECRET
from .spans import AFTER, MARK, guard, hits, no_spans, span, to_spans


def _encoded(word: str) -> str:
    r"""``word`` with any letter also written ``\u0077`` or ``%77``."""
    out = []
    for ch in word:
        codes = {f"{ord(c):02x}" for c in (ch.lower(), ch.upper())}
        forms = [f"[{ch}]" if ch in "-_" else ch]
        forms += [rf"\\{{1,8}}u00{c}" for c in sorted(codes)]
        forms += [f"%{c}" for c in sorted(codes)]
        out.append(f"(?:{'|'.join(forms)})")
    return "(?i:" + "".join(out) + ")"


def _any(words) -> str:
    return "|".join(_encoded(w) for w in words)


# Words that name a credential, by the type they stand for.
PASSWORD_WORDS = ("password", "passphrase")
PASSWORD_PARTS = ("passwd", "pwd", "pass")
KEY_WORDS = ("api_key", "api-key", "apikey", "secret_key", "secret-key", "secretkey",
             "private_key", "privatekey", "access_key", "access-key")
KEY_PARTS = ("secret",)
TOKEN_PARTS = ("token",)
TOKEN_OWNERS = ("api", "github", "gitlab", "auth", "access", "refresh", "bearer", "session", "bot")
CREDENTIAL_PARTS = ("credentials", "credential")
SIGNATURE_NAMES = ("x-amz-signature", "x-goog-signature", "signature", "sig")

_PRE = r"(?:[A-Za-z0-9_.\-]*[_.\-])?"
NAME_PASSWORD = (
    rf"(?:[A-Za-z0-9_.\-]*(?:{_any(PASSWORD_WORDS)})|{_PRE}(?:{_any(PASSWORD_PARTS)})"
    r"|[a-z0-9]+(?:Passwd|Pwd|Pass))"
)
NAME_KEY = (
    rf"(?:[A-Za-z0-9_.\-]*(?:{_any(KEY_WORDS)})|{_PRE}(?:{_any(KEY_PARTS)})|[a-z0-9]+Secret)"
)
NAME_TOKEN = (
    rf"(?:{_PRE}(?:{_any(TOKEN_PARTS)})|(?i:{'|'.join(TOKEN_OWNERS)})(?i:token)|[a-z0-9]+Token)"
)
NAME_CREDENTIAL = rf"(?:{_PRE}(?:{_any(CREDENTIAL_PARTS)}))"
NAME_CREDENTIAL_ANY = f"(?:{NAME_PASSWORD}|{NAME_KEY}|{NAME_TOKEN}|{NAME_CREDENTIAL})"


def _plain(words) -> str:
    return "(?i:" + "|".join(words) + ")"


#: A whole name that ends in a credential word: take the run of name
#: characters, then look back at its end (linear, whatever the text).
NAME = (
    r"(?:[A-Za-z_][A-Za-z0-9_.\-]++(?:"
    rf"(?<={_plain(PASSWORD_WORDS + KEY_WORDS)})"
    rf"|(?<=(?<![A-Za-z0-9]){_plain(PASSWORD_PARTS + KEY_PARTS + TOKEN_PARTS + CREDENTIAL_PARTS)})"
    rf"|(?<={_plain(TOKEN_OWNERS)}(?i:token))|(?<=[a-z0-9](?:Passwd|Pwd|Pass|Secret|Token))))"
)
#: The same where letters may be written as escapes.
NAME_ESCAPED = rf"(?:{NAME}|(?=[^\s\"'=&]*?(?:\\u00|%[2-7])){NAME_CREDENTIAL_ANY})"
LEFT = r"(?<![A-Za-z0-9_])"

# Key and token prefixes that providers publish.
KEY_PREFIX = (
    r"(?<![A-Za-z0-9_\-])(?:sk-[A-Za-z0-9_\-]{20,}+|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}+"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])"
    r"|SG\.[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+)"
)
TOKEN_PREFIX = (
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+"
    r"|glpat-[A-Za-z0-9_\-]{16,}+|xox[abeprs]-[A-Za-z0-9\-]{10,}+"
    r"|npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])|hf_[A-Za-z0-9]{20,}+|ya29\.[A-Za-z0-9_\-]{20,}+"
    r"|eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{4,}+\.[A-Za-z0-9_\-]{4,}+)"
)
PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?s:.*?)"
    r"(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|(?=\"\s*[,}])|\s*\z)"
)
AUTH_HEADER = (
    r"((?i:\bauthorization)[\"']?[ \t]*[:=][ \t]*[\"']?(?i:bearer|basic|token)[ \t]+"
    r"|(?i:\bbearer)[ \t]+(?=[A-Za-z._~+/\-]*+[0-9])(?=[A-Za-z0-9._~+/=\-]{16}))"
    r"([A-Za-z0-9._~+/\-]{4,}+=*+)"
)
KEY_HEADER = r"((?i:\bx-(?:api-key|auth-token|access-token))[\"']?[ \t]*:[ \t]*[\"']?)([^\s\"'$<{,;]{4,}+)"
PARAMETER = (
    rf"([?&](?:{NAME_ESCAPED}|(?:{_any(SIGNATURE_NAMES)}))=)([^&#\s\"'<>$\{{][^&#\s\"'<>]*)"
)
USERINFO = r"((?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]{0,30}://)([^\s/@:\"'<>]*+:[^\s/@\"'<>$\{]++)(?=@)"
#: A cookie whose name says that it holds a session or a token.
COOKIE_NAME = (
    r"^(?:__Host-|__Secure-)?(?i:[A-Za-z0-9_.\-]*(?:sid|sess|session|sessionid|session_id|session-id"
    r"|auth|auth_token|authtoken|token|jwt|_access|-access))$"
)
#: Every pair of a cookie header in turn; flags without a value are passed over.
COOKIE = (
    r"((?:(?<![A-Za-z\-])(?i:(?:set-)?cookie):[ \t]*+|(?!\A)\G[ \t]*+;[ \t]*+)(?:[^;=\r\n]*+;[ \t]*+)*+)"
    r"([^;=\r\n]++)(=)([^;\s\"]*+)([^;\r\n]*+)"
)
_DQ = r'(?:(?:[^"\\]++|\\(?s:.))*+)'
_SQ = r"(?:(?:[^'\\]++|\\(?s:.))*+)"
_TYPE = r"(?:[&*]?[A-Za-z_][A-Za-z0-9_.]{0,40}(?:[<\[][A-Za-z0-9_.,<>\[\] |]{0,60}[>\]])?)"
_ASSIGN = (
    rf"(?:[ \t]*:[ \t]*{_TYPE}[ \t]*:?=[ \t]*|[ \t]+{_TYPE}[ \t]*=[ \t]*"
    r"|[ \t]*(?::=|=>|=|:)[ \t]*|[ \t]+is[ \t]+)"
)
_QUOTED_NAME = rf"[\"'](?<name1>{NAME_ESCAPED})[\"'][ \t]*(?:=>|:|=)[ \t]*"
_BARE_NAME = rf"{LEFT}(?<name2>{NAME})(?<![\"'][A-Za-z0-9_ .\-]{{0,120}}){_ASSIGN}"
#: A quoted value, and the literals joined to it by "+".
QUOTED = (
    rf"((?:{_QUOTED_NAME}|{_BARE_NAME})(?=[\"'])|(?<=[\"'])(?!\A)\G[ \t]*\+[ \t]*(?=[\"']))"
    rf"(?:(?<open>\"\"\"|''')(?<block>(?s:.*?))(?<close>\"\"\"|'''|\z)"
    rf"|(?<q1>\")(?<double>{_DQ})(?<q2>\"|\z)|(?<q3>')(?<single>{_SQ})(?<q4>'|\z))"
)
QUOTED_TO = (
    f"$1${{open}}${{q1}}${{q3}}{MARK}${{block}}${{double}}${{single}}"
    f"{AFTER}${{name1}}${{name2}}{MARK}${{q2}}${{q4}}${{close}}"
)
#: JSON inside a JSON string: names and values in escaped quotes.
ESCAPED = (
    rf"((\\{{1,15}})\"(?<name>{NAME})\2\"[ \t]*:[ \t]*\2\")((?s:.*?))(?=(?<!\\)\2\"|\z)"
)
_ESCAPE = r"\\{1,16}u[0-9A-Fa-f]{4}"
#: A JSON name with escaped characters, plain or inside a JSON string. The value is only looked ahead to: it
#: may itself hold JSON, and whether the name is a credential's is known when it has been decoded.
ESCAPED_NAME = (
    rf"(?:(?<open>\\{{1,15}})\"(?<name1>[A-Za-z0-9_.\-]*+(?:{_ESCAPE}[A-Za-z0-9_.\-]*+)++)\k<open>\"[ \t]*:[ \t]*\k<open>\""
    r"(?=(?<value1>(?s:.*?))(?:(?<!\\)\k<open>\"|\z))"
    rf"|(?<!\\)\"(?<name2>[A-Za-z0-9_.\-]*+(?:{_ESCAPE}[A-Za-z0-9_.\-]*+)++)\"[ \t]*:[ \t]*\"(?=(?<value2>{_DQ})))"
)
_FIELD_VALUE = r"[^&#\s\"'<>$\{][^&#\s\"'<>]*+"
#: A field of a form-urlencoded body: with a name in percent codes, or the first of several (the others follow "&").
FORM = (
    r"((?<name>(?<![^\s\"'?&])[A-Za-z0-9_.\-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.\-]*+)++"
    rf"|(?<![^\s\"']){NAME}(?==[^&#\s\"'<>]*+(?:&[^&=#\s\"'<>]++=[^&#\s\"'<>]*+)++(?:[\s\"']|\z)))=)({_FIELD_VALUE})"
)
#: ``NAME=value`` alone on a line: the whole rest of the line is the value.
ENV = (
    rf"((?m:^)[ \t]*[+\-]?(?:export[ \t]+|set[ \t]+)?(?<name>(?=[A-Z0-9_]{{2,80}}=){NAME})=)"
    r"(?=[^\s\"'`$({<\[])([^\r\n&]*?)(?=[ \t]*(?:[ \t]#[^\r\n]*)?(?m:$))"
)
UNQUOTED = (
    rf"({LEFT}(?<name>{NAME})(?<![\"'][A-Za-z0-9_ .\-]{{0,120}})(?:[ \t]*[:=][ \t]*(?:{_TYPE}[ \t]*=[ \t]*)?))"
    r"([^\s\"'`,;&|(){}\[\]<>$=#\\:][^\s\"'`,;&|(){}\[\]<>$]*+)(?![(\[\"'])"
)
OPTION = (
    rf"((?<![A-Za-z0-9\-])--(?<name>{NAME})(?:[ \t]+|=))"
    rf"(?:(?<q1>\")(?<double>{_DQ})(?<q2>\"|\z)|(?<q3>')(?<single>{_SQ})(?<q4>'|\z)|(?<bare>[^\s\"'$\-][^\s\"']*))"
)
OPTION_TO = (
    f"$1${{q1}}${{q3}}{MARK}${{double}}${{single}}${{bare}}{AFTER}${{name}}{MARK}${{q2}}${{q4}}"
)
BLOCK = (
    rf"((?m:^)(?<indent>[ \t]*+)(?:- )?[\"']?(?<name>{NAME})[\"']?[ \t]*:[ \t]*[|>][+\-]?[0-9]?[+\-]?[ \t]*(?:#[^\n]*)?\n)"
    r"((?:\k<indent>[ \t]++[^\s][^\n]*+)(?:\n(?:\k<indent>[ \t]++[^\n]*+|[ \t]*+(?=\n)))*+)"
)
SPOKEN = (
    r"((?i:\b(?:hasło|haslo)[ \t]+(?:to|jest)|\bcontrase(?:ñ|n)a[ \t]+es)[ \t:]+)"
    r"(?![\"'])([^\s,;]*[^\s,;.!?])"
)
RECOVERY = (
    r"((?i:\b(?:recovery|backup)[ \-]+code)[ \t]*[:=][ \t]*)(?=[^\s,;]*[0-9\-])([^\s,;\"']*[^\s,;.!?\"'])"
)
PAYLOAD = (
    r"(\"(?i:password|secret|token|credential)[_\-](?:payload|data|value|content)\"[ \t]*:[ \t]*\")"
    r"([A-Za-z0-9+/=_\-]{4,}+)(?=\")"
)
CUE = (
    r"(?=[pPsStTcCaAkK\\%])(?i:pass|pwd|secret|token|credential|api[_\-]?key|private_?key"
    r"|access[_\-]?key|\\u00[0-9a-f]{2}|%[2-7][0-9a-f])"
)



def credential_type(name: Column) -> Column:
    """The type a field name stands for, or null when it names no credential."""
    def named(pattern):
        return name.rlike(rf"^(?:{pattern})$")

    # Every such name holds a cue: most names are told by one cheap pattern.
    return (
        F.when(~name.rlike(CUE), F.lit(None).cast("string"))
        .when(named(NAME_PASSWORD), "PASSWORD")
        .when(named(NAME_TOKEN), "TOKEN")
        .when(named(NAME_KEY), "API_KEY")
        .when(named(NAME_CREDENTIAL), "CREDENTIAL")
    )


# Words that say a value is a type, a constant or a reference.
CODE_WORDS = (
    r"(?i:none|null|nil|true|false|undefined|str|string|bytes|int|bool|any|object|final"
    r"|secretstr|option|optional|required|varchar|text)"
)
CODE_ROOTS = "(?:settings|config|self|this|args|opts|options|os|env|process|params|request|req|ctx|secrets|vars)"


def is_code_value(value: Column, name: Column) -> Column:
    """A type, a reference, an echo of the name, or an identifier naming a credential."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), r"[_.\-]+")
    return (
        value.rlike(rf"^[&*]?{CODE_WORDS}(?:[<\[?].*)?$")
        | value.rlike(r"^(?:\$|\{\{|<|%\(|@)")
        | (F.lower(value) == F.lower(name))
        | F.array_contains(words, F.lower(value))
        | value.rlike(rf"^{CODE_ROOTS}\.[A-Za-z_]")
        | value.rlike(
            r"^(?:[A-Za-z_][A-Za-z0-9_]*[._])(?:[A-Za-z0-9_]+\.)*[A-Za-z0-9_]*"
            r"(?i:password|passwd|passphrase|pwd|secret|token|api_?key|key|credentials?)$"
        )
        | value.rlike(r"^(?:[A-Z][a-z0-9]+)+(?:Password|Passphrase|Token|Secret|Key|Credentials?)$")
        | value.rlike(r"^/(?:[A-Za-z0-9_.\-]+/)*[A-Za-z0-9_.\-]+$")
    )


def _reference(value: Column) -> Column:
    """A quoted value that is only a template or environment reference."""
    return value.rlike(r"^\s*(?:\$\{[^}]*\}|\$[A-Za-z_]\w*|\{\{.*\}\}|<[^>]*>|%[A-Za-z_]\w*%)\s*$") | value.rlike(
        rf"^{X.EXACT}$"
    )


def _typed(found: Column, rule: int, code: bool = False) -> Column:
    """Spans typed by the label carried after each value."""
    kept = F.filter(
        found,
        lambda h: (F.length(h["value"]) > 0)
        & ~_reference(h["value"])
        & (~is_code_value(h["value"], h["after"]) if code else F.lit(True)),
    )
    return F.transform(
        kept,
        lambda h: span(h["start"], h["value"], label_type(h["after"]), "secret", 0, rule),
    )


def label_type(label: Column) -> Column:
    """Type of a label known to name a credential (signatures are tokens)."""
    return (
        F.when(label.rlike(rf"(?:{_any(PASSWORD_WORDS + PASSWORD_PARTS)})$"), "PASSWORD")
        .when(label.rlike(rf"(?:{_any(TOKEN_PARTS + SIGNATURE_NAMES)})$"), "TOKEN")
        .when(label.rlike(rf"(?:{_any(CREDENTIAL_PARTS)})$"), "CREDENTIAL")
        .when(label.rlike(rf"(?:{_any(KEY_WORDS + KEY_PARTS)})$"), "API_KEY")
        .otherwise("API_KEY")
    )


def _pick(name: str, groups: str = f"$1{MARK}$2{AFTER}") -> str:
    return f"{groups}{name}{MARK}"


def holds(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def detect_api_key_prefix(text: Column) -> Column:
    return F.concat(
        guard(holds(text, "sk-", "sk_", "rk_", "AKIA", "ASIA", "AIza", "SG."),
              to_spans(hits(text, KEY_PREFIX), "API_KEY", R_SECRET, "secret")),
        guard(holds(text, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "npm_", "hf_", "ya29", "eyJ"),
              to_spans(hits(text, TOKEN_PREFIX), "TOKEN", R_SECRET + 1, "secret")),
    )


def detect_private_key(text: Column) -> Column:
    return guard(text.contains("PRIVATE KEY-----"),
                 to_spans(hits(text, PRIVATE_KEY), "PRIVATE_KEY", R_SECRET + 2, "secret"))


def detect_auth_header(text: Column) -> Column:
    bearer = to_spans(hits(text, AUTH_HEADER, f"$1{MARK}$2{MARK}"), "TOKEN", R_SECRET + 3, "secret")
    key = hits(text, KEY_HEADER, f"{MARK}{MARK}$1{MARK}$2{AFTER}$1{MARK}")
    keyed = F.transform(
        F.filter(key, lambda h: F.length(h["value"]) > 0),
        lambda h: span(
            h["start"], h["value"],
            F.when(h["after"].rlike("(?i)api-key"), "API_KEY").otherwise("TOKEN"),
            "secret", 0, R_SECRET + 4,
        ),
    )
    return F.concat(
        guard(text.rlike(r"[aAbB](?i:uthorization|earer)"), bearer),
        guard(text.rlike(r"[xX]-(?i:api-key|auth-token|access-token)"), keyed),
    )


def detect_url_credential(text: Column) -> Column:
    params = _typed(
        F.transform(
            hits(text, PARAMETER, f"$1{MARK}$2{AFTER}$1{MARK}"),
            lambda h: F.struct(
                h["start"].alias("start"), h["value"].alias("value"),
                F.regexp_replace(h["after"], "^[?&]|=$", "").alias("after"),
            ),
        ),
        R_SECRET + 6,
    )
    users = to_spans(hits(text, USERINFO, f"$1{MARK}$2{MARK}"), "CREDENTIAL", R_SECRET + 5, "secret")
    return F.concat(
        guard(text.contains("://"), users),
        guard(text.rlike(r"[?&][A-Za-z0-9_.%\-]{2,}+="), params),
    )


def detect_cookie(text: Column) -> Column:
    pairs = hits(text, COOKIE, f"$1$2$3{MARK}$4{AFTER}$2{MARK}$5")
    named = F.filter(pairs, lambda h: (F.length(h["value"]) > 0) & F.trim(h["after"]).rlike(COOKIE_NAME))
    return guard(text.rlike(r"[cC](?i:ookie:)"), to_spans(named, "TOKEN", R_SECRET + 7, "secret"))


def detect_labelled_secret(text: Column) -> Column:
    quoted = hits(text, QUOTED, QUOTED_TO)
    env = hits(text, ENV, f"$1{MARK}$3{AFTER}${{name}}{MARK}")
    bare = hits(text, UNQUOTED, f"$1{MARK}$3{AFTER}${{name}}{MARK}")
    option = hits(text, OPTION, OPTION_TO)
    carried = F.filter(quoted, lambda h: F.length(h["value"]) > 0)
    return F.concat(
        _concatenated(carried),
        guard(text.rlike(r"(?m)^[ \t]*[+\-]?(?:export |set )?[A-Z0-9_]+="), _typed(env, R_SECRET + 9, code=True)),
        _typed(bare, R_SECRET + 10, code=True),
        guard(text.contains("--"), _typed(option, R_SECRET + 11)),
    )


def _concatenated(found: Column) -> Column:
    """Typed spans; a joined literal has no label of its own and takes the
    type of the labelled one before it."""
    start = F.struct(F.lit("").alias("label"), no_spans().alias("out"))

    def step(acc, h):
        label = F.when(F.coalesce(h["after"], F.lit("")) != "", h["after"]).otherwise(acc["label"])
        item = span(h["start"], h["value"], label_type(label), "secret", 0, R_SECRET + 8)
        return F.struct(
            label.alias("label"),
            F.when(_reference(h["value"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"),
        )

    return F.aggregate(found, start, step, lambda a: a["out"])


def _decoded(name: Column) -> Column:
    r"""``name`` with ``\u0077`` and ``%77`` read as the characters they stand for (ASCII: names have no others)."""
    parts = F.regexp_extract_all(name, F.lit(r"\\+u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2}|(?s:.)"), F.lit(0))
    code = lambda c: F.conv(F.right(c, F.lit(2)), 16, 10).cast("bigint")
    one = lambda c: F.when(c.rlike(r"^(?:\\+u00|%)[2-7]"), F.char(code(c))).otherwise(c)
    return F.when(name.rlike(r"[\\%]"), F.array_join(F.transform(parts, one), "")).otherwise(name)


def _by_decoded_name(found: Column) -> Column:
    """Hits whose label, decoded, names a credential, with that label."""
    named = F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["value"].alias("value"), _decoded(h["after"]).alias("after")))
    return F.filter(named, lambda h: h["after"].rlike(f"^{NAME}$"))


def detect_escaped_secret(text: Column) -> Column:
    """JSON inside JSON strings, names with escaped characters, and fields of form bodies, each up to its "&".

    Names are decoded; values keep the spelling of their source.
    """
    ahead = hits(text, ESCAPED_NAME, f"$0{MARK}{AFTER}${{name1}}${{name2}}:${{value1}}${{value2}}{MARK}")
    coded = F.transform(ahead, lambda h: F.struct(
        h["start"].alias("start"), F.substr(h["after"], F.locate(":", h["after"]) + 1).alias("value"),
        F.substring_index(h["after"], ":", 1).alias("after"),
    ))
    form = hits(text, FORM, f"$1{MARK}$3{AFTER}${{name}}{MARK}")
    return F.concat(
        guard(text.contains('\\"'),
              _typed(hits(text, ESCAPED, f"$1{MARK}$4{AFTER}${{name}}{MARK}"), R_SECRET + 12)),
        guard(text.contains("\\u00"), _typed(_by_decoded_name(coded), R_SECRET + 12)),
        guard(text.contains("=") & holds(text, "%", "&"), _typed(_by_decoded_name(form), R_SECRET + 12, code=True)),
    )


def detect_spoken_secret(text: Column) -> Column:
    return F.concat(
        guard(holds(text, "hasło", "Hasło", "haslo", "Haslo", "contrase", "Contrase"),
              to_spans(hits(text, SPOKEN, f"$1{MARK}$2{MARK}"), "PASSWORD", R_SECRET + 14, "secret")),
        guard(text.rlike(r"[cC](?i:ode)[ \t]*[:=]"),
              to_spans(hits(text, RECOVERY, f"$1{MARK}$2{MARK}"), "CREDENTIAL", R_SECRET + 15, "secret")),
    )


def detect_block_secret(text: Column) -> Column:
    return F.concat(
        guard(text.rlike(r":[ \t]*[|>]"),
              _typed(hits(text, BLOCK, f"$1{MARK}$4{AFTER}${{name}}{MARK}"), R_SECRET + 13)),
        guard(text.rlike("_(?i:payload|data|value|content)\""),
              _payload(text)),
    )


def _payload(text: Column) -> Column:
    found = hits(text, PAYLOAD, f"$1{MARK}$2{AFTER}$1{MARK}")
    return F.transform(found, lambda h: span(
        h["start"], h["value"],
        label_type(F.regexp_extract(h["after"], r"(?i)(password|secret|token|credential)", 1)),
        "secret", 0, R_SECRET + 16))


SECRET_RULES = (
    detect_api_key_prefix,
    detect_private_key,
    detect_auth_header,
    detect_url_credential,
    detect_cookie,
    detect_spoken_secret,
)
#: Rules that need a word naming a credential somewhere in the text.
CUED_RULES = (detect_labelled_secret, detect_escaped_secret, detect_block_secret)


def detect_field(text: Column, name: Column) -> Column:
    """The whole string is a secret when its field name says so."""
    kind = credential_type(name)
    usable = kind.isNotNull() & (F.length(F.trim(text)) > 0) & ~_reference(text) & ~is_code_value(text, name)
    return F.when(
        F.coalesce(usable, F.lit(False)),
        F.array(span(F.lit(0), text, kind, "secret", 0, R_FIELD)),
    ).otherwise(no_spans())


def drop_email_in_credential(found: Column) -> Column:
    """Drop a built-in EMAIL that starts inside a CREDENTIAL and outlasts it."""
    inside = lambda e: F.exists(
        found,
        lambda c: (c["entity_type"] == "CREDENTIAL")
        & (c["start"] <= e["start"]) & (e["start"] < c["end"]) & (c["end"] < e["end"]),
    )
    return F.when(
        F.exists(found, lambda c: c["entity_type"] == "CREDENTIAL"),
        F.filter(
            found,
            lambda e: ~((e["entity_type"] == "EMAIL") & (e["priority"] == X.BUILTIN) & inside(e)),
        ),
    ).otherwise(found)
