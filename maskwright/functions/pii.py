"""Built-in personal data rules as column expressions (no Python at run time)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .spans import (
    AFTER, CONTEXT, MARK, first, guard, hits, let, marks, no_spans, running, span, to_spans,
)

R_EMAIL, R_US, R_INTL, R_IPV4, R_IPV6, R_CARD, R_IBAN, R_SSN, R_SSN2 = range(1, 10)
R_CUSTOM, R_SECRET, R_FIELD = 20, 1000, 2000


def has_digits(text: Column) -> Column:
    """Cheap test before every rule that needs a number."""
    return text.rlike(rf"{X.DIGIT}[^\p{{L}}]{{0,4}}{X.DIGIT}")


def domain_of(text: Column) -> Column:
    """The longest host name that ``text`` begins with, or an empty string.

    Names between points are read in order; the last one may be cut where it
    stops looking like a top-level name.
    """
    def label(part):
        return F.length(part).between(1, X.LABEL_LENGTH) & ~part.startswith("-") & ~part.endswith("-")

    def top(part):
        coded = F.regexp_extract(part, X.TOP_PUNYCODE, 0)
        return F.when(coded != "", coded).otherwise(F.regexp_extract(part, X.TOP_LETTERS, 0))

    def ended(x):
        tops = F.filter(F.sequence(F.lit(1), F.size(x["p"]) - 1), lambda j: (j <= x["n"]) & (top(F.get(x["p"], j)) != ""))
        return F.when((F.size(x["p"]) > 1) & (x["n"] > 0), let(
            F.array_max(tops), lambda j: F.concat(F.array_join(F.slice(x["p"], F.lit(1), j), "."), F.lit("."), top(F.get(x["p"], j)))
        ))

    parts = F.slice(F.split(F.regexp_extract(text, "^[A-Za-z0-9.-]*+", 0), r"\."), 1, X.DOMAIN_PARTS)
    read = let(parts, lambda p: let(F.array_position(F.transform(p, label), False).cast("int"), lambda bad: F.struct(
        p.alias("p"), F.when(bad > 0, bad - 1).otherwise(F.size(p)).alias("n")
    )))
    return F.coalesce(let(read, ended), F.lit(""))


def _plain_local(text: Column) -> Column:
    """Whether all of ``text`` can stand before an at sign."""
    return (F.length(text) <= X.LOCAL_LENGTH) & text.rlike(rf"^{X.LOCAL}++(?:{X.LOCAL_SEP}{X.LOCAL}++)*+\z")


def _local_end(text: Column) -> Column:
    """The longest end of ``text`` that can stand before an at sign, if it begins behind a
    separator or where a script without spaces gives way to another; else an empty string."""
    tail = F.right(text, F.lit(X.LOCAL_LENGTH + 1))
    behind = rf"(?:{X.LOCAL_SEP}|[{X.UNSPACED}](?![{X.UNSPACED}]))"
    return F.regexp_extract(tail, rf"{behind}({X.LOCAL}++(?:{X.LOCAL_SEP}{X.LOCAL}++)*+)\z", 1)


def is_email(value: Column) -> Column:
    """Whether ``value`` is one address."""
    sides = F.split(value, "@", -1)
    return (F.size(sides) == 2) & let(sides, lambda s: _plain_local(F.get(s, 0)) & (domain_of(F.get(s, 1)) == F.get(s, 1)) & (F.get(s, 1) != ""))


def detect_email(text: Column) -> Column:
    """Runs of address characters are split at their at signs.

    What is left of a sign ends in a local part, what is right of it begins
    with a host. A host takes its characters from the local part that follows;
    that one may then begin right behind it, if it can't begin later.
    """
    run = rf"(?<!{X.LOCAL}|{X.LOCAL_SEP})(?:{X.LOCAL}|{X.LOCAL_SEP})*+@(?:{X.LOCAL}|{X.LOCAL_SEP}|@)*+"

    def sides(x, i):
        left, host = F.get(x["p"], i - 1), F.get(x["d"], i)
        rest = F.substr(left, F.length(F.get(x["d"], i - 1)) + 1)
        glued = let(rest, lambda r: let(_local_end(r), lambda later: F.when(later != "", later).when(_plain_local(r), r).otherwise("")))
        return F.struct(
            host.alias("host"),
            F.when(host == "", "").when(_plain_local(left), left).otherwise(_local_end(left)).alias("open"),
            # Before the first sign there is no host that could take characters.
            F.when((host == "") | (i == 1), "").otherwise(glued).alias("glued"),
        )

    def chosen(side, before):
        return F.when(before == "1", side["glued"]).otherwise(side["open"])

    def addresses(hit):
        def listed(x):
            # One digit a sign: whether an address is around it.
            taken = F.aggregate(x["s"], F.lit("0"), lambda acc, side: F.concat(
                acc, F.when(chosen(side, F.right(acc, F.lit(1))) != "", "1").otherwise("0")
            ))
            return let(taken, lambda t: F.filter(
                F.transform(x["s"], lambda side, i: let(chosen(side, F.substr(t, i + 1, F.lit(1))), lambda local: F.when(local != "", F.struct(
                    (hit["start"] + F.get(x["at"], i + 1) - 1 - F.length(local)).cast("int").alias("start"),
                    F.concat(local, F.lit("@"), side["host"]).alias("value"),
                )))), lambda h: h.isNotNull(),
            ))

        pieces = let(F.split(hit["value"], "@", -1), lambda p: F.struct(
            p.alias("p"), F.transform(p, lambda v, k: F.when(k > 0, domain_of(v)).otherwise("")).alias("d"), running(F.transform(p, lambda v: F.length(v) + 1)).alias("at"),
        ))
        return let(let(pieces, lambda x: F.struct(
            F.transform(F.sequence(F.lit(1), F.size(x["p"]) - 1), lambda i: sides(x, i)).alias("s"), x["at"].alias("at"),
        )), listed)

    found = F.flatten(F.transform(hits(text, run), addresses))
    return guard(F.contains(text, F.lit("@")), to_spans(found, "EMAIL", R_EMAIL))


#: What every North American number holds: the end of an area code, and two groups of their whole sizes.
US_SHAPE = "{0}{{{1}}}(?:{4}|\\){4}?){0}{{{2}}}{4}{0}{{{3}}}(?!{0})".format(X.DIGIT, *X.US_GROUPS, X.SEP)


def _us_numbers(text: Column) -> Column:
    """North American numbers: ``start``, ``value`` of each, in order, none inside another.

    Runs of digit groups are read group by group: at an area code, the next two
    groups must have their sizes, and what is between, before and behind the
    groups decides whether they are a number, and where it begins.
    """
    inside = rf"[+(){X.SEP_CHARS}]"
    run = rf"([+()]*+{X.DIGIT}++(?:{inside}++{X.DIGIT}++){{2,}}+)"
    # Both groups always match, if only nothing: one that is left out would keep what it held elsewhere.
    before, colons = r"(?<=(^|(?s:.)))", "::|:[0-9A-Fa-f]{1,4}:"
    hexed = f"(?<=((?:{colons})|(?<!{colons})))"
    found = hits(text, f"{before}{hexed}{run}(?=((?s:.{{0,24}})))", f"{MARK}$3{AFTER}$2$1($4{MARK}")
    area, exchange, line = X.US_GROUPS

    def at(x, i):
        group = lambda k: F.coalesce(F.get(x["g"], i + k), F.lit(""))
        # What stands before a group; nothing before the first one of the run is an empty string.
        gap = lambda k: F.coalesce(F.get(x["s"], i + k), F.lit(""))
        end = lambda k: F.right(gap(k), F.lit(1))
        one = lambda k: gap(k).rlike(f"^{X.SEP}$")
        head = lambda k: F.get(x["at"], i + k)
        first_group = lambda k: (i + k) == 0
        after_letter, after_colons = x["before"].rlike("^[A-Za-z]$"), x["before"].startswith(":") & (F.length(x["before"]) > 1)

        enclosed = (end(0) == "(") & gap(1).rlike(rf"^\){X.SEP}?$")
        sizes = (F.length(group(1)) == exchange) & (F.length(group(2)) == line) & one(2)
        last = i + 3 == F.size(x["g"])
        extension = F.when(last, F.regexp_extract(x["after"], rf"^({X.EXTENSION}(?<={X.DIGIT})(?!{X.DIGIT}))(?!{X.NOT_CLEAN})", 1)).otherwise("")
        clean = F.when(last, ~x["after"].rlike("^[A-Za-z]")).otherwise(~gap(3).rlike(f"^{X.DASH_DOT}$"))

        def trunk(k):
            """Where the number begins if group ``k`` holds the digit before the area code."""
            plus = end(k) == "+"
            lead = F.when(plus, F.substr(gap(k), F.lit(1), F.length(gap(k)) - 1)).otherwise(gap(k))
            open_start = F.when(
                lead == "", first_group(k) & ~after_letter & ~after_colons
            ).otherwise((F.right(lead, F.lit(1)) != "+") & ((lead != ".") | first_group(k)))
            return F.when(open_start & F.get(x["g"], i + k).startswith(X.US_TRUNK), head(k) - F.when(plus, 1).otherwise(0))

        def quad(k):
            """Whether groups ``k`` to ``k + 3`` are a dotted address."""
            octets = [F.coalesce(F.get(x["g"], F.greatest(i + k + n, F.lit(0))), F.lit("")).rlike(f"^{X.PADDED_OCTET}$") for n in range(4)]
            own = (i + k >= 0) & reduce(lambda a, b: a & b, octets) & reduce(lambda a, b: a & b, [gap(k + n) == "." for n in (1, 2, 3)])
            port = (gap(k + 4) != ".") | (group(k + 4).rlike("^[1-9]") & (F.length(group(k + 4)) <= 5) & (gap(k + 5) != "."))
            before = F.when(i + k > 0, F.coalesce(F.right(F.get(x["s"], F.greatest(i + k, F.lit(0))), F.lit(1)), F.lit("")) != ".").otherwise(
                (F.coalesce(F.get(x["s"], F.lit(0)), F.lit("")) != "") | (x["before"] != ".")
            )
            return own & port & before

        merged = (F.length(group(0)) == area + 1) & one(1)
        three = F.length(group(0)) == area
        apart = (F.get(x["g"], F.greatest(i - 1, F.lit(0))) == X.US_TRUNK) & (i > 0) & three & (
            (one(0) & one(1)) | (gap(0).rlike(rf"^{X.SEP}?\($") & enclosed)
        )
        outer = F.substr(gap(0), F.lit(1), F.length(gap(0)) - 1)
        in_brackets = F.when(
            three & enclosed & F.when(outer == "", first_group(0)).otherwise(F.right(outer, F.lit(1)) != "+"), head(0) - 1
        )
        bare = F.when(
            three & one(1) & F.when(gap(0) == "", ~after_letter).otherwise(end(0) != "+") & ~F.when(i >= 2, quad(-2) | ((i >= 3) & quad(-3))).otherwise(False),
            head(0),
        )
        plain = F.coalesce(in_brackets, bare)
        stop = F.get(x["at"], i + 2) + line

        def made(y):
            value = lambda begin: F.concat(F.substr(x["t"], begin + 1, stop - begin), y["extension"])
            start = F.coalesce(F.when(merged, trunk(0)), F.when(apart, trunk(-1)), y["plain"])
            return F.when((y["extension"] != "") | clean, let(start, lambda start: F.when(start.isNotNull(), F.struct(
                (x["start"] + start).cast("int").alias("start"), value(start).alias("value"),
                (x["start"] + y["plain"]).cast("int").alias("plain"), value(y["plain"]).alias("short"),
            ))))

        return F.when(sizes, let(F.struct(plain.alias("plain"), extension.alias("extension")), made))

    def numbers(hit):
        # The character before the run, with the colons before it: no bracket, as runs take these.
        context = F.substring_index(hit["after"], "(", 1)
        gaps = F.split(hit["value"], rf"{X.DIGIT}++", -1)
        read = let(F.struct(F.split(F.regexp_replace(hit["value"], "^[+()]+", ""), rf"{inside}++").alias("g"), gaps.alias("s")), lambda y: F.struct(
            hit["value"].alias("t"), hit["start"].alias("start"), y["g"].alias("g"), y["s"].alias("s"),
            F.transform(
                running(F.zip_with(y["g"], F.slice(y["s"], F.lit(1), F.size(y["g"])), lambda g, s: F.length(g) + F.length(s))),
                lambda n, k: n + F.length(F.get(y["s"], k)),
            ).alias("at"),
            context.alias("before"),
            F.substr(hit["after"], F.length(context) + 2).alias("after"),
        ))
        return let(read, lambda x: F.filter(
            F.transform(F.sequence(F.lit(0), F.size(x["g"]) - 3), lambda i: at(x, i)), lambda h: h.isNotNull()
        ))

    def apart_from_each_other(all_found):
        """A number begins behind the one before, or without its first digit behind it."""
        begin = F.struct(F.lit(0).alias("end"), F.lit("").alias("taken"))

        def step(acc, h):
            free, rest = h["start"] >= acc["end"], F.coalesce(h["plain"] >= acc["end"], F.lit(False))
            return F.struct(
                F.when(free, h["start"] + F.length(h["value"])).when(rest, h["plain"] + F.length(h["short"])).otherwise(acc["end"]).alias("end"),
                F.concat(acc["taken"], F.when(free, "1").when(rest, "2").otherwise("0")).alias("taken"),
            )

        def picked(x):
            return F.filter(F.transform(x["h"], lambda h, i: let(F.substr(x["taken"], i + 1, F.lit(1)), lambda t: F.when(t != "0", F.struct(
                F.when(t == "1", h["start"]).otherwise(h["plain"]).alias("start"), F.when(t == "1", h["value"]).otherwise(h["short"]).alias("value"),
            )))), lambda h: h.isNotNull())

        return let(all_found, lambda a: let(F.struct(a.alias("h"), F.aggregate(a, begin, step)["taken"].alias("taken")), picked))

    shaped = F.filter(found, lambda h: h["value"].rlike(US_SHAPE))
    return apart_from_each_other(F.flatten(F.transform(shaped, numbers)))


def detect_phone_us(text: Column) -> Column:
    return guard(text.rlike(US_SHAPE), to_spans(_us_numbers(text), "PHONE", R_US))


def is_phone_us(value: Column) -> Column:
    """Whether ``value`` is one North American number."""
    return let(_us_numbers(value), lambda found: (F.size(found) == 1) & (F.get(found, 0)["value"] == value))


def plausible(number: Column) -> Column:
    """8 to 15 digits, a "(0)" trunk prefix not counted."""
    low, high = X.PHONE_DIGITS
    digits = F.length(F.regexp_replace(number, r"[^\p{Nd}]", ""))
    trunks = (F.length(number) - F.length(F.replace(number, F.lit("(0)"), F.lit("")))) / 3
    return (digits - trunks).between(low, high)


def _intl_value(hit: Column) -> Column:
    number, after = hit["value"], hit["after"]
    extension = F.regexp_extract(after, rf"^({X.EXTENSION}(?<={X.DIGIT})(?!{X.DIGIT}))(?!{X.NOT_CLEAN})", 1)
    before_word = F.regexp_extract(number, rf"^(.+)[{X.SPACES}]({X.DIGIT}{{1,2}})$", 1)

    def cut():
        ends = F.filter(
            F.sequence(F.length(number), F.lit(1), F.lit(-1)),
            lambda n: (
                (n == F.length(number))
                | (
                    F.substr(number, n + 1, F.lit(1)).rlike(rf"[{X.SEP_CHARS}(]")
                    & ~F.substr(number, n, F.lit(1)).rlike(X.SEP)
                )
            )
            & plausible(F.substr(number, F.lit(1), n)),
        )
        return F.substr(number, F.lit(1), first(ends))

    return F.coalesce(
        F.when(plausible(number), F.when(extension != "", F.concat(number, extension)).when(~after.rlike(f"^{X.NOT_CLEAN}"), number)),
        F.when(after.rlike(f"^{X.GLUE}"), let(before_word, lambda word: F.when((word != "") & plausible(word), word))),
        cut(),
    )


def detect_phone_intl(text: Column) -> Column:
    raw = hits(text, f"({X.PHONE_INTL}){CONTEXT}", f"{MARK}$1{AFTER}$2{MARK}")
    kept = F.filter(
        F.transform(
            raw,
            lambda h: F.struct(h["start"].alias("start"), _intl_value(h).alias("value"), h["after"].alias("after")),
        ),
        lambda h: h["value"].isNotNull(),
    )
    return guard(text.rlike(r"\+[1-9]"), to_spans(kept, "PHONE", R_INTL))


def shrink_phones(spans: Column) -> Column:
    """End an international number before a later span that outlasts it."""
    return let(spans, _shrink_phones)


def _shrink_phones(found: Column) -> Column:
    def cut(s):
        runs_into = first(
            F.array_sort(
                F.transform(
                    F.filter(
                        found,
                        lambda o: (o["start"] > s["start"])
                        & (o["start"] < s["end"])
                        & (o["end"] > s["end"]),
                    ),
                    lambda o: F.struct(o["start"].alias("at"), o["rule"].alias("rule")),
                )
            )
        )["at"]
        head = F.substr(s["value"], F.lit(1), runs_into - s["start"])
        kept = F.regexp_replace(head, f"{X.SEP}+$", "")
        shorter = (F.length(kept) < F.length(head)) & plausible(kept)
        value = F.when(shorter, kept).otherwise(s["value"])
        return span(s["start"], value, "PHONE", "regex", X.BUILTIN, R_INTL)

    return F.when(
        F.exists(found, lambda s: s["rule"] == R_INTL) & (F.size(found) > 1),
        F.transform(found, lambda s: F.when(s["rule"] == R_INTL, cut(s)).otherwise(s)),
    ).otherwise(found)


def _octet(part: Column) -> Column:
    """Up to three ASCII digits, no needless zero in front, at most 255."""
    return part.rlike("^(?:0|[1-9][0-9]{0,2})$") & (part.try_cast("int") <= 255)


def detect_ipv4(text: Column) -> Column:
    """Runs of letters and digits joined by points are read as a whole.

    Four parts in a row that are octets are an address, if the part before
    does not end, and the part after does not begin, with a digit.
    """
    run = r"[A-Za-z\p{Nd}]++(?:\.[A-Za-z\p{Nd}]++){3,}+"

    def addresses(hit: Column) -> Column:
        def at(x, i):
            four = F.slice(x["p"], i + 1, 4)
            inside = (i + 4 < F.size(x["p"])) & F.coalesce(F.get(x["p"], i + 4).rlike(r"^\p{Nd}"), F.lit(False))
            after = (i > 0) & F.coalesce(F.get(x["p"], i - 1).rlike(r"\p{Nd}$"), F.lit(False))
            good = ~inside & ~after & F.forall(four, _octet)
            return F.when(good, F.struct((hit["start"] + F.get(x["at"], i)).cast("int").alias("start"), F.array_join(four, ".").alias("value")))

        parts = F.split(hit["value"], r"\.")
        return let(
            let(parts, lambda p: F.struct(p.alias("p"), running(F.transform(p, lambda v: F.length(v) + 1)).alias("at"))),
            lambda x: F.filter(
                F.transform(F.sequence(F.lit(0), F.size(x["p"]) - 4), lambda i: at(x, i)), lambda h: h.isNotNull()
            ),
        )

    found = F.flatten(F.transform(hits(text, run), addresses))
    return guard(text.rlike(r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}"), to_spans(found, "IPV4", R_IPV4))


def is_ipv6(c: Column) -> Column:
    """Whether ``c`` is one valid IPv6 address, IPv4 tail included."""
    h = "[0-9A-Fa-f]{1,4}"
    quad = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?:{h}|{quad})"
    full = rf"^(?:{h}:){{6}}(?:{h}:{h}|{quad})$"
    short = rf"^(?:{h}(?::{h}){{0,6}})?::(?:(?:{h}:){{0,6}}{tail})?$"
    groups = F.size(F.filter(F.split(c, ":"), lambda g: g != "")) + F.when(
        F.contains(c, F.lit(".")), 1
    ).otherwise(0)
    return c.rlike(full) | (c.rlike(short) & (groups <= 7))


def _ipv6_value(run: Column, after: Column) -> Column:
    """The address at the start of a colon run, or null.

    Candidates in order: the run, the run less trailing punctuation one
    character at a time, the run less a port.
    """
    trailing = F.length(run) - F.length(F.regexp_replace(run, "[.:]+$", ""))
    candidates = F.concat(
        F.transform(
            F.sequence(F.lit(0), trailing),
            lambda n: F.substr(run, F.lit(1), F.length(run) - n),
        ),
        F.when(
            run.rlike(r"[.:][0-9]{1,5}[.:]*$"),
            F.array(F.regexp_replace(run, r"[.:][0-9]{1,5}[.:]*$", "")),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    )

    def judge(value):
        nxt = F.substr(F.concat(run, after), F.length(value) + 1, F.lit(1))
        groups = F.filter(F.split(value, ":"), lambda g: g != "")
        return F.when(
            ~nxt.rlike(f"^{X.GLUE}")
            & value.rlike("[0-9]")
            & ((F.size(groups) >= 3) | F.exists(groups, lambda g: F.length(g) == 4)),
            value,
        )

    valid = first(F.filter(candidates, is_ipv6))
    colons = F.length(run) - F.length(F.replace(run, F.lit(":"), F.lit("")))
    return F.when(colons >= 2, let(valid, judge))


def detect_ipv6(text: Column) -> Column:
    def refine(found, value, after, shift=F.lit(0)):
        return F.transform(
            found,
            lambda h: F.struct(
                (h["start"] + shift).alias("start"),
                _ipv6_value(value(h), after(h)).alias("value"),
                h["after"].alias("after"),
            ),
        )

    plain = refine(
        hits(text, f"({X.IPV6_RUN}){CONTEXT}", f"{MARK}$1{AFTER}$2{MARK}"),
        lambda h: h["value"],
        lambda h: h["after"],
    )
    # After a label the run is only looked at: it is not consumed.
    run_and_after = rf"{X.IPV6_LABEL}(?=[0-9A-Fa-f:.]{{3,}}+((?s:.{{0,1}})))"
    labelled = F.transform(
        hits(text, run_and_after, f"{MARK}$1{AFTER}$2 $3{MARK}"),
        lambda h: F.struct(
            (h["start"] + F.length(h["value"])).alias("start"),
            _ipv6_value(
                F.substring_index(h["after"], " ", 1),
                F.substr(h["after"], F.length(F.substring_index(h["after"], " ", 1)) + 2, F.lit(1)),
            ).alias("value"),
            h["after"].alias("after"),
        ),
    )
    return guard(
        text.rlike(r":[0-9A-Fa-f]{0,4}:"),
        F.concat(to_spans(plain, "IPV6", R_IPV6), to_spans(labelled, "IPV6", R_IPV6)),
    )


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def of_network(digits: Column) -> Column:
    """Whether a network gives out numbers of this length that begin so."""
    def one(low, high, lengths):
        head = F.substr(digits, F.lit(1), F.lit(len(low)))
        return F.length(digits).isin(*lengths) & (head >= low) & (head <= high)

    return reduce(lambda a, b: a | b, [one(*row) for row in X.CARD_NETWORKS])


def detect_card(text: Column) -> Column:
    """Runs of digit groups, each joined to the next by one separator, are read group by group.

    At each group the longest printed layout that fits, with one kind of
    separator, and gives a network's number, counts.
    """
    # Not from inside a word, nor from behind a decimal point.
    run = rf"(?<![A-Za-z0-9])(?<![0-9][.,])[0-9]++(?:{X.CARD_SEP}[0-9]++)*+"

    def cards(hit: Column) -> Column:
        body = hit["value"]

        def at(x, i):
            def layout(sizes, last):
                n = len(sizes) + 1
                sizes_fit = F.lit(True)
                for k, size in enumerate(sizes):
                    sizes_fit = sizes_fit & (F.length(F.get(x["g"], i + k)) == size)
                own = F.slice(x["g"], i + 1, n)
                digits = F.array_join(own, "")
                # The number ends where its last group ends, and no letter or digit follows.
                free = (i + n < F.size(x["g"])) | ~F.coalesce(hit["after"], F.lit("")).rlike(f"^{X.GLUE}")
                good = (
                    (i + n <= F.size(x["g"])) & sizes_fit & F.length(F.get(x["g"], i + n - 1)).between(*last) & free
                    & (F.size(F.array_distinct(F.slice(x["s"], i + 1, n - 1))) <= 1 if n > 1 else F.lit(True))
                )
                length = F.length(digits) + n - 1
                return F.when(good & of_network(digits) & luhn(F.when(good, digits)), F.substr(x["t"], F.get(x["at"], i) + 1, length))

            value = F.coalesce(*[layout(*row) for row in X.CARD_LAYOUTS])
            return F.struct((hit["start"] + F.get(x["at"], i)).cast("int").alias("start"), value.alias("value"))

        groups = let(F.split(body, X.CARD_SEP), lambda g: F.struct(
            body.alias("t"), g.alias("g"), F.regexp_extract_all(body, F.lit(f"({X.CARD_SEP})"), F.lit(1)).alias("s"),
            running(F.transform(g, lambda v: F.length(v) + 1)).alias("at"),
        ))
        return let(groups, lambda x: F.filter(
            F.transform(F.sequence(F.lit(0), F.size(x["g"]) - 1), lambda i: at(x, i)), lambda h: h["value"].isNotNull()
        ))

    found = hits(text, f"({run}){CONTEXT}", f"{MARK}$1{AFTER}$2{MARK}")
    # A layout's groups at their sizes; of the last one, the digits it has at least.
    shapes = [X.CARD_SEP.join(f"[0-9]{{{n}}}" for n in (*sizes, last[0])) for sizes, last in X.CARD_LAYOUTS]
    return guard(
        text.rlike(f"(?<![0-9])(?:{'|'.join(shapes)})"),
        to_spans(F.flatten(F.transform(found, cards)), "CREDIT_CARD", R_CARD),
    )


def mod97(compact: Column) -> Column:
    """Remainder of an IBAN read as a number, its first four characters last."""
    upper = F.upper(compact)
    turned = F.concat(F.substr(upper, F.lit(5)), F.substr(upper, F.lit(1), F.lit(4)))
    # Each letter is worth ten more than its place in the alphabet: A is 10.
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )


def detect_iban(text: Column) -> Column:
    """From a country's code and two digits on: one word, or words of four and a last one of at most four."""
    starts = rf"(?<![A-Za-z0-9])(?=(?i:{'|'.join(X.IBAN_COUNTRIES)})[0-9]{{2}}[A-Za-z0-9{X.GROUP_SPACE[1:-1]}])"
    words = f"^([A-Za-z0-9]+(?:{X.GROUP_SPACE}[A-Za-z0-9]+)*)"

    def at(p):
        tail = F.substr(text, p + 1, F.lit(60))

        def pick(x):
            g = x["g"]
            odd = F.coalesce(F.array_position(F.transform(g, lambda w: F.length(w) == 4), F.lit(False)), F.lit(0)).cast("int")
            fours = F.when(odd == 0, F.size(g)).otherwise(odd - 1)
            # A shorter word may end the number; a longer one is not of it.
            most = fours + F.when((odd > 1) & (F.length(F.get(g, fours)) < 4), 1).otherwise(0)
            most = F.when(F.length(F.get(g, F.lit(0))) > 4, 1).otherwise(most)

            def good(n):
                compact = F.array_join(F.slice(g, F.lit(1), n), "")
                size = F.length(compact) + n - 1
                free = (n < F.size(g)) | ~F.substr(tail, size + 1, F.lit(1)).rlike(f"^{X.GLUE}")
                fits = F.length(compact).between(15, 34) & F.substr(compact, F.lit(3), F.lit(2)).cast("int").between(2, 98) & free
                return F.when(F.when(fits, mod97(compact) == 1), F.substr(tail, F.lit(1), size))

            options = F.transform(F.sequence(F.least(most, F.lit(9)), F.lit(1), F.lit(-1)), good)
            return F.when(most > 0, first(F.filter(options, lambda v: v.isNotNull())))

        run = F.regexp_extract(tail, words, 1)
        return let(F.struct(F.split(run, X.GROUP_SPACE).alias("g")), pick)

    found = F.transform(
        marks(text, starts),
        lambda p: F.struct(p.alias("start"), at(p).alias("value")),
    )
    return guard(
        text.rlike("[A-Za-z]{2}[0-9]{2}[A-Za-z0-9   　 ]"),
        to_spans(F.filter(found, lambda h: h["value"].isNotNull()), "IBAN", R_IBAN),
    )


def issued(area: Column, group: Column, serial: Column) -> Column:
    """Whether the parts of a social security number can have been given out."""
    return (
        (F.length(area) == 3) & (F.length(group) == 2) & (F.length(serial) == 4)
        & ~area.isin(*X.SSN_AREAS_UNUSED) & ~area.startswith(X.SSN_AREA_UNUSED_FIRST)
        & (group != X.SSN_GROUP_UNUSED) & (serial != X.SSN_SERIAL_UNUSED)
    )


def detect_ssn(text: Column) -> Column:
    """A run of digits joined by dashes or points is read as a whole: three parts, one kind of dash."""
    joint = f"[.{X.DASHES}]"
    run = rf"(?<![A-Za-z\p{{M}}+])(?<!{X.DIGIT}|{X.DIGIT}{joint}){X.DIGIT}++(?:{joint}{X.DIGIT}++)*+(?![A-Za-z\p{{M}}])"

    def good(value: Column) -> Column:
        parts = F.split(value, f"[{X.DASHES}]")
        marks = F.array_distinct(F.regexp_extract_all(value, F.lit(f"([{X.DASHES}])"), F.lit(1)))
        three = (F.size(parts) == 3) & (F.size(marks) == 1) & value.rlike(f"^[0-9{X.DASHES}]+$")
        return three & issued(F.get(parts, 0), F.get(parts, 1), F.get(parts, 2))

    return guard(
        text.rlike(f"[0-9]{{3}}[{X.DASHES}][0-9]{{2}}[{X.DASHES}][0-9]{{4}}"),
        to_spans(F.filter(hits(text, run), lambda h: good(h["value"])), "SSN", R_SSN),
    )


def detect_ssn_labelled(text: Column) -> Column:
    """Nine digits after a label, together or as three parts with one kind of space."""
    labels = "|".join(label.replace(" ", r"[ \t]+") for label in X.SSN_LABELS)
    label = rf"(?<!{X.WORD}|\p{{M}})(?i:{labels})(?!{X.WORD})[ \t]*+(?:[:=#][ \t]*+)?"
    number = rf"[0-9]{{9}}|[0-9]{{3}}([{X.SPACES}])[0-9]{{2}}\3[0-9]{{4}}"
    follows = rf"(?![A-Za-z\p{{M}}{X.DIGIT}]|{X.DASH_DOT}{X.DIGIT})"

    def good(value: Column) -> Column:
        return let(F.regexp_replace(value, "[^0-9]", ""), lambda n: issued(
            F.substr(n, F.lit(1), F.lit(3)), F.substr(n, F.lit(4), F.lit(2)), F.substr(n, F.lit(6))
        ))

    found = hits(text, f"({label})({number}){follows}", f"$1{MARK}$2{MARK}")
    return guard(text.rlike(r"(?i)ssn|social[ \t]+security"), to_spans(F.filter(found, lambda h: good(h["value"])), "SSN", R_SSN2))


RULES = {
    "EMAIL": (detect_email,),
    "PHONE": (detect_phone_us, detect_phone_intl),
    "IPV4": (detect_ipv4,),
    "IPV6": (detect_ipv6,),
    "CREDIT_CARD": (detect_card,),
    "IBAN": (detect_iban,),
    "SSN": (detect_ssn, detect_ssn_labelled),
}


def detect_custom(text: Column, patterns: dict[str, str]) -> list[Column]:
    """User patterns: the whole match is the span; empty matches are ignored."""
    return [
        to_spans(hits(text, regex), kind, R_CUSTOM + i, priority=X.CUSTOM)
        for i, (kind, regex) in enumerate(patterns.items())
    ]


def detect_literal(text: Column, types: Column | None = None) -> Column:
    """Text shaped like a placeholder of a type in use (null: of any type)."""
    found = hits(text, X.EXACT)
    if types is not None:
        kind = lambda h: F.regexp_extract(h["value"], X.PLACEHOLDER, 1)
        found = F.filter(
            found, lambda h: F.array_contains(types, kind(h)) | (kind(h) == X.LITERAL)
        )
    return guard(
        F.contains(text, F.lit("[")),
        to_spans(found, X.LITERAL, 0, source="literal", priority=X.LITERAL_PRIORITY),
    )


def dedupe(spans: Column) -> Column:
    """One span per start, end and type: the first rule wins."""
    return let(spans, _dedupe)


def _dedupe(found: Column) -> Column:
    rank = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("a"), (-s["end"]).alias("b"), s["entity_type"].alias("c"),
            s["rule"].alias("d"), s.alias("s"),
        ),
    )

    def new(ranked):
        kept = F.filter(
            ranked,
            lambda k, i: let(
                F.get(ranked, i - 1),
                lambda p: p.isNull() | (p["a"] != k["a"]) | (p["b"] != k["b"]) | (p["c"] != k["c"]),
            ),
        )
        return F.transform(kept, lambda k: k["s"])

    return F.when(F.size(found) > 1, let(F.array_sort(rank), new)).otherwise(found)
