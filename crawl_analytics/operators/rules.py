"""Filter-list rules as a table: one row per network rule, with its index keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Option names of the public filter syntax and the request type each stands for.
TYPE_OPTIONS = {
    "script": "script",
    "image": "image",
    "stylesheet": "stylesheet",
    "css": "stylesheet",
    "xmlhttprequest": "xmlhttprequest",
    "xhr": "xmlhttprequest",
    "subdocument": "subdocument",
    "frame": "subdocument",
    "document": "document",
    "doc": "document",
    "object": "object",
    "object-subrequest": "object",
    "media": "media",
    "font": "font",
    "websocket": "websocket",
    "ping": "ping",
    "beacon": "ping",
    "popup": "popup",
    "other": "other",
}
# Resource types as browsers name them and the request type each stands for.
BROWSER_TYPES = {
    "document": "document",
    "script": "script",
    "image": "image",
    "stylesheet": "stylesheet",
    "xhr": "xmlhttprequest",
    "fetch": "xmlhttprequest",
    "xmlhttprequest": "xmlhttprequest",
    "subdocument": "subdocument",
    "object": "object",
    "media": "media",
    "font": "font",
    "websocket": "websocket",
    "ping": "ping",
    "beacon": "ping",
}
# Options that are understood besides types.
PARTY_OPTIONS = {"third-party": True, "3p": True, "~third-party": False, "first-party": False, "1p": False}
PLAIN_OPTIONS = ["important", "match-case"]
# words found in most URLs: poor index keys
COMMON_WORDS = ["http", "https", "www", "com", "net", "org", "js", "html", "php", "css", "img", "images", "static"]

_ELEMENT_RULE = r"#@?[?$%]?#"
_OPTIONS = r"\$(~?[a-zA-Z0-9_-]+(?:=[^,\s]*)?(?:,~?[a-zA-Z0-9_-]+(?:=[^,\s]*)?)*)$"
_HOST_RULE = r"^\|\|([a-z0-9_-]+(?:\.[a-z0-9_-]+)+)(?=[\^/:?])"
_WORD = r"(?<![a-z0-9%*])[a-z0-9%]{2,}(?![a-z0-9%*])"
_SEPARATOR = r"(?:[^a-zA-Z0-9_.%-]|$)"
_AFTER_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?"


def _compiles(pattern: Column) -> Column:
    """Whether the JVM takes the text as a regular expression."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def _text(value: str | bool) -> str:
    return str(value).lower() if isinstance(value, bool) else f"'{value}'"


def _mapped(values: dict, key: Column) -> Column:
    """Look a key up in a fixed table; written as SQL text, which is one call instead of one per entry."""
    pairs = ", ".join(f"{_text(k)}, {_text(v)}" for k, v in values.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def _one_of(values: list[str], key: Column) -> Column:
    return F.array_contains(F.expr(f"array({', '.join(map(_text, values))})"), key)


def request_type(resource_type: Column) -> Column:
    """Request type of a browser's resource type; empty and unknown names are ``other``."""
    return F.coalesce(_mapped(BROWSER_TYPES, resource_type), F.lit("other"))


def _option_columns(options: Column) -> dict[str, Column]:
    bare = F.transform(options, lambda o: F.regexp_replace(o, "^~", ""))
    types = list(TYPE_OPTIONS)
    known = [*types, *PARTY_OPTIONS, "first-party", "1p", "3p", "third-party", *PLAIN_OPTIONS]
    named = F.filter(options, lambda o: _one_of(types, o))
    negated = F.filter(options, lambda o: _one_of([f"~{t}" for t in types], o))
    domain_list = F.try_element_at(F.filter(options, lambda o: F.startswith(o, F.lit("domain="))), F.lit(1))
    domains = F.split(F.lower(F.substr(domain_list, F.lit(8))), r"\|")
    party = F.filter(options, lambda o: _one_of([*PARTY_OPTIONS, "~3p", "~first-party", "~1p"], o))

    def some(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    return {
        "usable": F.forall(bare, lambda o: _one_of(known, o) | F.startswith(o, F.lit("domain="))),
        "types_in": some(F.array_distinct(F.transform(named, lambda o: _mapped(TYPE_OPTIONS, o)))),
        "types_out": some(F.transform(negated, lambda o: _mapped(TYPE_OPTIONS, F.regexp_replace(o, "^~", "")))),
        "third_party": _mapped({**PARTY_OPTIONS, "~3p": False, "~first-party": True, "~1p": True}, F.try_element_at(party, F.lit(1))),
        "domains_in": some(F.filter(domains, lambda d: (d != "") & ~F.startswith(d, F.lit("~")))),
        "domains_out": some(
            F.transform(F.filter(domains, lambda d: F.startswith(d, F.lit("~"))), lambda d: F.substr(d, F.lit(2)))
        ),
        "is_important": F.array_contains(options, "important"),
        "match_case": F.array_contains(options, "match-case"),
    }


def _translate(pattern: Column) -> Column:
    """Filter pattern to a regular expression: ``*``, ``^``, ``|`` and ``||`` have a meaning."""
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\*{2,}", "*"), r"^\*|\*$", "")
    escaped = F.regexp_replace(body, r"([\\.+?${}()|\[\]])", r"\\$1")
    wild = F.replace(escaped, F.lit("*"), F.lit(".*"))
    parts = F.replace(wild, F.lit("^"), F.lit(_SEPARATOR))
    start = F.when(pattern.startswith("||"), F.lit(_AFTER_HOST)).when(pattern.startswith("|"), F.lit("^")).otherwise(F.lit(""))
    end = F.when(F.endswith(pattern, F.lit("|")) & (F.length(pattern) > 1), F.lit("$")).otherwise(F.lit(""))
    return F.concat(start, parts, end)


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rule table of (list_ord, list_name, line): comments, element rules and unusable rules drop out.

    Every rule gets index keys, at least one of which each matching URL has too: its
    full host, its rarest whole word among all rules, source domains (``s:``), its longest piece of text without a wildcard
    (``g:``), request types (``t:``) or ``*`` for anything; ``key_kind`` says which. A rule for several source
    domains has a key for each in ``keys``; the rule itself stands once, under ``rule_id``. Patterns without wildcards are kept as
    plain text with their anchors, others as a regular expression.
    """
    raw = F.trim(F.col("line"))
    network = lines.withColumn("raw", raw).filter(
        (F.col("raw") != "") & ~F.col("raw").rlike(r"^[!\[]") & ~F.col("raw").rlike(_ELEMENT_RULE)
    )
    cut = network.select(
        "list_ord",
        "list_name",
        "raw",
        F.startswith("raw", F.lit("@@")).alias("is_exception"),
        F.regexp_replace("raw", "^@@", "").alias("body"),
    ).withColumn("option_text", F.regexp_extract("body", _OPTIONS, 1))
    options = F.when(F.col("option_text") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split("option_text", ","), lambda o: F.when(F.startswith(o, F.lit("domain=")), o).otherwise(F.lower(o)))
    )
    split = cut.withColumn("options", options).withColumn(
        "pattern",
        F.when(F.col("option_text") == "", F.col("body")).otherwise(
            F.expr("substring(body, 1, length(body) - length(option_text) - 1)")
        ),
    )
    split = split.select(
        "list_ord", "list_name", "raw", "is_exception", "pattern", *[c.alias(n) for n, c in _option_columns(F.col("options")).items()]
    )

    is_regex = F.col("pattern").rlike(r"^/.+/$")
    typed = split.withColumn("is_regex", is_regex).withColumn(
        "pattern", F.when(F.col("is_regex") | F.col("match_case"), F.col("pattern")).otherwise(F.lower("pattern"))
    )
    low = F.lower("pattern")
    # an open end may go on inside a word, so the word there is not whole
    open_ends = F.concat(
        F.when(low.startswith("|"), F.lit("")).otherwise(F.lit("*")),
        F.regexp_replace(low, r"^\|\|?|\|$", "."),
        F.when(F.endswith(low, F.lit("|")), F.lit("")).otherwise(F.lit("*")),
    )
    words = F.array_distinct(F.regexp_extract_all(open_ends, F.lit(_WORD), F.lit(0)))
    literals = F.split(F.regexp_replace(low, r"^\|\|?|\|$", ""), r"[*^|]")
    longest_literal = F.try_element_at(
        F.array_sort(F.transform(literals, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1)
    )["w"]
    bare = F.regexp_replace(F.col("pattern"), r"^\||\|$", "")
    pure_host = F.col("pattern") == F.concat(F.lit("||"), F.col("host"), F.lit("^"))
    inner = F.expr("substring(pattern, 2, length(pattern) - 2)")
    read = (
        typed.withColumn("host", F.when(~F.col("is_regex"), F.regexp_extract(low, _HOST_RULE, 1)).otherwise(F.lit("")))
        .withColumn("words", F.when(F.col("is_regex") | (F.col("host") != ""), F.array().cast("array<string>")).otherwise(words))
        .withColumn("literal", F.when(~F.col("is_regex"), longest_literal))
        .withColumn("plain", F.when(~F.col("is_regex") & ~F.startswith("pattern", F.lit("||")) & ~bare.rlike(r"[*^]"), bare))
        .withColumn("at_start", F.startswith("pattern", F.lit("|")))
        .withColumn("at_end", F.endswith("pattern", F.lit("|")))
        .withColumn(
            "regex",
            F.when(F.col("is_regex"), F.when(F.col("match_case"), inner).otherwise(F.concat(F.lit("(?i)"), inner))).when(
                F.col("plain").isNull() & ~((F.col("host") != "") & pure_host), _translate(F.col("pattern"))
            ),
        )
    )
    columns = [
        "list_ord", "list_name", "raw", "regex", "plain", "at_start", "at_end", "match_case",
        "is_exception", "is_important", "types_in", "types_out", "third_party", "domains_in", "domains_out",
    ]
    # A rule that cannot be used is marked, not filtered: the filter would be pushed
    # down and evaluate all of the above a second time.
    usable = F.col("usable") & (~F.col("is_regex") | _compiles(F.coalesce("regex", F.lit(""))))
    table = read.select(*columns, "host", "words", "literal", usable.alias("usable")).distinct()
    rarest = _rarest_words(table)
    keyed = table.join(rarest, ["list_ord", "list_name", "raw"], "left")
    kind = (
        F.when(F.col("host") != "", F.lit("host"))
        .when(F.col("word").isNotNull(), F.lit("word"))
        .when(F.col("domains_in").isNotNull(), F.lit("source"))
        .when(F.length("literal") > 0, F.lit("text"))
        .when(F.col("types_in").isNotNull(), F.lit("type"))
        .otherwise(F.lit("any"))
    )
    keys = (
        F.when(F.col("key_kind") == "host", F.array("host"))
        .when(F.col("key_kind") == "word", F.array("word"))
        .when(F.col("key_kind") == "source", F.array_distinct(F.transform("domains_in", lambda d: F.concat(F.lit("s:"), d))))
        .when(F.col("key_kind") == "text", F.array(F.concat(F.lit("g:"), F.col("literal"))))
        .when(F.col("key_kind") == "type", F.transform("types_in", lambda t: F.concat(F.lit("t:"), t)))
        .otherwise(F.array(F.lit("*")))
    )
    ready = keyed.withColumn("key_kind", kind)
    marked = ready.select(F.xxhash64("list_ord", "list_name", "raw").alias("rule_id"), *columns, "key_kind", F.when(F.col("usable"), keys).alias("keys"))
    return marked.filter("keys IS NOT NULL")


def _rarest_words(table: DataFrame) -> DataFrame:
    """The word of each rule that the fewest rules have; words found in most URLs come last."""
    rule = ["list_ord", "list_name", "raw"]
    each = table.select(*rule, F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("word").isin(COMMON_WORDS), F.col("n"), -F.length("word"), F.col("word"))
    return each.join(counts, "word").groupBy(*rule).agg(F.min_by("word", order).alias("word"))
