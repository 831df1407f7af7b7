"""URL parts, normalisation and resolution as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DOMAIN_PATTERN
from .hosts import canonical_host

# scheme, authority, path, query (with ?), fragment (with #); the scheme is optional
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HTTP = r"(?i)^https?:"
_HOST = r"(?:\[[^\]]*\]|[^:@]*)"
# characters a browser leaves alone in a path, query or fragment
_PLAIN = r"[!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z|~{}]"


def domain(url: Column) -> Column:
    """Host without scheme, user info, ``www.`` and port; '' when nothing matches."""
    return F.regexp_extract(url, DOMAIN_PATTERN, 1)


def tld(host: Column) -> Column:
    """Last dot-separated part, lower-case."""
    return F.lower(F.split_part(host, F.lit("."), F.lit(-1)))


def base_url(url: Column) -> Column:
    """URL up to the first question mark."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def host(url: Column) -> Column:
    """Lower-case host name of an absolute URL, without user info and port."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def host_suffixes(name: Column) -> Column:
    """``a.b.c`` gives [a.b.c, b.c, c]; '' gives []."""
    return F.regexp_extract_all(name, F.lit(r"(?:^|(?<=\.))(?=(.+))"), F.lit(1))


def normalize_url(text: Column) -> Column:
    """Seed normalisation: https by default, lower-case scheme and host, no default port, root path.

    Hosts get their canonical form (Punycode, plain addresses; one that can be none stays as it is). Scope: http(s) URLs;
    path, query and fragment are kept as they are.
    """
    clean = F.trim(text)
    has_scheme = clean.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    full = F.when(has_scheme, clean).otherwise(F.concat(F.lit("https://"), F.regexp_replace(clean, "^//", "")))
    scheme = F.lower(F.regexp_extract(full, _SPLIT, 1))
    authority = _authority(scheme, F.regexp_extract(full, _SPLIT, 2))
    user, name = F.regexp_extract(authority, r"^(.*@)", 1), F.regexp_extract(authority, rf"^(?:.*@)?({_HOST})", 1)
    authority = F.concat(user, F.coalesce(canonical_host(name), name), F.regexp_extract(authority, rf"^(?:.*@)?{_HOST}(.*)$", 1))
    path = F.regexp_extract(full, _SPLIT, 3)
    rest = F.concat(F.regexp_extract(full, _SPLIT, 4), F.regexp_extract(full, _SPLIT, 5))
    url = F.concat(scheme, F.lit("://"), authority, F.when(path == "", F.lit("/")).otherwise(path), rest)
    return F.when(clean == "", F.lit(None)).otherwise(url)


def _authority(scheme: Column, authority: Column) -> Column:
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    place = F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))
    port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    place = F.when(F.endswith(place, port), F.regexp_replace(place, r":\d+$", "")).otherwise(place)
    return F.concat(user, F.regexp_replace(place, ":$", ""))


def percent_encode(text: Column) -> Column:
    """Encode what a browser encodes in a link: spaces, quotes, angle brackets, controls, non-ASCII."""
    pieces = F.regexp_extract_all(text, F.lit(f"{_PLAIN}+|(?s:.)"), F.lit(0))
    encoded = F.transform(
        pieces,
        lambda p: F.when(p.rlike(f"^{_PLAIN}+$"), p)
        .when(p == " ", F.lit("%20"))
        .otherwise(F.url_encode(p)),
    )
    return F.when(text.rlike(f"^{_PLAIN}*$"), text).otherwise(F.array_join(encoded, ""))


def _no_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(F.concat(joined, tail), "^//$", "/")).otherwise(path)


def base_parts(base: Column) -> Column:
    """What relative links are resolved against, as a struct."""
    scheme = F.lower(F.regexp_extract(base, _SPLIT, 1))
    authority = F.regexp_extract(base, _SPLIT, 2)
    path = F.regexp_extract(base, _SPLIT, 3)
    origin = F.concat(scheme, F.lit("://"), authority)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return F.struct(
        scheme.alias("scheme"),
        origin.alias("origin"),
        F.concat(origin, folder).alias("folder"),
        F.concat(origin, path).alias("page"),
        F.concat(origin, path, F.regexp_extract(base, _SPLIT, 4)).alias("full"),
    )


def resolve_links(base: Column, hrefs: Column) -> Column:
    """Absolute http(s) URLs of an array of hrefs, as a browser reports them; others drop out.

    ``base`` is a column of ``base_parts``. Every stage is one array transform, so
    no expression is evaluated twice.
    """

    def absolute(href: Column) -> Column:
        return (
            F.when(href.rlike(_HTTP), F.when(href.rlike(r"(?i)^https?:[/\\]{2}"), href))
            .when(href.rlike(_SCHEME), F.lit(None))
            .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(base["origin"], href))
            .when(href.startswith("?"), F.concat(base["page"], href))
            .when(href.startswith("#") | (href == ""), F.concat(base["full"], href))
            .otherwise(F.concat(base["folder"], href))
        )

    def parts(url: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(url, _SPLIT, 1)).alias("scheme"),
            F.regexp_extract(url, _SPLIT, 2).alias("authority"),
            F.regexp_extract(url, _SPLIT, 3).alias("path"),
            F.concat(F.regexp_extract(url, _SPLIT, 4), F.regexp_extract(url, _SPLIT, 5)).alias("rest"),
        )

    def clean_path(p: Column) -> Column:
        return F.struct(
            p["scheme"].alias("scheme"),
            _authority(p["scheme"], p["authority"]).alias("authority"),
            F.when(p["path"] == "", F.lit("/")).otherwise(_no_dots(p["path"])).alias("path"),
            p["rest"].alias("rest"),
        )

    def text(p: Column) -> Column:
        return F.concat(p["scheme"], F.lit("://"), p["authority"], percent_encode(F.concat(p["path"], p["rest"])))

    clean = F.transform(hrefs, lambda h: F.regexp_replace(F.regexp_replace(h, r"[\t\r\n]", ""), r"^ +| +$", ""))
    urls = F.filter(F.transform(clean, absolute), lambda u: u.isNotNull())
    return F.transform(F.transform(F.transform(urls, parts), clean_path), text)
