"""URL columns by regular expression; Spark's own URL functions refuse addresses that occur in links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.rules import FORM_ADDRESS, NO_ADDRESS, NO_DOMAIN, NO_FORMAT, NOT_VALID, SITE_DOMAIN, SKIPPED_SUFFIXES
from pagequarry.functions.text import strip

# scheme, authority, path, query, fragment
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column | str, n: int) -> Column:
    return F.regexp_extract(strip(url), PARTS, n)


def path(url: Column | str) -> Column:
    return part(url, 3)


def normalize(url: Column | str) -> Column:
    """Scheme and host in lower case, no fragment; null without a host or another scheme than http(s)."""
    scheme, host = F.lower(part(url, 1)), part(url, 2)
    whole = F.concat(scheme, F.lit("://"), F.lower(host), part(url, 3), F.when(F.length(part(url, 4)) > 1, part(url, 4)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def crawlable(url: Column | str, host: Column | str) -> Column:
    """Whether a link stays on ``host`` (compared with case), is http(s), and is no file of a skipped type."""
    suffix = F.lower(path(url)).rlike(rf"\.(?:{'|'.join(SKIPPED_SUFFIXES)})$")
    return (part(url, 2) == (F.col(host) if isinstance(host, str) else host)) & F.lower(part(url, 1)).isin("http", "https") & ~suffix


def resolve(base: Column | str, href: Column | str) -> Column:
    """An absolute address for a link: absolute, scheme-relative, root-relative, or beside the base's path."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.rlike(href, F.lit("^[?#]")) | (href == ""), F.concat(root, path(base), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def unquoted(text: Column) -> Column:
    """Percent-encoded bytes as UTF-8; a percent sign without two hexadecimal digits, and a plus, stay."""
    sound = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(sound), text)).otherwise(text)


def quoted(text: Column) -> Column:
    """UTF-8 bytes percent-encoded, but for ASCII letters and digits and ``_.-~/``."""
    out = F.url_encode(text)
    for mark, is_ in ((r"\+", "%20"), ("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")):
        out = F.regexp_replace(out, mark, is_)
    return F.when(text.rlike(r"[^A-Za-z0-9_.\-~/]"), out).otherwise(text)


def robots_path(url: Column | str) -> Column:
    """What a robots rule is held against: the address's path, query and fragment, unquoted and quoted again; ``/`` if there is nothing."""
    whole = F.regexp_replace(unquoted(F.col(url) if isinstance(url, str) else url), r"[\t\r\n]", "")
    filled = lambda x: F.when(F.length(x) > 1, x).otherwise("")
    rest = F.concat(part(whole, 3), filled(part(whole, 4)), filled(part(whole, 5)))
    return F.when(rest == "", "/").otherwise(quoted(rest))


def site(url: Column | str) -> Column:
    """``struct<url,error>`` of a site address as a user types it: with its scheme, or why it is refused."""
    v = strip(url)
    full = F.when(v.rlike("^https?://"), v).otherwise(F.concat(F.lit("https://"), v))
    domain = F.lower(F.split_part(part(full, 2), F.lit(":"), F.lit(1)))
    refused = v.rlike(r"^https?://$") | v.rlike("^[a-zA-Z]+$") | v.rlike(r"\.{2,}") | v.startswith("ftp://")
    sound = domain.rlike(SITE_DOMAIN) & ((domain == "localhost") | domain.contains("."))
    error = (
        F.when(F.coalesce(v, F.lit("")) == "", NO_ADDRESS)
        .when(refused, NOT_VALID)
        .when(F.coalesce(part(full, 2), F.lit("")) == "", NO_FORMAT)
        .when(~sound, NO_DOMAIN)
    )
    return F.struct(F.when(error.isNull(), full).alias("url"), error.alias("error"))


def valid_site(url: Column | str) -> Column:
    """Whether a site address as a user types it is acceptable."""
    return site(url)["error"].isNull()


def form_error(url: Column | str) -> Column:
    """Why an entry form refuses a site address, else null; stricter than ``site``: a top domain of up to six characters."""
    url = F.col(url) if isinstance(url, str) else url
    full = F.when(F.rlike(url, F.lit("^https?://")), url).otherwise(F.concat(F.lit("https://"), url))
    sound = full.rlike(FORM_ADDRESS)
    return F.when(F.coalesce(strip(url), F.lit("")) == "", NO_ADDRESS).when(~sound, NOT_VALID)
