"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING = "utm_|fbclid|gclid"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes; scheme and host in lower case."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    place = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(scheme, F.when(place == "", "/").otherwise(place), query)


def merge_key(url: Column) -> Column:
    """Without fragment and trailing slash, in lower case; the query stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+(?=$|\?)", ""))


def slug(url: Column, most: int = 90) -> Column:
    """The last part of the path as a slug; ``article`` where nothing is left."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    last = F.lower(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("article")))
    text = F.substring(F.regexp_replace(F.regexp_replace(last, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(text == "", "article").otherwise(text)


def allowed(url: Column, domains: Column) -> Column:
    """The host is one of the domains or lies below one."""
    return F.exists(domains, lambda d: (host(url) == d) | host(url).endswith(F.concat(F.lit("."), d)))


def parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{name}=([^&#]*)", 1)


def request_path(target: Column) -> Column:
    """The path of a request's target: of an absolute address, of one without a scheme, or what precedes the query."""
    absolute, network = r"(?i)^[a-z][a-z\d+.-]*://[^/?#]*(/[^?#]*)?", r"^//[^/?#]*(/[^?#]*)?"
    slash = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(target, pattern, 1), F.lit("")), F.lit("/"))
    return F.when(target.rlike(absolute), slash(absolute)).when(target.rlike(network), slash(network)).otherwise(F.substring_index(target, "?", 1))


#: Names of a list's filters in an address, in order, and the filter each stands for (fixed values).
FILTERS = {"publisher": "publisher", "date": "year", "category": "category", "priority": "priority", "q": "keyword"}


def with_filters(path: Column, values: dict[str, Column], sort: Column) -> Column:
    """An address with the filters that aren't empty, form-encoded, and the order where it is by score."""
    pairs = [F.when(F.trim(F.coalesce(values[v], F.lit(""))) != "", F.concat(F.lit(f"{name}="), F.url_encode(F.trim(values[v])))) for name, v in FILTERS.items() if v in values]
    query = F.concat_ws("&", *pairs, F.when(sort == "score", "sort=score"))
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def filters_of(url: Column) -> Column:
    """The filters that an address carries, decoded, and its order: by score or else by date."""
    found = [F.url_decode(parameter(url, name)).alias(v) for name, v in FILTERS.items()]
    return F.struct(*found, F.when(parameter(url, "sort") == "score", "score").otherwise("date").alias("sort"))
