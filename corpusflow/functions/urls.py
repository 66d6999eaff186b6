"""URLs: validity, canonical form, identifiers inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx

#: Query parameters that carry no identity.
TRACKING = r"^(?:utm_.*|fbclid|gclid|mc_.*|rss)$"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def is_http(url: Column) -> Column:
    """Parses, with protocol http or https and a host."""
    u = rx.trim(url)
    return F.coalesce(F.lower(part(u, "PROTOCOL")).isin("http", "https") & part(u, "HOST").isNotNull(), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(part(rx.trim(url), "HOST"))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, sorted query, no final slash.

    A text that isn't a URL only loses fragment and final slash.  Parameters are
    sorted by name, stably, and not encoded anew.
    """
    u = rx.trim(url)
    scheme, authority = F.lower(part(u, "PROTOCOL")), F.lower(part(u, "AUTHORITY"))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.coalesce(F.nullif(part(u, "PATH"), F.lit("")), F.lit("/"))
    items = F.filter(F.split(F.coalesce(part(u, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    keyed = F.array_sort(F.transform(items, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda s: s["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/$", "")
    return F.when(scheme.isNotNull() & part(u, "HOST").isNotNull(), F.regexp_replace(whole, "/$", "")).otherwise(plain)


def doi_in(*texts: Column) -> Column:
    """The first DOI of the texts in order, lower-case, without closing punctuation."""
    found = F.coalesce(*[rx.extract(t, r"(10\.\d{4,9}/[-._;()/:A-Z0-9]+)") for t in texts])
    return F.lower(F.regexp_replace(found, r"[).,;]+$", ""))


def pmid_in(url: Column, *texts: Column) -> Column:
    """A PubMed number: of the URL, else named in the texts."""
    return F.coalesce(rx.extract(url, r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)"), rx.extract(F.concat_ws(" ", *texts), r"\bPMID\s*:?\s*(\d{6,9})\b"))
