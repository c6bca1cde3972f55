"""Checks and parsing around calls: addresses, event streams, room in a context window, pages of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosts and IPv4 networks (address, bits) that must not be called.
HOSTS = ("localhost", "0.0.0.0", "::1")
NETWORKS = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 8))
#: IPv6 loopback, link-local, unique local and IPv4-mapped addresses, as they are written.
_INNER6 = r"^(?:(?:0{0,4}:){2,7}0{0,3}1|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|(?:::|(?:0{1,4}:){5})(?:0{1,4}:)?ffff:.*)$"
#: Least buffer, its share of the window and its greatest share, and the least reserve for an answer.
BUFFER, BUFFER_SHARE, MOST_SHARE, RESERVE = 13_000, 0.08, 0.25, 8_000


def url_problem(url: Column) -> Column:
    """Why a URL must not be called: `empty`, `scheme`, `host`, `internal`; null if it may be. Names aren't resolved."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^\[([^\]]*)\].*$", "$1"), r"^([^:]*):[^:]*$", "$1"))
    quad = F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(quad, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    # numbers with leading zeros are names, not addresses
    is4 = host.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & F.forall(quad, lambda x: x <= 255)
    inner = F.lit(False)
    for net, bits in NETWORKS:
        low = sum(int(p) << s for p, s in zip(net.split("."), (24, 16, 8, 0), strict=True))
        inner = inner | number.between(low, low + (1 << (32 - bits)) - 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "empty").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host")
        .when(host.isin(*HOSTS) | (is4 & inner) | host.rlike(_INNER6), "internal")
    )


def sse_payloads(body: Column) -> Column:
    """The data of each event in an event stream's body, as an array; other fields and comments are left out.

    An event's data lines are joined by line feeds; an empty line or the end closes it. Null gives an empty array.
    """
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda l: F.regexp_replace(l, "\r+$", ""))
    # "b" stands for an empty line, "d" is before each line of data, so that empty data isn't an empty line
    kept = F.filter(lines, lambda l: (l == "") | F.startswith(l, F.lit("data:")))
    marked = F.array_join(F.transform(kept, lambda l: F.when(l == "", "b").otherwise(F.concat(F.lit("d"), F.regexp_replace(l, "^data: ?", "")))), "\n")
    events = F.filter(F.transform(F.split(marked, r"(?:^|\n)b(?=\n|\z)"), lambda e: F.regexp_replace(e, "^\n", "")), lambda e: e != "")
    return F.transform(events, lambda e: F.regexp_replace(e, "(?md)^d", ""))


def context_threshold(window: Column, requested: Column) -> Column:
    """Tokens that a conversation may take before it is shortened: the window without reserve and buffer."""
    share = lambda x: (window * F.lit(x)).cast("bigint")
    buffer = F.least(F.greatest(F.lit(BUFFER), share(BUFFER_SHARE)), share(MOST_SHARE))
    reserve = F.least(F.greatest(F.coalesce(requested, F.lit(0)), F.lit(RESERVE)), window - buffer - share(MOST_SHARE))
    return (window - reserve - buffer).cast("bigint")


def table_page(spark: SparkSession, name: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a table's rows; order makes pages repeatable. Names that aren't plain identifiers raise."""
    for x in (name, *order):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x):
            raise ValueError(f"not an identifier: {x!r}")
    return spark.table(name).orderBy(*order).offset(offset).limit(limit)
