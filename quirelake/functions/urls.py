"""Addresses: resolve, relativise, normalise, and URI templates. Columns take Arrow batches."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(base: str, href: str) -> str:
    """href as seen from base; a base without a scheme works too."""
    if urlsplit(base).scheme or urlsplit(href).scheme or base.startswith("/"):
        return urljoin(base, href)
    return urljoin("http://x/" + base, href).removeprefix("http://x/")


def relativise(base: str, url: str) -> str:
    """url without the folder base, if it lies in it."""
    folder = base if base.endswith("/") else base.rpartition("/")[0] + "/"
    return url[len(folder) :] if url.startswith(folder) and len(url) > len(folder) else url


def normalise(url: str) -> str:
    """Scheme and host in lower case, dots followed, escapes that aren't needed undone."""
    p = urlsplit(url)
    out: list[str] = []
    for part in p.path.split("/"):
        if part == "..":
            if out and out[-1] not in ("", ".."):
                out.pop()
        elif part != ".":
            out.append(quote(unquote(part), safe="!$&'()*+,;=:@-._~"))
    if p.path.endswith(("/.", "/..")):
        out.append("")
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), "/".join(out), p.query, p.fragment))


def template_names(template: str) -> list[str]:
    return list(dict.fromkeys(n.strip() for m in re.findall(r"\{\??([^}]+)\}", template) for n in m.split(",")))


def expand_template(template: str, values: dict[str, str]) -> str:
    """{a} and {a,b} become values, {?a,b} a query of those that are given."""

    def put(m: re.Match) -> str:
        names = [n.strip() for n in m[2].split(",")]
        if m[1]:
            given = [f"{n}={quote(values[n], safe='')}" for n in names if values.get(n) is not None]
            return "?" + "&".join(given) if given else ""
        return ",".join(quote(values.get(n) or "", safe="") for n in names)

    return re.sub(r"\{(\??)([^}]+)\}", put, template)


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve(b, h) for b, h in zip(base, href)])


@F.pandas_udf(T.StringType())
def normalised(url: pd.Series) -> pd.Series:
    return url.map(normalise, na_action="ignore")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def query_value(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
