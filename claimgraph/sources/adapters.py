"""Readers of the network behind transports that the caller passes; nothing here opens a connection of its own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.urls import hostname

#: (content type, body) of a URL; raises what goes wrong. An error with a ``code`` is an answer of the server.
Transport = Callable[[str], tuple[str, bytes]]
MOST_BYTES = 4_000_000


def status_of(error: Exception) -> str:
    """http-<code>, or the error's name."""
    code = getattr(error, "code", None)
    return f"http-{code}" if isinstance(code, int) else type(error).__name__.lower()


def page(url: str, transport: Transport) -> tuple[str, str]:
    """(html, status): HTML only, its first MOST_BYTES; any failure is a status and no html."""
    try:
        kind, body = transport(url)
        if "html" not in kind.lower():
            return "", "not-html"
        charset = kind.lower().partition("charset=")[2].strip("\"' ;") or "utf-8"
        return body[:MOST_BYTES].decode(charset, "replace"), "ok"
    except Exception as e:  # noqa: BLE001 - a failed page is a row
        return "", status_of(e)


def articles(urls: DataFrame, transport: Transport, allowed: Callable[[str], bool] = lambda url: True, delay: float = 1.5) -> DataFrame:
    """url, html, status for each row with a url.

    Rows are dealt by host, so that one task holds a host and can leave ``delay`` seconds between its pages; a host's
    pages are read one after the other on purpose. One page that fails doesn't touch the rest.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for part in parts:
            rows = []
            for url in part["url"]:
                if not allowed(url):
                    rows.append((url, "", "robots-disallowed"))
                    continue
                host = urlsplit(url).netloc
                time.sleep(max(0.0, last.get(host, -delay) + delay - time.monotonic()))
                rows.append((url, *page(url, transport)))
                last[host] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "html", "status"])

    return urls.select("url").filter("url is not null").repartition(hostname(F.col("url"))).mapInPandas(run, "url string, html string, status string")


#: value, change in percent, date of a symbol; raises if there is none.
Quote = Callable[[str], tuple[float, float | None, str]]


def quote(symbol: str, primary: Quote, fallback: Quote | None = None, attempts: int = 3, wait: float = 5.0) -> tuple:
    """(value, change_pct, asof, provider, error): the first provider, asked again while it answers 429; then the second."""
    error = ""
    for n in range(attempts):
        try:
            return (*primary(symbol), "primary", "")
        except Exception as e:  # noqa: BLE001
            error = status_of(e)
            if getattr(e, "code", None) != 429:
                break
            if n < attempts - 1:
                time.sleep(wait * (n + 1))
    try:
        if fallback is not None:
            return (*fallback(symbol), "fallback", "")
    except Exception as e:  # noqa: BLE001
        error = status_of(e)
    return (None, None, None, None, error)


def quotes(symbols: DataFrame, primary: Quote, fallback: Quote | None = None, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """symbol, value, change_pct, asof, provider, error for each distinct symbol; errors are rows without a value."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(s, *quote(s, primary, fallback, attempts, wait)) for s in part["symbol"]]
            yield pd.DataFrame(rows, columns=["symbol", "value", "change_pct", "asof", "provider", "error"])

    return symbols.select("symbol").filter("symbol is not null").distinct().mapInPandas(run, "symbol string, value double, change_pct double, asof string, provider string, error string")
