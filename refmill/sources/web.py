"""Web pages as evidence: which addresses may be asked, what an answer says, and how to ask with patience."""

from __future__ import annotations

import ipaddress
import re
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmill.functions.text import clean_text, extract_year

#: Bytes of an answer read, letters searched for signs of a missing page, authors kept; meta names in the order they count.
MAX_BYTES, SAMPLE, MOST_AUTHORS = 5 * 1024 * 1024, 4000, 12
TITLES = ("citation_title", "og:title", "twitter:title")
AUTHORS = ("citation_author", "author")
DATES = ("citation_publication_date", "article:published_time", "date", "dc.date")
GONE, RESTRICTED = (404, 410), (401, 403, 429)
MISSING = r"(?iU)\b(?:404|page not found|content not found|page does not exist)\b"
#: Dotted addresses that aren't public.
_PRIVATE = r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.(?:168|0\.0|0\.2)\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^2[4-5][0-9]\."


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def is_public_url(url: Column) -> Column:
    """Whether an address may be asked: http or https with a host that is neither local nor a private or reserved IPv4 address; IPv6 literals are refused. No name is resolved."""
    host, url = host_of(url), F.coalesce(url, F.lit(""))
    return url.rlike("(?i)^https?://") & (host != "") & ~host.rlike(r"(?:^|\.)localhost$") & ~(host.rlike(r"^[0-9.]+$") & host.rlike(_PRIVATE)) & ~host.startswith("[")


def is_public_host(host: str) -> bool:
    """The same of one host, with every kind of IP address."""
    host = host.casefold()
    if host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host.strip("[]")).is_global
    except ValueError:
        return bool(host)


def is_missing_page(title: Column, body: Column) -> Column:
    """Whether a page that was delivered says that it isn't there; markup is searched too."""
    return clean_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, SAMPLE))).rlike(MISSING)


class _Head(HTMLParser):
    """Gathers a page's title, first headline and meta entries."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.meta = "", {"title": [], "h1": []}, {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" or tag == "h1" and not self.parts["h1"]:
            self.open = tag
        elif tag == "meta":
            a = {k: v or "" for k, v in attrs}
            name, content = (a.get("property") or a.get("name") or "").casefold(), " ".join(a.get("content", "").split())
            if name and content:
                self.meta.setdefault(name, []).append(content)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open:
            self.open = ""

    def handle_data(self, data: str) -> None:
        if self.open:
            self.parts[self.open].append(data)


def page_head(html: str | None) -> tuple[str, list[str], str]:
    """(title, authors, date) of a page: meta entries first, then <title>, then the first <h1>. Nothing for null and empty."""
    p = _Head()
    p.feed(html or "")
    first = lambda names: next((p.meta[n][0] for n in names if p.meta.get(n)), "")
    title = first(TITLES) or next((t for t in (" ".join(" ".join(p.parts[k]).split()) for k in ("title", "h1")) if t), "")
    return title, next((p.meta[n] for n in AUTHORS if p.meta.get(n)), [])[:MOST_AUTHORS], first(DATES)


def html_metadata(page: Column) -> Column:
    """page_head() of a column, as a struct, in Arrow batches."""

    @F.pandas_udf("title string, authors array<string>, date string")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_head(x) for x in pages], columns=["title", "authors", "date"])

    return read(page)


def candidates_of_answers(answers: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, provider, identifier, title, authors, year, venue, url) of answers (url, status_code, body): none of pages gone or missing, a bare one of those refused."""
    rows = answers.where(~F.col("status_code").isin(*GONE)).withColumn("head", html_metadata(F.when(~F.col("status_code").isin(*RESTRICTED), F.col("body"))))
    refused = F.col("status_code").isin(*RESTRICTED)
    rows = rows.withColumn("missing", F.when(refused, F.lit(False)).otherwise(is_missing_page(F.col("head.title"), F.col("body")))).where("not missing")
    empty = F.array().cast("array<string>")
    return rows.select(*keep, F.when(refused, "web_restricted").otherwise("web").alias("provider"), F.col("url").alias("identifier"), F.when(refused, "").otherwise(clean_text(F.col("head.title"))).alias("title"), F.when(refused, empty).otherwise(F.col("head.authors")).alias("authors"), F.when(~refused, extract_year(F.col("head.date"))).alias("year"), host_of(F.col("url")).alias("venue"), "url")


def retry_wait(attempt: int, retry_after: str | None) -> float:
    """Seconds to wait after an answer 429 or 5xx: what it asks for, within bounds, else twice as long each time."""
    try:
        return min(30.0, max(0.5, float(retry_after)))
    except (TypeError, ValueError):
        return min(8.0, 0.5 * 2**attempt)


def get_patiently(get: Callable[[str], tuple[int, dict, str]], url: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, str]:
    """(status, body, error) of get(url) -> (status, headers, body), asked again after failures; 404 is an answer."""
    error = ""
    for attempt in range(retries + 1):
        try:
            status, headers, body = get(url)
        except Exception as e:  # one failing source must not end a run
            error, wait = f"{type(e).__name__}: {e}", retry_wait(attempt, None)
        else:
            if status < 400 or status in (404, 410, 401, 403):
                return status, body[:MAX_BYTES], ""
            error, wait = f"HTTP {status}", retry_wait(attempt, headers.get("Retry-After"))
        if attempt < retries:
            sleep(wait)
    return 0, "", error


def fetch(rows: DataFrame, key: str, url: str, get: Callable[[str], tuple[int, dict, str]], per_second: float, workers: int = 1, retries: int = 3) -> DataFrame:
    """(key, url, status_code, body, error) of each public address, asked by `workers` tasks that together keep the rate."""
    pause = workers / per_second
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            out = []
            for k, u in zip(batch[key], batch[url]):
                m = re.match(r"(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", u or "")
                if not m or not is_public_host(m.group(1)):
                    out.append((k, u, 0, "", "not a public address"))
                    continue
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                out.append((k, u, *get_patiently(get, u, retries)))
            yield pd.DataFrame(out, columns=[key, url, "status_code", "body", "error"])

    return rows.where(F.coalesce(F.col(url), F.lit("")) != "").select(key, url).repartition(workers, url).mapInPandas(run, f"`{key}` {kind}, `{url}` string, status_code int, body string, error string")
