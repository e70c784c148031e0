"""Fetching pages and registry records in tasks (SRC1, SRC2, SRC4).

Requests are rows; a partition of them is fetched one after the other with one cookie jar, so the number of partitions
is the number of requests under way.  What goes wrong is a value of ``error``, never a failed job; a lost task asks again.
"""

from __future__ import annotations

import codecs
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from http.cookiejar import CookieJar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds until a request is given up, pauses before it is made again.
TIMEOUT, PAUSES = 30, (2, 4)
AGENT = "scorelark"
REPLY = "body string, status int, attempts int, error string"


def charset(content_type: str | None) -> str:
    """The charset that a Content-Type names, if Python knows it, else UTF-8."""
    named = [value.strip("\"' ") for name, _, value in (p.strip().partition("=") for p in (content_type or "").split(";")) if name.lower() == "charset"]
    try:
        return codecs.lookup(named[0]).name if named else "utf-8"
    except LookupError:
        return "utf-8"


def ask(opener: urllib.request.OpenerDirector, url: str, form: dict | None, timeout: float, pauses: tuple[float, ...], sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(body, status, attempts, error) of one request; a server's error or no answer is tried again, a refusal (4xx) isn't."""
    data = urllib.parse.urlencode(form).encode() if form is not None else None
    error, status, attempt = None, None, 0
    for attempt, pause in enumerate((0, *pauses), 1):
        if pause:
            sleep(pause)
        try:
            with opener.open(urllib.request.Request(url, data, {"User-Agent": AGENT}), timeout=timeout) as reply:
                return reply.read().decode(charset(reply.headers.get("Content-Type")), "replace"), reply.status, attempt, None
        except urllib.error.HTTPError as e:
            error, status = f"http {e.code}", e.code
            if e.code < 500:
                break
        except (OSError, ValueError) as e:  # no answer, or no address that can be asked
            error, status = f"network: {getattr(e, 'reason', None) or e}", None
    return None, status, attempt, error


def fetch(requests: DataFrame, timeout: float = TIMEOUT, pauses: tuple[float, ...] = PAUSES, spacing: float = 0.0) -> DataFrame:
    """SRC1: rows of ``requests`` with body, status, attempts and error of their ``url``.

    With a column ``form`` (a map) the request is a POST of it.  ``spacing`` seconds lie between the requests of a task.
    """
    posts = "form" in requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener, first = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar())), True
        for batch in batches:
            found = []
            for i, url in enumerate(batch["url"]):
                if spacing and not first:
                    time.sleep(spacing)
                first = False
                form = batch["form"].iloc[i] if posts else None
                found.append(ask(opener, url, dict(form) if form is not None else None, timeout, pauses))
            yield batch.assign(**dict(zip(("body", "status", "attempts", "error"), map(list, zip(*found, strict=True)), strict=True))) if found else batch.assign(body=None, status=None, attempts=None, error=None)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{head}, {REPLY}")


def calendar(fetched: DataFrame) -> DataFrame:
    """SRC2: run_id, full, second: both lists of a run; a run without its first list has an error, the second may be missing.

    ``fetched`` has run_id and kind (full or second) beside the reply.
    """
    pick = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    both = fetched.groupBy("run_id").agg(pick("full", "body").alias("full"), pick("second", "body").alias("second"), pick("full", "error").alias("error"))
    return both.withColumn("error", F.when(F.col("full").isNull(), F.coalesce("error", F.lit("not fetched"))))


def registry(fetched: DataFrame) -> DataFrame:
    """SRC4: query and payload of registry replies; a reply that is no JSON, or none at all, is an error."""
    json = F.try_parse_json("body")
    return fetched.select("query", F.when(json.isNotNull(), F.col("body")).alias("payload"), F.when(F.col("error").isNotNull(), F.col("error")).when(json.isNull(), "registry did not answer with JSON").alias("error"))


def crawl(starts: DataFrame, **how) -> DataFrame:
    """SRC15: the home page of each site (url) and the pages of its own that speak of results, with what they lead to."""
    from ..session import written
    from . import pages

    home = written(fetch(starts.select("url").distinct(), **how), "fetched").where("body IS NOT NULL").select("url", F.col("body").alias("html"))
    more = fetch(pages.followed(home, starts).select(F.col("href").alias("url")).distinct().join(home.select("url"), "url", "left_anti"), **how)
    landed = home.unionByName(written(more, "fetched").where("body IS NOT NULL").select("url", F.col("body").alias("html")))
    return pages.crawl(starts, landed)
