"""Where links lead: following redirects, a table of what was found, and messages' links replaced by it."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import RESOLVED
from ..sources.store import pending_urls

#: (url, resolved url, whether certificates were verified, status): what a resolver returns.
Found = tuple[str, str, bool, str]


class _Counted(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections = self.max_repeats = most

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        again = super().redirect_request(req, fp, code, msg, headers, newurl)
        if again is not None:
            again.method = "HEAD"
        return again


def resolve_url(url: str, timeout: float = 15.05, from_header: str | None = None, max_redirects: int = 5) -> Found:
    """Follows a URL's redirects by HEAD requests; a failure leaves the URL as it is and names itself as the status."""
    headers = {"From": from_header} if from_header else {}
    try:
        opener = urllib.request.build_opener(_Counted(max_redirects))
        with opener.open(urllib.request.Request(url, headers=headers, method="HEAD"), timeout=timeout) as r:
            return url, r.url, True, str(r.status)
    except urllib.error.HTTPError as e:
        if "redirect" in str(e.msg).lower() and e.code in (301, 302, 303, 307, 308):
            return url, url, True, "TooManyRedirects"
        return url, e.url or url, True, str(e.code)
    except urllib.error.URLError as e:
        if isinstance(e.reason, ssl.SSLError):
            return url, url, False, "SSLError"
        return url, url, True, "Timeout" if isinstance(e.reason, TimeoutError) else "ConnectionError"
    except TimeoutError:
        return url, url, True, "Timeout"
    except Exception:  # noqa: BLE001  any URL gets an answer
        return url, url, True, "OtherError"


def resolve_pending(urls: DataFrame, resolved: DataFrame | None, resolver: Callable[[str], Found] = resolve_url, tasks: int = 25, per_second: float = 25.0) -> DataFrame:
    """The resolved table with answers for all of urls; at most per_second requests a second, shared out over tasks."""
    pause = tasks / per_second if per_second > 0 else 0.0

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for url in f["url"]:
                began = time.monotonic()
                a, b, c, d = resolver(url)
                found.append((a, b, bool(c), str(d)))
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
            yield pd.DataFrame(found, columns=["url", "resolved_url", "ssl_verified", "resolved_status"])

    pending = pending_urls(urls, resolved)
    new = pending.repartition(tasks).mapInPandas(ask, RESOLVED)
    if resolved is None:
        return new
    return resolved.join(pending.select("url"), "url", "left_anti").unionByName(new)  # by pending's keys: new asks each URL once


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def resolved_message_urls(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(message_id, resolved_url, timestamp, user_id), one of each message and target; links without an answer drop out."""
    joined = urls.join(resolved.where("resolved_url is not null").select("url", "resolved_url"), "url")
    first = F.min(F.struct("url", "timestamp", "user_id")).alias("x")
    return joined.groupBy("message_id", "resolved_url").agg(first).select("message_id", "resolved_url", "x.timestamp", "x.user_id")
