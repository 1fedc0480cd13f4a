"""A polite page source: one task per host at a time, pinned addresses, hard limits.

Partitioning takes the place of locks: a host's URLs are in exactly one task, which fetches them one
after another with the host's delay; parallelism is the number of partitions.  The result is a side
effect of the network, so callers write it before they use it.
"""

from __future__ import annotations

import http.client
import ssl
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import guard

SCHEMA = """url_norm string, url_final string, status int, headers map<string,string>, content binary, charset string, charset_source string,
redirect_chain array<string>, error_code string, robots_blocked boolean, fetched_at timestamp, attempts int"""
REDIRECTS = {301, 302, 303, 307, 308}
TRANSIENT = {"E_TIMEOUT", "E_CONNECT", "E_HTTP_5XX", "E_RATE_LIMIT"}


@dataclass(frozen=True)
class FetchRules:
    user_agent: str = "sievewright/0.1 (+mailto:owner@example.org)"
    retries: int = 3
    max_redirects: int = 5
    max_length: int = 5 * 1024 * 1024
    max_body: int = 20 * 1024 * 1024
    robots_bytes: int = 1024 * 1024
    timeout: float = 20.0
    deadline: float = 60.0
    host_delay: float = 1.0
    respect_robots: bool = True
    allow_private: bool = False
    ports: tuple | None = None


class Failure(Exception):
    def __init__(self, code: str, **more):
        super().__init__(code)
        self.code, self.more = code, more


class HostSession:
    """Fetches of one task: robots rules and the time of the last request, per scheme, host and port."""

    def __init__(self, rules: FetchRules, sleep=time.sleep):
        self.rules, self.sleep = rules, sleep
        self.robots: dict[tuple, guard.Robots] = {}
        self.last: dict[str, float] = {}

    def _send(self, url: str, cap: int):
        """(status, headers, reader) of one request to a validated, pinned address."""
        r, p = self.rules, urlsplit(url)
        host, port = p.hostname or "", p.port
        ips = guard.resolve(host, port, r.allow_private, set(r.ports) if r.ports else None)
        try:
            if p.scheme == "https":
                conn = http.client.HTTPSConnection(host, port or 443, timeout=r.timeout, context=ssl.create_default_context())
            else:
                conn = http.client.HTTPConnection(host, port or 80, timeout=r.timeout)
            create = conn._create_connection
            conn._create_connection = lambda address, *a, **k: create((ips[0], address[1]), *a, **k)  # the name stays for TLS and Host
            target = (p.path or "/") + (f"?{p.query}" if p.query else "")
            conn.request("GET", target, headers={"User-Agent": r.user_agent, "Accept": "text/html,application/xhtml+xml", "Accept-Encoding": "gzip, deflate"})
            resp = conn.getresponse()
            return resp.status, {k.lower(): v for k, v in resp.getheaders()}, resp, conn
        except TimeoutError:
            raise Failure("E_TIMEOUT") from None
        except ssl.SSLError:
            raise Failure("E_TLS") from None
        except (OSError, http.client.HTTPException):
            raise Failure("E_CONNECT") from None

    def _read(self, resp, headers: dict, cap: int, until: float) -> bytes:
        coding = [c.strip() for c in headers.get("content-encoding", "").lower().split(",") if c.strip() and c.strip() != "identity"]
        if len(coding) > 1:
            raise Failure("E_BOMB")
        inflate = zlib.decompressobj(47) if coding and coding[0] in ("gzip", "x-gzip", "deflate") else None
        out, size = [], 0
        while True:
            try:
                chunk = resp.read(65536)
            except TimeoutError:
                raise Failure("E_TIMEOUT") from None
            except (OSError, http.client.HTTPException):
                raise Failure("E_CONNECT") from None
            if time.monotonic() > until:
                raise Failure("E_TIMEOUT")
            if not chunk:
                break
            try:
                chunk = inflate.decompress(chunk, cap + 1 - size) if inflate else chunk
            except zlib.error:
                raise Failure("E_CONNECT") from None
            out.append(chunk)
            size += len(chunk)
            if size > cap or (inflate and inflate.unconsumed_tail):
                raise Failure("E_BOMB")
        return b"".join(out)

    def rules_of(self, url: str) -> guard.Robots:
        p = urlsplit(url)
        key = (p.scheme, p.hostname, p.port)
        if key not in self.robots:
            status, text = 0, ""
            try:
                self._wait(p.hostname or "")
                status, headers, resp, conn = self._send(f"{p.scheme}://{p.netloc}/robots.txt", self.rules.robots_bytes)
                text = self._read(resp, headers, self.rules.robots_bytes, time.monotonic() + self.rules.deadline).decode("utf-8", "replace")
                conn.close()
            except (Failure, guard.Blocked):
                status = 0
            self.robots[key] = guard.Robots(status, text, self.rules.user_agent)
        return self.robots[key]

    def _wait(self, host: str, delay: float = 0.0) -> None:
        pause = self.last.get(host, -1e9) + delay - time.monotonic()
        if pause > 0:
            self.sleep(pause)
        self.last[host] = time.monotonic()

    def once(self, url: str) -> dict:
        from sievewright.sources.html import decode

        r, at, chain = self.rules, url, []
        until = time.monotonic() + r.deadline
        while True:
            p = urlsplit(at)
            if p.scheme not in ("http", "https") or not p.hostname:
                raise Failure("E_SSRF_BLOCKED", chain=chain)
            robots = self.rules_of(at) if r.respect_robots else None
            if robots and not robots.allows((p.path or "/") + (f"?{p.query}" if p.query else "")):
                raise Failure("E_ROBOTS_BLOCK", robots=True, chain=chain, final=at)
            self._wait(p.hostname, guard.host_delay(robots.delay if robots else None, r.host_delay))
            status, headers, resp, conn = self._send(at, r.max_body)
            try:
                if status in REDIRECTS and headers.get("location"):
                    chain.append(at)
                    if len(chain) > r.max_redirects:
                        raise Failure("E_REDIRECT_LOOP", chain=chain)
                    at = urljoin(at, headers["location"])
                    continue
                more = {"status": status, "headers": headers, "chain": chain, "final": at}
                if status >= 400:
                    raise Failure("E_RATE_LIMIT" if status == 429 else "E_HTTP_5XX" if status >= 500 else "E_HTTP_4XX", **more)
                kind = headers.get("content-type", "").split(";")[0].strip().lower()
                if kind and not kind.startswith(("text/html", "application/xhtml")):
                    raise Failure("E_NONHTML", **more)
                if headers.get("content-length", "").isdigit() and int(headers["content-length"]) > r.max_length:
                    raise Failure("E_TOO_LARGE", **more)
                body = self._read(resp, headers, r.max_body, until)
                _, charset, source = decode(body, headers.get("content-type"))
                return {"url_final": at, "status": status, "headers": headers, "content": body, "charset": charset, "charset_source": source, "redirect_chain": chain, "error_code": None, "robots_blocked": False}
            finally:
                conn.close()

    def fetch(self, url: str) -> dict:
        """One URL with retries of transient failures; never raises."""
        attempt = 0
        while True:
            try:
                out = self.once(url)
            except guard.Blocked as e:
                out = {"error_code": e.code}
            except Failure as e:
                m = e.more
                out = {"error_code": e.code, "status": m.get("status", 0), "headers": m.get("headers"), "redirect_chain": m.get("chain", []), "url_final": m.get("final"), "robots_blocked": m.get("robots", False)}
            except Exception:  # noqa: BLE001 - isolate the row
                out = {"error_code": "E_UNEXPECTED"}
            attempt += 1
            if out["error_code"] not in TRANSIENT or attempt > self.rules.retries:
                base = {"url_norm": url, "url_final": None, "status": 0, "headers": None, "content": None, "charset": None, "charset_source": None, "redirect_chain": [], "robots_blocked": False}
                return {**base, **out, "fetched_at": datetime.now(timezone.utc), "attempts": attempt}
            self.sleep(guard.retry_delay(attempt, out["error_code"], (out.get("headers") or {}).get("retry-after")))


def fetch(urls: DataFrame, rules: FetchRules = FetchRules(), partitions: int = 200) -> DataFrame:
    """Outcomes of (url_norm, host) rows; write the result before branching on it.

    The number of partitions is explicit, so adaptive execution neither splits a host nor joins tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = HostSession(rules)
        for pdf in batches:
            for u in pdf["url_norm"]:
                yield pd.DataFrame([session.fetch(u)])

    return urls.select("url_norm", "host").repartition(partitions, F.col("host")).sortWithinPartitions("host", "url_norm").select("url_norm").mapInPandas(run, SCHEMA.replace("\n", " "))


