"""Where a fetch may go: addresses, ports, robots rules, retry delays."""

from __future__ import annotations

import ipaddress
import random
import re
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that count as unsafe though the registries call some of them global.
BLOCKED_NETWORKS = ["100.64.0.0/10", "168.63.129.16/32", "100.100.100.200/32", "64:ff9b::/96", "2001::/32", "2002::/16"]
PORTS = {80, 443}
_NETS = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS]


def address_problem(text: str, allow_private: bool = False) -> str | None:
    """Why an address is no public destination, or None."""
    try:
        ip = ipaddress.ip_address(text.split("%")[0].strip("[]"))
    except ValueError:
        return "not_an_address"
    if allow_private:
        return None
    todo = [ip]
    while todo:
        x = todo.pop()
        if any(x.version == n.version and x in n for n in _NETS):
            return "blocked_network"
        inner = getattr(x, "ipv4_mapped", None) or getattr(x, "sixtofour", None)
        if inner is not None:
            todo.append(inner)
        elif not x.is_global or x.is_multicast:
            return "not_global"
    return None


def address_verdict(c: Column) -> Column:
    """Null for a safe address, else the reason."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: address_problem(x) if x is not None else "not_an_address").astype(object)

    return run(c)


def addresses_safe(ips: Column) -> Column:
    """Whether all resolved addresses of a host are safe; one bad address rejects the host.  Explodes
    nowhere: a joined string is checked per row."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bool(x) and all(address_problem(i) is None for i in x.split(",")))

    return run(F.array_join(ips, ","))


def port_allowed(port: Column) -> Column:
    return port.isNull() | port.isin(sorted(PORTS))


class Blocked(Exception):
    def __init__(self, code: str, reason: str):
        super().__init__(reason)
        self.code = code


def resolve(host: str, port: int | None, allow_private: bool = False, ports: set | None = None, lookup=socket.getaddrinfo) -> list[str]:
    """Addresses of a host, all of them safe; the port is checked before any lookup."""
    if port is not None and port not in (ports if ports is not None else PORTS):
        raise Blocked("E_SSRF_BLOCKED", "port_not_allowed")
    try:
        found = list(dict.fromkeys(str(a[4][0]).split("%")[0] for a in lookup(host, port or 443, type=socket.SOCK_STREAM)))
    except OSError:
        raise Blocked("E_DNS", "no_address") from None
    if not found:
        raise Blocked("E_DNS", "no_address")
    for ip in found:
        why = address_problem(ip, allow_private)
        if why:
            raise Blocked("E_SSRF_BLOCKED", why)
    return found


class Robots:
    """Rules of one robots.txt for one user agent: the longest matching rule wins, allow wins ties,
    ``*`` matches anything and ``$`` the end.  A file that was not served with 2xx allows all."""

    def __init__(self, status: int, text: str, agent: str):
        self.rules: list[tuple[int, bool, re.Pattern]] = []
        self.delay: float | None = None
        if 200 <= status < 300:
            self._read(text, agent.split("/")[0].strip().lower())

    def _read(self, text: str, agent: str) -> None:
        groups: list[tuple[list[str], list[tuple[str, str]]]] = []
        open_ = False
        for line in text.lstrip("﻿").splitlines():
            key, sep, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not sep:
                continue
            if key == "user-agent":
                if not open_:
                    groups.append(([], []))
                    open_ = True
                groups[-1][0].append(value.lower())
            elif groups and key in ("allow", "disallow", "crawl-delay"):
                groups[-1][1].append((key, value))
                open_ = False
        named = [g for g in groups if any(a != "*" and a and a in agent for a in g[0])]
        for _, rules in named or [g for g in groups if "*" in g[0]]:
            for key, value in rules:
                if key == "crawl-delay":
                    try:
                        self.delay = float(value)
                    except ValueError:
                        pass
                elif value:
                    end = value.endswith("$")
                    body = ".*".join(map(re.escape, (value[:-1] if end else value).split("*")))
                    self.rules.append((len(value), key == "allow", re.compile(body + ("$" if end else ""))))

    def allows(self, path: str) -> bool:
        hits = [(n, allow) for n, allow, p in self.rules if p.match(path or "/")]
        return max(hits)[1] if hits else True


def robots_allow(body: Column, status: Column, path: Column, agent: str) -> Column:
    """Whether the robots file (body, as served with status) lets the agent fetch the path; equal files are
    read once a batch."""

    @F.pandas_udf("boolean")
    def run(b: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        known: dict[tuple, Robots] = {}
        out = []
        for text, code, x in zip(b, s, p):
            key = (int(code), text or "")
            if key not in known:
                known[key] = Robots(*key, agent)
            out.append(known[key].allows(x))
        return pd.Series(out)

    return run(body, F.coalesce(status, F.lit(0)), path)


def retry_delays(attempt: Column, code: Column, retry_after: Column) -> Column:
    """Least seconds before a retry, jitter aside."""
    by_server = (code == "E_RATE_LIMIT") & retry_after.rlike(r"^\s*\d+(?:\.\d+)?\s*$")
    return F.when(by_server, F.least(F.lit(60.0), retry_after.try_cast("double"))).otherwise(F.least(F.lit(20.0), 0.5 * F.pow(F.lit(2.0), attempt - 1)))


def host_delay(robots_delay: float | None, least: float = 1.0) -> float:
    """Seconds between two fetches of a host: a crawl delay within 0.5 to 30, else the setting."""
    return min(30.0, max(0.5, robots_delay)) if robots_delay is not None else max(least, 0.5)


def retry_delay(attempt: int, code: str, retry_after: str | None = None, rng=random.random) -> float:
    """Seconds before retry ``attempt`` (from 1): the server's number of seconds after a rate limit, at
    most 60, else doubling from half a second up to 20 with up to half a second of jitter."""
    if code == "E_RATE_LIMIT" and retry_after is not None and re.fullmatch(r"\s*\d+(?:\.\d+)?\s*", retry_after):
        return min(60.0, float(retry_after))
    return min(20.0, 0.5 * 2 ** (attempt - 1)) + 0.5 * rng()
