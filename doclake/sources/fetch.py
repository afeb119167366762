"""Pages by address: every hop is checked, and the connection goes to the address that was checked."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin, urlparse

from doclake.functions.addresses import Resolver, is_private, resolve

TIMEOUT = 30.0
MAX_REDIRECTS = 10
#: Bytes of a page at most; a larger one is an error and not read on.
MAX_BYTES = 64 << 20


class Unsafe(ValueError):
    """An address that must not be fetched."""


def charset_of(content_type: str) -> str:
    m = re.search(r"""(?i)charset=\s*["']?([\w-]+)""", content_type or "")
    return m[1] if m else "utf-8"


def _connect(url: str, ip: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
    """One GET to ``ip``; certificates are still checked against the host's name."""
    import urllib3

    at = urlparse(url)
    port = at.port or (443 if at.scheme == "https" else 80)
    if at.scheme == "https":
        pool = urllib3.HTTPSConnectionPool(ip, port, server_hostname=at.hostname, assert_hostname=at.hostname, timeout=timeout)
    else:
        pool = urllib3.HTTPConnectionPool(ip, port, timeout=timeout)
    path = (at.path or "/") + (f"?{at.query}" if at.query else "")
    got = pool.request("GET", path, headers={"Host": at.netloc.rpartition("@")[2], "User-Agent": "doclake"}, redirect=False, preload_content=False)
    try:
        body = got.read(MAX_BYTES + 1)
    finally:
        got.release_conn()
    if len(body) > MAX_BYTES:
        raise ValueError(f"more than {MAX_BYTES} bytes: {url}")
    return got.status, {k.lower(): v for k, v in got.headers.items()}, body


def fetch_page(url: str, resolver: Resolver | None = None, connect: Callable[[str, str, float], tuple[int, dict[str, str], bytes]] = _connect, timeout: float = TIMEOUT) -> str:
    """The text of a page. Raises Unsafe for a scheme or host that isn't allowed, and ValueError for what can't be read."""
    for _ in range(MAX_REDIRECTS + 1):
        if urlparse(url).scheme.lower() not in ("http", "https"):
            raise Unsafe(f"only http and https can be fetched: {url}")
        found = resolve(url, resolver)
        if not found:
            raise ValueError(f"unknown host: {url}")
        if any(map(is_private, found)):
            raise Unsafe(f"a private address: {url}")
        status, headers, body = connect(url, str(found[0]), timeout)
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status >= 400:
            raise ValueError(f"status {status}: {url}")
        try:
            return body.decode(charset_of(headers.get("content-type", "")), errors="replace")
        except LookupError:
            return body.decode("utf-8", errors="replace")
    raise ValueError(f"more than {MAX_REDIRECTS} redirects: {url}")
