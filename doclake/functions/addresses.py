"""Whether an address may be fetched: no private, local or reserved hosts."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import col

EXTRA_NETS = (ipaddress.ip_network("100.64.0.0/10"), ipaddress.ip_network("64:ff9b::/96"))
#: First and last number of the IPv4 ranges that are private, local, reserved or for groups.
IPV4_RANGES = tuple(
    (int(n.network_address), int(n.broadcast_address))
    for n in map(ipaddress.ip_network, ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"))
)

Address = ipaddress.IPv4Address | ipaddress.IPv6Address
Resolver = Callable[[str], list[str]]


def ipv4_private(host: str | Column) -> Column:
    """Whether a dotted IPv4 host lies in a range that must not be fetched; null for any other host."""
    octets = F.split(col(host), r"\.")
    dotted = col(host).rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z") & F.forall(octets, lambda o: o.try_cast("int") <= 255)
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + F.coalesce(o.try_cast("long"), F.lit(0)))
    inside = F.lit(False)
    for first, last in IPV4_RANGES:
        inside = inside | number.between(first, last)
    return F.when(dotted, inside)


def is_web(url: str | Column) -> Column:
    """Whether an address is one of the web, http or https, whatever its case; a path or a null is none."""
    scheme = F.lower(F.regexp_extract(F.trim(col(url)), r"\A([^:/]*)://", 1))
    return F.coalesce(scheme.isin("http", "https"), F.lit(False))


def is_private(ip: Address) -> bool:
    flags = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_unspecified or ip.is_multicast
    return flags or any(ip.version == net.version and ip in net for net in EXTRA_NETS)


def resolve(url: str, resolver: Resolver | None = None) -> list[Address] | None:
    """All addresses of an URL's host, or None if it has none."""
    try:
        host = urlparse(url).hostname
        if not host:
            return None
        try:
            return [ipaddress.ip_address(host)]
        except ValueError:
            names = resolver(host) if resolver else [str(i[4][0]) for i in socket.getaddrinfo(host, None)]
            return [ipaddress.ip_address(n) for n in names] or None
    except (OSError, ValueError):
        return None


def is_safe_url(url: str, resolver: Resolver | None = None) -> bool:
    """http and https only, and no address of the host may be private; an unknown host passes and fails when fetched."""
    if (urlparse(url).scheme or "").lower() not in ("http", "https"):
        return False
    found = resolve(url, resolver)
    return found is None or not any(map(is_private, found))
