"""Fingerprints and partitions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import urls


def sha1(key: Column) -> Column:
    return F.sha1(key)


def md5(key: Column) -> Column:
    return F.md5(key)


def host_local(url: Column) -> Column:
    """CRC32 of the host (of ``-`` without one) as eight hex digits, then the MD5 of host, path, ``;``, params, query and
    fragment: pages of a host share a prefix, so they sort together."""
    name = F.coalesce(urls.host(url), F.lit("-"))
    crc = F.crc32(F.encode(name, "utf-8"))
    whole = F.concat(name, urls.path(url), F.lit(";"), urls.params(url), urls.query(url), urls.fragment(url))
    return F.concat(F.lpad(F.lower(F.hex(crc)), 8, "0"), F.md5(whole))


def signed_crc32(name: Column) -> Column:
    """CRC32 of the UTF-8 bytes as a signed 32-bit number."""
    return F.shiftright(F.shiftleft(F.crc32(F.encode(name, "utf-8")).cast("bigint"), 32), 32).cast("int")


def crc_partition(name: Column, n: int) -> Column:
    """Partition of a host name: its signed CRC32 modulo n (never negative); 0 without a name."""
    return F.coalesce(F.pmod(signed_crc32(name), F.lit(n)), F.lit(0)).cast("int")


def fingerprint_partition(fingerprint: Column, n: int) -> Column:
    """Partition of a fingerprint; 0 without one."""
    return F.when(fingerprint.isNull(), 0).otherwise(F.pmod(F.xxhash64(fingerprint), F.lit(n))).cast("int")


#: Fingerprint functions by name, of a URL or a domain name.
FINGERPRINTS: dict[str, Callable[[Column], Column]] = {"sha1": sha1, "md5": md5, "host_local": host_local}
