"""Addresses, hosts, devices and wallets on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_octets(ip: Column) -> Column:
    """Four numbers, or null if the text isn't an address."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
    return F.when(ip.rlike(IPV4), F.when(F.forall(parts, lambda p: p <= 255), parts))


def ipv4_number(octets: Column) -> Column:
    return F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)


def number_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(n, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def is_private(octets: Column) -> Column:
    a, b = octets[0], octets[1]
    return (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254)) | (a >= 224)
    )


def subnet_start(n: Column, bits: int) -> Column:
    return n - n % (1 << (32 - bits))


def host_port(url: Column) -> Column:
    """``struct<host, port>`` of an http URL without userinfo; the scheme's port where none or a bad one stands."""
    authority = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1), "^.*@", "")
    usual = F.when(F.lower(url).startswith("https:"), 443).otherwise(80)
    told = F.regexp_extract(authority, r":([^:]*)$", 1).try_cast("int")
    port = F.when(told.between(1, 65535), told).otherwise(usual)
    host = F.lower(F.regexp_replace(authority, r":[^:]*$", ""))
    return F.when(authority != "", F.struct(host.alias("host"), port.alias("port")))


def _any(ports: Column, *numbers: int) -> Column:
    return F.arrays_overlap(ports, F.array(*map(F.lit, numbers)))


def device_class(ports: Column, cpes: Column, tags: Column) -> Column:
    """Kind of host by open ports, product names and tags; the first rule that fits."""
    named = lambda pattern: F.exists(cpes, lambda c: F.lower(c).rlike(pattern))
    return (
        F.when(_any(ports, 554, 8554) | named("camera|dvr|hikvision|dahua|axis|ipcam"), "Camera/DVR")
        .when(_any(ports, 9100) | named("printer|hp.*laserjet|epson|brother"), "Printer")
        .when(_any(ports, 1883, 8883) | F.exists(tags, lambda t: F.lower(t) == "iot"), "IoT Device")
        .when(_any(ports, 5060, 5061), "VoIP/SIP")
        .when(named("mikrotik|ubiquiti|cisco|juniper|fortinet") | _any(ports, 161, 8291), "Router/Switch")
        .when(_any(ports, 3306, 5432, 27017, 6379, 9200, 5984), "Database")
        .when(_any(ports, 25, 587, 993, 995, 110, 143), "Mail Server")
        .when(_any(ports, 53), "DNS Server").when(_any(ports, 21, 990), "FTP Server")
        .when(_any(ports, 1194, 1723, 500, 4500) | named("openvpn|wireguard"), "VPN Gateway")
        .when(_any(ports, 3389), "Windows Workstation")
        .when(_any(ports, 22) & ~_any(ports, 80, 443), "Linux Server")
        .when(_any(ports, 80, 443, 8080, 8443), "Web Server").otherwise("Unknown Host")
    )


def host_risk(ports: Column, n_vulns: Column) -> Column:
    return (
        F.when(n_vulns > 5, "CRITICAL").when(n_vulns > 0, "HIGH").when(_any(ports, 23, 21, 161), "MEDIUM")
        .when(F.size(ports) > 5, "LOW").otherwise("INFO")
    )


def address_chain(address: Column) -> Column:
    """Which chain an address is of, by its shape."""
    return (
        F.when(address.rlike("^0x[0-9a-fA-F]{40}$"), "evm").when(address.rlike("^(?:bc1[0-9a-z]{20,80}|[13][1-9A-HJ-NP-Za-km-z]{25,34})$"), "bitcoin")
        .when(address.rlike("^T[1-9A-HJ-NP-Za-km-z]{33}$"), "tron").when(address.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "solana")
    )
