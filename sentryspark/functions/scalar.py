"""Scalar functions as Column expressions: times, ids, text search, command classes, scores, places."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sentryspark.config import DEFAULT, ID_NAMESPACE, MASK, SEVERITIES, Config

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Command patterns with severity and label; the first that matches decides.
COMMAND_PATTERNS = [
    (r"\brm\s+-[a-z]*[rf][a-z]*\s+/(?:\s|$)", "high", "recursive delete of filesystem root"),
    (r"\brm\s+-[a-z]*[rf]", "high", "recursive/forced delete"),
    (r"\bhistory\s+-c\b|>\s*\.bash_history", "high", "shell history wiped (anti-forensics)"),
    (r"\b(shred|dd\s+if=/dev/(zero|urandom))\b", "high", "disk wiping utility"),
    (r"\bwget\b", "high", "remote file download via wget"),
    (r"\bcurl\b.*(-O|-o|\|)", "high", "remote file download via curl"),
    (r"\bcurl\b", "medium", "curl invocation"),
    (r"\b(tftp|ftpget|busybox\s+wget)\b", "high", "download via embedded-device tooling"),
    (r"/dev/tcp/", "high", "bash reverse shell primitive"),
    (r"\b(nc|ncat|netcat)\b.*\s-\w*e", "high", "netcat with command execution"),
    (r"\bchmod\s+[+]?x\b|\bchmod\s+[0-7]*7[0-7]{2}\b", "high", "making a file executable"),
    (r"\bbase64\s+-d\b|\bbase64\s+--decode\b", "high", "base64-encoded payload decoded"),
    (r"\b(perl|python[23]?|php)\s+-e\b", "high", "inline interpreter execution"),
    (r"\|\s*(sh|bash)\b", "high", "piping downloaded content into a shell"),
    (r"\b(crontab|systemctl\s+enable|rc\.local)\b", "high", "persistence mechanism"),
    (r"authorized_keys", "high", "SSH key persistence"),
    (r"\b(useradd|adduser|passwd)\b", "high", "account manipulation"),
    (r"\b(chattr|setcap)\b", "medium", "attribute/capability manipulation"),
    (r"\b(uname|whoami|id|hostname)\b", "low", "host reconnaissance"),
    (r"/proc/cpuinfo|/etc/(passwd|shadow)|free\s+-m", "medium", "system/credential enumeration"),
    (r"\b(nmap|masscan)\b", "high", "network scanning from inside the honeypot"),
    (r"\b(apt-get|yum|apk)\s+install\b", "medium", "package installation attempt"),
]


# -- times ------------------------------------------------------------------


def seconds(stamp: Column) -> Column:
    """Seconds since the epoch of a `YYYY-MM-DDThh:mm:ssZ` string; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def stamp_of(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def truncated(stamp: Column) -> Column:
    """Without the fraction of a second, so that order of strings is order of time."""
    return F.concat(F.substring(stamp, 1, 19), F.lit("Z"))


def bucket(stamp: Column, config: Config = DEFAULT) -> Column:
    """The day and the tumbling window of it that a time falls in, as `2024-01-30#17`; `nowindow` for none."""
    minute = F.substring(stamp, 12, 2).try_cast("int") * 60 + F.substring(stamp, 15, 2).try_cast("int")
    number = F.floor(minute / max(config.window_minutes, 1)).cast("string")
    return F.when(F.coalesce(stamp, F.lit("")) == "", F.lit("nowindow")).otherwise(F.concat(F.substring(stamp, 1, 10), F.lit("#"), number))


# -- ids --------------------------------------------------------------------


def uuid5(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """The name-based id (version 5) of a string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12))


# -- text -------------------------------------------------------------------


def field(name: str, details: str | Column = "details") -> Column:
    return F.get_json_object(details, f"$.{name}")


def contains(column: Column, query: str) -> Column:
    """LIKE '%query%' for which A-Z and a-z are the same; % and _ of the query stay wildcards, a backslash is itself."""
    low = lambda c: F.translate(c, UPPER, LOWER)
    pattern = "%" + query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return low(column).like(pattern)


def once(column: Column) -> Column:
    """The same value by way of a generator, which evaluates it once a row: a plain column would be inlined wherever it is used."""
    return F.explode(F.array(column))


def first_pattern(command: Column) -> Column:
    """The place in COMMAND_PATTERNS, from 1, of the first pattern that a command matches; null if none does."""
    place = F.lit(None).cast("int")
    for k, (pattern, _, _) in reversed(list(enumerate(COMMAND_PATTERNS, 1))):
        place = F.when(command.rlike("(?iuUd)" + pattern), F.lit(k)).otherwise(place)
    return place


def classified(place: Column) -> tuple[Column, Column]:
    """(severity, label) of a first_pattern(), which rows should have as a column made with once()."""
    return tuple(F.get(F.array(*(F.lit(row[k]) for row in COMMAND_PATTERNS)), place - 1) for k in (1, 2))


def masked(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) != "", F.lit(MASK))


def joined_sources(old: Column, new: Column) -> Column:
    """Comma-separated names of both, each once, in order of appearance; a first value stays as it is."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(",", old, new), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.coalesce(old, F.lit("")) == "", new).when(F.coalesce(new, F.lit("")) == "", old).otherwise(F.array_join(parts, ","))


# -- scores -----------------------------------------------------------------


def rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def severity_of(number: Column) -> Column:
    return F.when(number == 3, "high").when(number == 2, "medium").otherwise("low")


def at_least(severity: Column, floor: str) -> Column:
    """severity is `floor` or worse; unknown severities never are."""
    return severity.isin(*SEVERITIES[SEVERITIES.index(floor) :])


def risk(abuse: Column, profile: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(F.coalesce(abuse, zero), F.coalesce(profile, zero))


def confidence(abuse: Column, profile: Column, nodes: Column, downloads: Column, commands: Column) -> Column:
    """How sure it is that an address is hostile, 50 to 100."""
    adds = [(abuse, 50, 20), (profile, 50, 10), (nodes, 2, 10), (downloads, 1, 10), (commands, 1, 5)]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(0)) >= least, plus).otherwise(0) for c, least, plus in adds), F.lit(50))).cast("int")


def profile_score(abuse: Column, sessions: Column, commands: Column) -> Column:
    """Abuse score plus up to 25 points each for sessions (5 apiece) and distinct commands (2 apiece), within 0 to 100."""
    raw = F.coalesce(abuse, F.lit(0)) + F.least(F.lit(25), sessions * 5) + F.least(F.lit(25), commands * 2)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")


def score_band(score: Column, threshold: int = DEFAULT.high_risk) -> Column:
    return F.when(score.isNull(), "none").when(score >= threshold, "high").when(score >= threshold // 2, "medium").otherwise("low")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(0.0)


# -- places -----------------------------------------------------------------


def projected(latitude: Column, longitude: Column, width: float = 1000.0, height: float = 400.0) -> tuple[Column, Column]:
    """x and y on an equirectangular map from 84 degrees north to 60 south, to one decimal."""
    north = F.greatest(F.lit(-60.0), F.least(F.lit(84.0), latitude))
    return F.bround((longitude + 180.0) / 360.0 * width, 1), F.bround((84.0 - north) / 144.0 * height, 1)


def marker_radius(events: Column, peak: Column) -> Column:
    return F.lit(3.0) + 10.0 * F.sqrt(events / F.greatest(peak, F.lit(1)))


def coordinates(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of `lat,lon`, `lat/lon` or `lat lon`; null unless both are in range."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*[,/ ]\s*(-?\d+(?:\.\d+)?)"
    found = [F.regexp_extract(text, pattern, k) for k in (1, 2)]
    lat, lon = (x.try_cast("double") for x in found)
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, lat), F.when(good, lon)


# -- networks ---------------------------------------------------------------

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
#: IPv4 blocks that are not public, without those reserved for documentation.
PRIVATE_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4"]

#: Addresses of these blocks that are public all the same.
PUBLIC_IN_PRIVATE = ["192.0.0.9", "192.0.0.10"]


def is_v4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def _number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return reduce(lambda a, b: a * 256 + b, (F.get(parts, F.lit(k)).try_cast("long") for k in range(4)))


def _block(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
    return low, low + (1 << (32 - int(bits))) - 1


@F.pandas_udf(BooleanType())
def _private_v6(ips: pd.Series) -> pd.Series:
    documents = ipaddress.ip_network("2001:db8::/32")

    def private(text) -> bool:
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return True
        if ip in documents:
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return pd.Series([private(x) for x in ips], dtype="boolean")


def is_private(ip: Column, v6: bool = True) -> Column:
    """Whether an address isn't public; what is no address counts as private, documentation ranges don't.

    With v6 false, addresses with a colon count as private without a look: the plan then has no Python.
    """
    number = _number(ip)
    local = reduce(lambda a, b: a | b, (number.between(*_block(x)) for x in PRIVATE_BLOCKS))
    local = local & ~ip.isin(*PUBLIC_IN_PRIVATE)
    other = _private_v6(F.coalesce(ip, F.lit(""))) if v6 else F.lit(True)
    return F.when(is_v4(ip), local).otherwise(other)


_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with `::` in place of one group or more.
_V6 = "^(" + "|".join([f"({_H}:){{7}}{_H}", "::", *(f"({_H}:){{{k}}}(:{_H}){{1,{7 - k}}}" for k in range(1, 7)), f":(:{_H}){{1,7}}", f"({_H}:){{1,7}}:"]) + r")\z"


def is_v6(ip: Column) -> Column:
    """Whether Python's ipaddress would take it: an IPv4 tail counts as two groups, a zone after % must be there and have no further %."""
    address, zone = F.substring_index(ip, "%", 1), F.regexp_extract(ip, "^[^%]*%([^%]+)$", 1)
    tail = F.substring_index(address, ":", -1)
    plain = F.when(is_v4(tail) & address.contains(":"), F.concat(address.substr(F.lit(1), F.length(address) - F.length(tail)), F.lit("0:0"))).otherwise(address)
    return F.coalesce(plain.rlike(_V6) & (~ip.contains("%") | (zone != "")), F.lit(False))


def is_address(ip: Column) -> Column:
    return is_v4(ip) | is_v6(ip)


def is_usable(ip: Column) -> Column:
    """An address other than the unspecified one, in whichever spelling."""
    zero = F.when(is_v4(ip), ip == "0.0.0.0").otherwise(F.substring_index(ip, "%", 1).rlike("^[0:.]*$"))
    return is_address(ip) & ~F.coalesce(zero, F.lit(False))
