"""A plain reading of time texts with the standard library, to hold the operator against."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ABBR = dict(UTC=0, GMT=0, BST=60, CET=60, CEST=120, JST=540, ACST=570, ACDT=630, AEST=600, AEDT=660, EST=-300, EDT=-240, PST=-480, PDT=-420)
EPOCH = datetime(1970, 1, 1)


def instant(text, offset=None, home=None):
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text).strip()
    if re.fullmatch(r"\d+", t):
        for scale in (1, 1000, 1_000_000):
            if 1_638_316_800 * scale <= int(t) < 1_798_761_600 * scale:
                return int(t) * 1000 // scale
        return None
    zone = re.search(r"(Z|(?:UTC)?[+-]\d{1,2}(?::?\d{2})?(?:\[[\w/]+\])?|(?<= )[A-Z][A-Za-z_]+/[A-Za-z_/]+|(?<= )[A-Z]{3,4})$", t) if re.search(r"\d:\d\d|T\d{6}", t) else None
    z = zone[0] if zone else ""
    if re.search(r" (AM|PM)$", t):
        z = ""
    body = t[: len(t) - len(z)].strip()
    wall = None
    digits = 0
    m = re.fullmatch(r"(.*:\d\d)\.(\d+)", body)
    if m:
        body, digits = m[1], int(m[2][:3].ljust(3, "0"))
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y, %I:%M:%S %p"):
        try:
            wall = datetime.strptime(body, form)
            break
        except ValueError:
            pass
    if wall is None:
        return None
    wall += timedelta(milliseconds=digits)
    ms = lambda w: (w - EPOCH) // timedelta(milliseconds=1)
    num = re.match(r"(?:UTC)?([+-])(\d{1,2}):?(\d{2})?", z)
    if z == "Z":
        return ms(wall)
    if num:
        off = int(num[2]) * 60 + int(num[3] or 0)
        return ms(wall) - (off if num[1] == "+" else -off) * 60_000
    if z in ABBR:
        return ms(wall) - ABBR[z] * 60_000
    if not z and offset is not None and offset == offset:
        return ms(wall) - round(offset * 60_000)
    name = z or home
    if not name:
        return None
    found = set()
    for fold in (0, 1):
        utc = wall.replace(tzinfo=ZoneInfo(name), fold=fold).astimezone(timezone.utc)
        if utc.astimezone(ZoneInfo(name)).replace(tzinfo=None) == wall:
            found.add(ms(utc.replace(tzinfo=None)))
    return found.pop() if len(found) == 1 else None
