"""Plain readings of coordinate texts and plain searches, to hold the operators against."""

import math
import re


def lat_lng(text):
    if text is None:
        return None
    numbers = re.findall(r"[-+]?\d+(?:\.\d+)?", text)
    if len(numbers) != 2:
        return None
    a, b = map(float, numbers)
    letters = re.findall(r"[A-Za-z]+", text.lower())
    if len(letters) == 2 and all(x in "nsew" for x in letters):
        signed = [-abs(v) if x in "sw" else v for v, x in zip((a, b), letters)]
        if letters[0] in "ns" and letters[1] in "ew":
            a, b = signed
        elif letters[0] in "ew" and letters[1] in "ns":
            b, a = signed
        else:
            return None
    elif letters[:1] in (["lng"], ["lon"], ["longitude"]):
        a, b = b, a
    return (a, b) if abs(a) <= 90 and abs(b) <= 180 and (a, b) != (0, 0) else None


def photo_place(lat, lng):
    if lat is None or lng is None or lat != lat or lng != lng:
        return None
    if abs(lat) > 90 or abs(lng) > 180:
        if lat != int(lat) or lng != int(lng):
            return None
        lat, lng = lat / 1e7, lng / 1e7
    return (lat, lng) if abs(lat) <= 90 and abs(lng) <= 180 and (lat, lng) != (0, 0) else None


def metres(p, q):
    (a, b), (c, d) = ((math.radians(v) for v in x) for x in (p, q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def inside(point, geometry):
    y, x = point
    odd = False
    for polygon in geometry:
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
    return odd
