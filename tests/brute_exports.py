"""A plain walk over exports, to hold the shredder against."""

import json

from brute_geo import lat_lng


def get(o, *names):
    return next((o[n] for n in names if isinstance(o, dict) and o.get(n) is not None), None)


def held(o):
    if isinstance(o, dict):
        for n in ("semanticSegments", "semantic_segments"):
            if n in o:
                return [o[n]]
    for v in o.values() if isinstance(o, dict) else o if isinstance(o, list) else ():
        if found := held(v):
            return found
    return None


def segments(o):
    found = held(o)
    return found[0] if found else o if isinstance(o, list) else None


def rows(payload):
    try:
        o = payload
        while isinstance(o, str):
            o = json.loads(o.lstrip("\ufeff"))
    except ValueError:
        return
    for i, s in enumerate(segments(o) or []):
        if s is None or get(s, "visit") is not None:
            continue
        if (a := get(s, "activity")) is not None:
            kind = get(get(a, "topCandidate", "top_candidate"), "type")
            yield i, "activity", 0, "UNKNOWN" if kind in (None, "UNKNOWN_ACTIVITY_TYPE") else kind
            continue
        path = get(s, "timelinePath", "timeline_path")
        if isinstance(path, str):
            path = json.loads(path)
        if isinstance(path, dict):
            path = [path]
        for j, p in enumerate(path or []):
            point = get(p, "point")
            if isinstance(point, dict):
                point = get(point, "latLng", "lat_lng")
            if lat_lng(point):
                yield i, "path_point", j, ""
