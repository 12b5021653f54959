"""Schemas of the input documents."""

TIMELINE = """semanticSegments array<struct<
  startTime: string, endTime: string, startTimeTimezoneUtcOffsetMinutes: double,
  visit: struct<probability: double, topCandidate: struct<placeId: string, semanticType: string, placeLocation: struct<latLng: string>>>,
  activity: struct<start: struct<latLng: string>, end: struct<latLng: string>, distanceMeters: double, topCandidate: struct<type: string>>,
  timelinePath: array<struct<point: string, time: string>>>>,
userLocationProfile struct<frequentPlaces: array<struct<placeId: string, placeLocation: string, label: string>>>"""

FEATURE = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
ZONES = "lat double, lng double, radiusMeters double"
BOOKMARKS = "name string, tab string, view string, params struct<code: string, muniCode: string>, anchor struct<lat: double, lng: double>, day string, filter struct<year: int, month: int>, granularity string, createdAt bigint"
