"""Search forms of the fixed patterns that stay linear on long unbroken runs.

A plain pattern that starts with an open-ended run is tried again from every character of the run. All
starts inside one run share their fate, so these forms start only where a run starts (or where the last
match ended) and find the same matches.
"""

from __future__ import annotations

from pageloom.functions import fixed

_LOCAL = "[a-zA-Z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G)(?={_LOCAL}++@)" + fixed.EMAIL

# White space within a line.
BLANK = r"[\p{Z}\t\x0B\f\r\x85]"
MAP_POINT_LINE = r"(?<!\d)" + fixed.MAP_POINT_LINE

# What every address holds; a quick test before the patterns below.
STATE_AND_ZIP = r",\s*[A-Z]{2}\s*\d{5}"
# Groups: 1 whole address, 2 city, 3 state, 4 ZIP.
CITY = r"(?<![a-zA-Z\s])[a-z\s]*+(" + fixed.CITY_STATE_ZIP + ")"
CITY_SAME_LINE = CITY.replace(r"\s", r"[ \t]")
# Groups: 1 whole address, 2 street, 3 city, 4 state, 5 ZIP.
STREET = "(" + fixed.STREET_CITY_STATE_ZIP + ")"
