"""Text-format options shared by writers and readers so a round trip is exact.

Spark's default text timestamp formats stop at milliseconds; these keep all
six fractional digits.
"""

# Text timestamp patterns with microseconds.
TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

TEXT_TIME_OPTIONS = {
    "timestampNTZFormat": TIMESTAMP_NTZ_FORMAT,
    "timestampFormat": TIMESTAMP_FORMAT,
    "dateFormat": "yyyy-MM-dd",
}
