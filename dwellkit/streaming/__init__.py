"""Event streams: activity stints and counts per period."""
