"""tracekit: lap-timing and car-telemetry analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame keyed by
``(session_id, driver, lap_number)`` (samples) or ``(session_id, Driver, LapNumber)``
(laps), so one call covers every session at once and Catalyst plans the work.
"""

__version__ = "0.1.0"
