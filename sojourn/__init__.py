"""sojourn: cluster-trace lifecycle and queueing-bound analytics on PySpark.

Every operator takes and returns DataFrames. Per-user processes, lag sums,
MGF curves, envelopes and bounds are computed for all users at once, keyed by
(username, ...), never by collecting a process to the driver.
"""

__all__ = ["session"]
