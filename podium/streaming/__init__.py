"""Streaming: intentionally empty.

The reference has no streams, watermarks, windows over event time or state;
its only repeated work is batch scoring of dated ``asof=`` snapshots, which
the snapshot reader (:func:`podium.sources.readers.read_latest_snapshot`)
covers with partition pruning.  No streaming operator is invented here.
"""
