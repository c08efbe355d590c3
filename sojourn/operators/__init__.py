"""Trace operators: lifecycle fold, metadata joins, users, processes, lag
sums, MGF curves, linearity, crossing theta, envelopes and bounds."""
