"""The probe-log reader over a folder that grows."""
