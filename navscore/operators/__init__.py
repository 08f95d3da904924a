"""DataFrame-to-DataFrame operators: joins, one-pass measures, medians, bands."""
