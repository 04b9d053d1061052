"""DataFrame -> DataFrame operators on gridded time series."""
