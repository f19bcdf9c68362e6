"""A PySpark engine for copy localization over descriptor time series."""
