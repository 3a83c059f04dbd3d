"""Spark-first analytics for labelled multichannel time series and temporal networks."""
