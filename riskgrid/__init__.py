"""riskgrid: event-risk forecasting on irregular time series, as Spark DataFrame plans."""

__version__ = "0.1.0"
