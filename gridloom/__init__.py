"""gridloom: hourly-demand analytics expressed as Spark DataFrame plans."""
