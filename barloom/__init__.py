"""barloom: factor research over (trade_date, ts_code) panels, written as Spark plans."""
