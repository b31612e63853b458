"""pathlight: a routing-observation analytics engine on PySpark."""
