"""Web-resource compression analytics on Spark."""
