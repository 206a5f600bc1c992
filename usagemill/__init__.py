"""Usage analytics on PySpark: scans, dedupe, pricing, reports and billing blocks as lazy DataFrame plans."""
