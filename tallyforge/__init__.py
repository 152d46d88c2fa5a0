"""Set-oriented financial-document analytics on PySpark."""
