"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with their SQL counterparts."""
