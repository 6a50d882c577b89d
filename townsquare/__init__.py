"""townsquare: social-media analytics as plain PySpark DataFrame jobs.

``sources``    JSON lines in, text / csv / json / model directories out
``functions``  Column expressions: time buckets, links, words, HTML text
``operators``  the jobs, each ``f(df, ...) -> DataFrame``
``plans``      the jobs bound to the sample tables, each beside its SQL check
"""
