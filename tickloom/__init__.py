"""tickloom: a Spark-native engine for intraday market data.

Every operator is a function ``DataFrame -> DataFrame``. Instants are UTC, so sessions run with
``spark.sql.session.timeZone=UTC`` (see :func:`tickloom.runtime.prepare`).
"""
