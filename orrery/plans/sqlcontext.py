"""SQL over frames registered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SQLContext:
    """A name space of its own: tables registered here are seen by its queries only.

    Queries are Spark SQL, with the standard's meaning: comparison of keys with
    null is unknown, ``LIMIT 0`` gives no rows, AND binds closer than OR.
    """

    def __init__(self, spark: SparkSession):
        self._parent = spark
        self.spark = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.timestampType", "spark.sql.adaptive.enabled"):
            value = spark.conf.get(key, None)
            if value is not None:
                self.spark.conf.set(key, value)
        self._names: dict[str, DataFrame] = {}

    def register(self, name: str, frame) -> None:
        """A DataFrame or Frame under a name; a later one of the same name replaces it."""
        df = frame if isinstance(frame, DataFrame) else frame.df
        # The plan is moved to the other session as it is; nothing is computed.
        moved = DataFrame(self._parent._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical()), self.spark)
        moved.createOrReplaceTempView(name)
        self._names[name] = moved

    def register_parquet(self, name: str, path: str) -> None:
        self.spark.read.parquet(path).createOrReplaceTempView(name)

    def unregister(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self._names.pop(name, None)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def execute(self, query: str) -> DataFrame:
        return self.spark.sql(query.rstrip().rstrip(";"))
