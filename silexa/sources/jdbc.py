"""Tables behind JDBC: addresses, and parallel reads and writes by Spark's own source."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_URL = re.compile(r"^jdbc:(?P<kind>[a-z0-9]+)://(?P<host>[^:/?]+)(?::(?P<port>\d+))?/(?P<database>[^?;]*)(?:\?(?P<options>.*))?$")


@dataclass(frozen=True)
class Address:
    """`jdbc:<kind>://<host>:<port>/<database>?<options>`"""

    kind: str
    host: str
    port: int | None
    database: str
    options: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def parse(url: str) -> Address:
        m = _URL.match(url)
        if not m:
            raise ValueError(f"no JDBC address: {url!r}")
        options = tuple(tuple(x.split("=", 1)) if "=" in x else (x, "") for x in (m["options"] or "").split("&") if x)
        return Address(m["kind"], m["host"], int(m["port"]) if m["port"] else None, m["database"], options)

    def url(self, with_database: bool = True) -> str:
        port = f":{self.port}" if self.port else ""
        options = "?" + "&".join(f"{k}={v}" if v else k for k, v in self.options) if self.options else ""
        return f"jdbc:{self.kind}://{self.host}{port}/{self.database if with_database else ''}{options}"


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table, in `parts` ranges of a numeric `key` at once if given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds and parts > 1:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def create_database(spark: SparkSession, url: str, user: str = "", password: str = "") -> None:
    """Create an address's database if it isn't there, by the driver's own JDBC connection."""
    a = Address.parse(url)
    if not re.fullmatch(r"\w+", a.database):
        raise ValueError(f"no plain database name: {a.database!r}")
    connection = spark._jvm.java.sql.DriverManager.getConnection(a.url(with_database=False), user, password)
    try:
        connection.createStatement().executeUpdate(f"CREATE DATABASE IF NOT EXISTS {a.database}")
    finally:
        connection.close()
