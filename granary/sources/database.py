"""Databases: JDBC options for servers, a Python data source for SQLite, and scans of tables, queries and whole databases."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The usual port of each kind of server, by port.
PORTS = {1433: "mssql", 1434: "sybase", 1521: "oracle", 3306: "mysql", 3307: "mariadb", 5000: "sqlite", 5432: "postgresql", 5433: "greenplum", 6379: "redis", 27017: "mongodb", 50000: "db2"}
DRIVERS = {
    "mariadb": "org.mariadb.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
    "postgresql": "org.postgresql.Driver",
}
SQL_WORDS = ("select", "with", "show", "describe", "pragma", "explain")


def is_sql(text: str) -> bool:
    """Whether a string is a statement: it holds a semicolon or line end, or begins with one of a few words, as a word."""
    return bool(re.search("[;\n]", text) or re.match(rf"\s*({'|'.join(SQL_WORDS)})\b", text, re.I))


def kind_of(config: dict) -> str:
    """A configuration's server kind, given or by port; unknown raises."""
    kind = config.get("type") or PORTS.get(int(config.get("port") or 0))
    if not kind:
        raise ValueError(f"unknown database port: {config.get('port')}")
    return str(kind).split("+")[0]


def config_of_url(url: str) -> dict:
    """The parts of a connection string, kind[+driver]://user:password@host:port/database?service_name=..., or sqlite:///path."""
    kind, _, rest = url.partition("://")
    kind = kind.split("+")[0].lower()
    kind = {"postgres": "postgresql"}.get(kind, kind)
    if kind == "sqlite":
        return {"type": kind, "database": unquote(rest.split("?")[0].removeprefix("/")) or ":memory:"}
    parts = urlsplit(f"//{rest}")
    if not kind or not parts.hostname:
        raise ValueError("not a connection string: kind://user:password@host:port/database")
    options = dict(parse_qsl(parts.query))
    port = parts.port or next((p for p, k in PORTS.items() if k == kind), None)
    database = unquote(parts.path.removeprefix("/")) or options.get("service_name", "")
    return {"type": kind, "host": parts.hostname, "port": port, "username": unquote(parts.username or ""), "password": unquote(parts.password or ""), "database": database}


def jdbc_options(config: dict) -> dict[str, str]:
    """Options for ``format("jdbc")``. The password is an option, never part of the URL."""
    kind = kind_of(config)
    if kind not in DRIVERS:
        raise ValueError(f"no JDBC options for {kind}")
    at = f"{config['host']}:{config['port']}"
    url = {"oracle": f"jdbc:oracle:thin:@//{at}/{config['database']}", "mssql": f"jdbc:sqlserver://{at};databaseName={config['database']}"}.get(kind, f"jdbc:{kind}://{at}/{config['database']}")
    out = {"url": url, "driver": DRIVERS[kind], "user": config["username"], "password": config["password"]}
    # A partition column lets executors read ranges of a table at once.
    return out | {k: str(config[k]) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize") if k in config}


class SqliteRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    """Tables with row ids are read in ranges of them, at once; views and queries by one task."""

    def __init__(self, options: dict):
        self.path, self.query, self.table = options["path"], options.get("query"), options.get("dbtable")
        self.parts = int(options.get("numPartitions", 8))

    def partitions(self) -> list[InputPartition]:
        if self.query:
            return [InputPartition(0)]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(0)]
        if not isinstance(lo, int) or not isinstance(hi, int):
            return [InputPartition(0)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [SqliteRange(a, a + step) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            if self.query:
                yield from db.execute(self.query)
            elif isinstance(partition, SqliteRange):
                yield from db.execute(f"SELECT * FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))
            else:
                yield from db.execute(f"SELECT * FROM {quoted(self.table)}")


class SqliteSource(DataSource):
    """Options: path; dbtable or query. A column's type is the widest of its values: long, double, binary or text; text if there are none."""

    @classmethod
    def name(cls) -> str:
        return "granary_sqlite"

    def schema(self) -> str:
        query = self.options.get("query")
        body = f"({query.rstrip().rstrip(';')})" if query else quoted(self.options["dbtable"])
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [d[0] for d in db.execute(f"SELECT * FROM {body} LIMIT 0").description]
            kinds = db.execute("SELECT " + ", ".join(f"group_concat(DISTINCT typeof({quoted_name(n)}))" for n in names) + f" FROM {body}").fetchone()
        out = []
        for n, k in zip(names, kinds, strict=True):
            found = set((k or "text").split(",")) - {"null"}
            kind = "bigint" if found == {"integer"} else "double" if found and found <= {"integer", "real"} else "binary" if found == {"blob"} else "string"
            out.append(f"`{n}` {kind}")
        return ", ".join(out)

    def reader(self, schema) -> SqliteReader:
        return _Typed(self.options, [f.dataType.typeName() for f in schema.fields])


class _Typed(SqliteReader):
    def __init__(self, options: dict, kinds: list[str]):
        super().__init__(options)
        self.casts = [{"double": float, "string": str}.get(k) for k in kinds]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in super().read(partition):
            yield tuple(v if v is None or c is None else c(v) for v, c in zip(row, self.casts, strict=True))


def quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quoted(table: str) -> str:
    """A table name, schema and table apart at the first dot."""
    return ".".join(quoted_name(x) for x in table.split(".", 1))


class Database:
    """``scan``: a table, a query, several tables, or all of them. A ``connection_string`` in the configuration wins over its parts."""

    def __init__(self, spark: SparkSession, config: dict):
        if config.get("connection_string"):
            config = config | config_of_url(config["connection_string"])
        self.spark, self.config, self.kind = spark, config, kind_of(config)
        if self.kind == "sqlite":
            spark.dataSource.register(SqliteSource)

    def _read(self, **options) -> DataFrame:
        if self.kind == "sqlite":
            return self.spark.read.format("granary_sqlite").options(path=self.config["database"], **options).load()
        return self.spark.read.format("jdbc").options(**jdbc_options(self.config), **options).load()

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        schema = schema or self.config.get("schema")
        return self._read(dbtable=f"{schema}.{name}" if schema and "." not in name else name)

    def query(self, sql: str) -> DataFrame:
        return self._read(query=sql)

    def listing_sql(self, schema: str | None = None) -> str:
        """The catalog query for tables and views, system schemas left out where none is given."""
        if self.kind == "sqlite":
            return "SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'"
        text = "'" + schema.replace("'", "''") + "'" if schema else None
        if self.kind in ("mysql", "mariadb") and not text:  # here a schema is a database: the one connected to
            return "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = database()"
        if self.kind == "oracle":
            where = f"owner = {text}" if text else "owner NOT IN (SELECT username FROM all_users WHERE oracle_maintained = 'Y')"
            return f"SELECT owner || '.' || table_name AS name FROM all_tables WHERE {where} UNION SELECT owner || '.' || view_name FROM all_views WHERE {where}"
        where = f"table_schema = {text}" if text else "table_schema NOT IN ('information_schema', 'pg_catalog', 'mysql', 'performance_schema', 'sys')"
        name = "concat(table_schema, '.', table_name)"
        return f"SELECT {name} AS name FROM information_schema.tables WHERE {where}"

    def tables(self, schema: str | None = None) -> list[str]:
        """Names of all tables and views, sorted."""
        return sorted({r[0] for r in self.query(self.listing_sql(schema or self.config.get("schema"))).collect()})

    def scan(self, what: str | Iterable[str] | None = None, schema: str | None = None) -> dict[str, DataFrame]:
        """DataFrames by name: one table; a statement, named query; several tables in the order given; all for None or '*' (none found raises ValueError)."""
        if what is None or isinstance(what, str) and what.strip() == "*":
            names = self.tables(schema)
            if not names:
                raise ValueError("the database has no tables")
            return {n: self.table(n, schema) for n in names}
        if isinstance(what, str):
            return {"query": self.query(what)} if is_sql(what) else {what: self.table(what, schema)}
        if isinstance(what, (list, tuple, set)):
            return {n: self.table(n, schema) for n in what}
        raise TypeError("a table, a statement, several tables, '*' or None is asked for")
