"""Sessions: configuration, tables, SQL and frames."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import PlanError
from .frame import Frame, build
from .functions.registry import FunctionRegistry
from .plans import sqlfront
from .plans.spec import Node
from .sources import custom, files

#: Settings of this engine and the Spark settings that they become.
SETTINGS = {"target_partitions": "spark.sql.shuffle.partitions", "batch_size": "spark.sql.execution.arrow.maxRecordsPerBatch", "engine.csv.batchSize": "spark.sql.execution.arrow.maxRecordsPerBatch"}
DEFAULTS = {"batch_size": "1024"}


class SessionBuilder:
    """Collects settings, functions and tables, and builds a session; ``of`` starts from another's."""

    def __init__(self):
        self.settings: dict[str, str] = {}
        self.master: str | None = None
        self.spark: SparkSession | None = None

    @classmethod
    def of(cls, session: EngineSession) -> SessionBuilder:
        out = cls()
        out.settings, out.spark = dict(session.settings), session.spark
        return out

    def with_config(self, **settings) -> SessionBuilder:
        self.settings |= {k: str(v) for k, v in settings.items()}
        return self

    def with_setting(self, key: str, value) -> SessionBuilder:
        self.settings[key] = str(value)
        return self

    def with_master(self, master: str) -> SessionBuilder:
        self.master = master
        return self

    def with_spark(self, spark: SparkSession) -> SessionBuilder:
        self.spark = spark
        return self

    def build(self) -> EngineSession:
        return EngineSession(self.settings, self.spark, self.master)


class EngineSession:
    """Tables by name, and queries over them.

    Without ``spark`` a session is made, local if no master is given. A given Spark session keeps its
    settings but for those in ``settings``; columns compile to the same result under any of them.
    """

    def __init__(self, settings: dict | None = None, spark: SparkSession | None = None, master: str | None = None, parallelism: int | None = None):
        self.settings = DEFAULTS | {k: str(v) for k, v in (settings or {}).items()}
        self.parallelism = parallelism or int(self.settings.get("target_partitions", os.cpu_count() or 1))
        given = self.settings if spark is None else {k: str(v) for k, v in (settings or {}).items()}
        conf = {SETTINGS.get(k, k): v for k, v in given.items()}
        if spark is None:
            builder = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true").config("spark.sql.adaptive.enabled", "true")
            builder = builder.master(master) if master else builder.config("spark.master", "local[*]")
            for key, value in conf.items():
                builder = builder.config(key, value)
            spark = builder.getOrCreate()
        else:
            for key, value in conf.items():
                if key.startswith("spark.") and spark.conf.isModifiable(key):
                    spark.conf.set(key, value)
        self.spark = spark
        self.functions = FunctionRegistry(spark)
        self.tables: dict[str, Frame] = {}

    @classmethod
    def standalone(cls, workers: int | None = None) -> EngineSession:
        """A session with its executors in this process."""
        return cls(master=f"local[{workers or '*'}]")

    @classmethod
    def remote(cls, url: str) -> EngineSession:
        """A session on a Spark Connect server, ``sc://host:port``."""
        return cls(spark=SparkSession.builder.remote(url).getOrCreate())

    @property
    def batch_size(self) -> int:
        return int(self.settings.get("engine.csv.batchSize", self.settings["batch_size"]))

    # tables
    def _frame(self, df: DataFrame, name: str) -> Frame:
        return Frame(self, df, Node("scan", {"name": name}))

    def csv(self, path: str, schema=None, header: bool = True) -> Frame:
        return self._frame(files.csv(self.spark, path, schema, header), path)

    def tsv(self, path: str, schema=None, header: bool = True) -> Frame:
        return self._frame(files.tsv(self.spark, path, schema, header), path)

    def parquet(self, path: str) -> Frame:
        return self._frame(files.parquet(self.spark, path), path)

    def memory(self, data, schema=None, columns=None) -> Frame:
        return self._frame(files.memory(self.spark, data, schema, columns), "memory")

    def provider(self, name: str, provider: custom.TableProvider, columns: list[str] | None = None) -> Frame:
        return self.register(name, self._frame(custom.provided(self.spark, provider, name, columns), name))

    def register(self, name: str, frame: Frame | DataFrame) -> Frame:
        """A frame as a table; a derived one is a view, which queries see as their own plan."""
        df = frame.df if isinstance(frame, Frame) else frame
        df.createOrReplaceTempView(f"`{name}`")
        self.tables[name] = self._frame(df, name)
        return self.tables[name]

    def register_csv(self, name: str, path: str, schema=None, header: bool = True) -> Frame:
        return self.register(name, self.csv(path, schema, header))

    def register_parquet(self, name: str, path: str) -> Frame:
        return self.register(name, self.parquet(path))

    def register_data_source(self, name: str, data, schema=None) -> Frame:
        return self.register(name, self.memory(data, schema))

    def table(self, name: str) -> Frame:
        if name not in self.tables:
            raise PlanError(f"no table named {name!r}")
        return self.tables[name]

    def table_count(self) -> int:
        return len(self.tables)

    # queries
    def sql(self, text: str) -> Frame:
        return Frame(self, sqlfront.plan(self.spark, text), Node("sql", {"text": sqlfront.single_select(text)}))

    def execute(self, frame: Frame):
        """The result as Arrow batches, pulled by the caller."""
        return frame.batches(self.batch_size)

    def from_json(self, text: str) -> Frame:
        """A frame from its specification, over this session's tables of the same names."""
        return build(self, Node.from_json(text))

    def arrow_schema(self, df: DataFrame) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
