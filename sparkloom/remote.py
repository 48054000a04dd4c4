"""Sessions on other processes and machines."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from pathlib import Path

from .session import EngineSession


@dataclass(frozen=True)
class ExecutorConfig:
    cores: int = 1
    memory_mb: int = 1024


@dataclass(frozen=True)
class Endpoint:
    host: str = "localhost"
    port: int = 15002

    def __str__(self) -> str:
        return f"sc://{self.host}:{self.port}"


@dataclass(frozen=True)
class DistributedConfig:
    """A cluster: its master, or so many executor processes on this machine; where shuffles go, and into
    how many partitions (as many as executors have cores, if not said)."""

    master: str | None = None
    executors: int = 1
    executor: ExecutorConfig = ExecutorConfig()
    shuffle_dir: str | None = None
    default_partitions: int | None = None

    @property
    def partitions(self) -> int:
        return self.default_partitions or self.executors * self.executor.cores

    def settings(self) -> dict[str, str]:
        out = {"target_partitions": str(self.partitions), "spark.executor.cores": str(self.executor.cores), "spark.executor.memory": f"{self.executor.memory_mb}m"}
        return out | ({"spark.local.dir": self.shuffle_dir} if self.shuffle_dir else {})

    def master_url(self) -> str:
        return self.master or f"local-cluster[{self.executors},{self.executor.cores},{self.executor.memory_mb}]"

    def session(self) -> EngineSession:
        return EngineSession(self.settings(), master=self.master_url())


def connect(endpoint: Endpoint | str) -> EngineSession:
    """A session whose plans are built here and run on a Spark Connect server."""
    return EngineSession.remote(str(endpoint))


def start_server(endpoint: Endpoint = Endpoint(), master: str = "local[*]") -> subprocess.Popen:
    """A Spark Connect server as a child process; the caller ends it. Needs Spark's start scripts."""
    home = os.environ.get("SPARK_HOME")
    if not home:
        import pyspark

        home = str(Path(pyspark.__file__).parent)
    submit = Path(home) / "bin" / "spark-submit"
    if not submit.exists():
        raise FileNotFoundError(f"no spark-submit under {home}")
    command = [str(submit), "--master", master, "--class", "org.apache.spark.sql.connect.service.SparkConnectServer", "--conf", f"spark.connect.grpc.binding.port={endpoint.port}", "spark-internal"]
    return subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
