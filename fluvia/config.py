"""Runtime configuration: local or cluster, from arguments, TOML, the environment or code, as Spark settings."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class RuntimeConfig:
    """Where to run: `local` threads, or hosts with cores behind a cluster's master."""

    threads: int | None = None
    master: str | None = None
    hosts: tuple[tuple[str, int], ...] = ()
    settings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def local(cls, threads: int | None = None) -> RuntimeConfig:
        return cls(threads=threads)

    @classmethod
    def remote(cls, path: str) -> RuntimeConfig:
        return ConfigBuilder.new_remote().parse_file(path).build()

    @classmethod
    def from_args(cls, args: list[str]) -> tuple[RuntimeConfig, list[str]]:
        """`-l N` / `--local N` or `-r FILE` / `--remote FILE` first; returns what is left of the arguments too."""
        if len(args) >= 2 and args[0] in ("-l", "--local"):
            return cls.local(int(args[1])), args[2:]
        if len(args) >= 2 and args[0] in ("-r", "--remote"):
            return cls.remote(args[1]), args[2:]
        return cls.local(), args

    @property
    def parallelism(self) -> int:
        if self.hosts:
            return sum(cores for _, cores in self.hosts)
        return self.threads or os.cpu_count() or 1

    def spark_settings(self) -> dict[str, str]:
        out = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
        if self.master or not self.hosts:
            out["spark.master"] = self.master or f"local[{self.threads or '*'}]"
        if self.hosts:
            out |= {"spark.executor.instances": str(len(self.hosts)), "spark.executor.cores": str(max(c for _, c in self.hosts)), "spark.default.parallelism": str(self.parallelism)}
        return out | self.settings

    def session(self, app_name: str = "fluvia") -> SparkSession:
        return SparkSession.builder.appName(app_name).config(map=self.spark_settings()).getOrCreate()


class ConfigBuilder:
    """Builds a RuntimeConfig step by step; later values win."""

    def __init__(self, remote: bool):
        self._remote, self._threads, self._master = remote, None, None
        self._hosts: list[tuple[str, int]] = []
        self._settings: dict[str, str] = {}

    @classmethod
    def new_local(cls, threads: int | None = None) -> ConfigBuilder:
        out = cls(False)
        out._threads = threads
        return out

    @classmethod
    def new_remote(cls) -> ConfigBuilder:
        return cls(True)

    def parse_toml_str(self, text: str) -> ConfigBuilder:
        """[[host]] tables with address and num_cores, an optional master, and [spark] settings."""
        got = tomllib.loads(text)
        self._master = got.get("master", self._master)
        self.add_hosts([(h["address"], int(h["num_cores"])) for h in got.get("host", [])])
        self._settings |= {k: str(v) for k, v in got.get("spark", {}).items()}
        return self

    def parse_file(self, path: str) -> ConfigBuilder:
        with open(path, encoding="utf-8") as f:
            return self.parse_toml_str(f.read())

    def parse_env(self, name: str = "FLUVIA_CONFIG") -> ConfigBuilder:
        if name in os.environ:
            self.parse_toml_str(os.environ[name])
        return self

    def add_hosts(self, hosts: list[tuple[str, int]]) -> ConfigBuilder:
        self._hosts += hosts
        return self

    def setting(self, key: str, value: str) -> ConfigBuilder:
        self._settings[key] = value
        return self

    def build(self) -> RuntimeConfig:
        if self._remote and not self._hosts:
            raise ValueError("a remote configuration needs at least one host")
        return RuntimeConfig(self._threads, self._master, tuple(self._hosts), dict(self._settings))
