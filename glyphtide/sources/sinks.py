"""Messages, and small tables that outlive a job: tasks and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def message(text: Column) -> Column:
    """A message as JSON."""
    return F.to_json(F.struct(F.lit("msg").alias("type"), text.alias("msg")))


def publish(rows: DataFrame, servers: str, topic: str, format: str = "kafka") -> None:
    """Send rows (value) to a topic, at most once and compressed; needs Spark's connector on the class path."""
    writer = rows.select("value").write.format(format).option("kafka.bootstrap.servers", servers).option("topic", topic)
    writer.option("kafka.acks", "0").option("kafka.compression.type", "gzip").save()


def save_tasks(tasks: DataFrame, path: str) -> None:
    """A new version of the task table; readers of the old one aren't disturbed."""
    tasks.write.mode("overwrite").parquet(path)


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The saved tasks, with what was under way stopped."""
    from ..operators.tasks import restored

    return restored(spark.read.parquet(path))


def log_line(component: Column, text: Column, task_id: Column) -> Column:
    """One line of a structured log."""
    task = F.when(task_id.isNotNull(), F.concat(F.lit(" task="), task_id.cast("string"))).otherwise("")
    return F.concat(F.lit("["), component, F.lit("]"), task, F.lit(" "), text)


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; texts are trimmed, and service addresses end in /v1."""

    docker_enabled: bool = False
    docker_url: str = ""
    detector_docker_name: str = ""
    recognizer_docker_name: str = ""
    kafka_enabled: bool = False
    kafka_url: str = ""
    detector_llm_base_url: str | None = None
    detector_llm_model: str = ""
    recognizer_llm_base_url: str | None = None
    recognizer_llm_model: str = ""
    llm_api_key: str | None = None

    def tidy(self) -> Settings:
        given = {k: v.strip() if isinstance(v, str) else v for k, v in asdict(self).items()}
        for k in ("detector_llm_base_url", "recognizer_llm_base_url"):
            bare = (given[k] or "").rstrip("/")
            given[k] = None if not bare else bare if bare.endswith("/v1") else f"{bare}/v1"
        return replace(self, **given)

    def changed(self, **given) -> Settings:
        """Settings with some values changed; unknown names are an error."""
        unknown = given.keys() - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **given).tidy()

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def load(cls, text: str | None) -> Settings:
        """Settings from JSON; an older single address serves both roles, and bad JSON gives the defaults."""
        try:
            given = json.loads(text or "{}")
        except json.JSONDecodeError:
            return cls().tidy()
        if not isinstance(given, dict):
            return cls().tidy()
        for role in ("detector", "recognizer"):
            given[f"{role}_llm_base_url"] = given.get(f"{role}_llm_base_url") or given.get("llm_base_url")
        known = {f.name: given[f.name] for f in fields(cls) if f.name in given}
        return cls(**known).tidy()


def number_setting(value: str | None, default: float, least: float, whole: bool = True) -> float:
    """A number from an environment text: the default if it is none, and not below ``least``."""
    try:
        return max(least, (int if whole else float)(value)) if value is not None else default
    except ValueError:
        return default


def flag_setting(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() not in ("0", "false", "no", "off")
