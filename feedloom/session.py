"""A session with the settings that the operators expect, and where they keep tables between steps."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def session(name: str = "feedloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="feedloom-own-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; a local session without one uses a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or own_folder(spark.conf.get('spark.app.id'))).rstrip('/')}/{name}-{uuid.uuid4().hex}"
