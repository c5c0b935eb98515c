"""Clean-up of agent settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed


def normalise_agents(agents: DataFrame) -> DataFrame:
    """Clamps temperature, top_p and the memory interval; null temperature and top_p stay null."""
    ceiling = F.when(F.col("model") == "glm-4.6", 1.0).otherwise(2.0)

    def clamp(name: str, high):
        return F.when(F.col(name).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(high) if isinstance(high, float) else high, F.col(name))))

    return (
        agents.withColumn("temperature", clamp("temperature", ceiling))
        .withColumn("top_p", clamp("top_p", 1.0))
        .withColumn("auto_memory_interval", interval("auto_memory_interval"))
    )


def interval(name: str):
    low, high = fixed.MEMORY_INTERVAL_MIN, fixed.MEMORY_INTERVAL_MAX
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), F.col(name)))
    return F.when(F.col(name).isNull(), fixed.MEMORY_INTERVAL_DEFAULT).otherwise(bounded)
