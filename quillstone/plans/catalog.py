"""All registered queries."""

from quillstone.plans import (  # noqa: F401
    chunk_plans,
    conversation_plans,
    evaluation_plans,
    knowledge_plans,
    memory_plans,
    retrieval_plans,
    sql_plans,
    text_plans,
    trace_plans,
)
from quillstone.plans.registry import ORACLES, QUERIES  # noqa: F401
