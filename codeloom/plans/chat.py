"""Chat with retrieval: the messages a model would get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import history, prompts, retrieval
from codeloom.sources.keyword_index import KeywordIndex


def context_for(chunks: DataFrame, questions: DataFrame, top: int = 3, vector: DataFrame | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """query_id, context of questions (query_id, query) over chunks (chunk_key and chunk columns); empty without hits. With an index of
    the chunks no chunk is tokenised, and only chunks that are shown are read."""
    ranked = index.search(questions, top=top, key="chunk_key") if index else retrieval.bm25(chunks, questions, "chunk_key", top=top)
    chosen = retrieval.retrieve(ranked, vector).join(chunks, "chunk_key")
    found = retrieval.context_text(chosen, "query_id")
    return questions.select("query_id").join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def conversations(messages: DataFrame, beginner: bool = False) -> DataFrame:
    """conv_id, messages: system prompt and the last messages of each conversation."""
    recent = history.recent_messages(messages, "conv_id", "turn")
    return prompts.chat_messages(recent, "conv_id", "turn", prompts.BEGINNER_SYSTEM if beginner else prompts.CHAT_SYSTEM)
