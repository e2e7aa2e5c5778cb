"""Context, prompts, sources and answers for retrieved documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.scan import concatenated
from loomwright.schemas import LLMSettings

#: What the model is told around the excerpts; the subject is whatever the documents are about.
SYSTEM = "You are an expert assistant helping developers use {} components and guidelines."
SUBJECT = "design system"
INTRO = "Use the following documentation excerpts to answer my question. Each excerpt includes metadata about the source.\n\nContext:\n"
INSTRUCTIONS = (
    "Instructions:\n"
    "- Provide a clear, accurate answer based on the documentation above\n"
    "- If referencing specific components or patterns, mention them by name\n"
    "- Include code examples from the documentation when relevant\n"
    "- If the documentation doesn't contain enough information, say so (i.e. say \"I don't know\" as opposed to inferring)\n"
    "- Cite sources by mentioning the component or page name"
)
#: Greatest question sizes of hits for the query and REST interfaces.
MOST_QUERY, MOST_REST = 50, 20


def ordered_concat(parts: Column, order: Column, glue: str) -> Column:
    """Aggregate: parts in order, glued; for groups of bounded size, as a query's hits are."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("p")))), lambda s: s["p"]), glue)


def source_name(component: str = "component", title: str = "title") -> Column:
    return F.coalesce(component, title, F.lit("Unknown"))


def context(hits: DataFrame, most: int = 3, query_key: str = "query_id") -> DataFrame:
    """(query_key, context): the first hits as `--- Source: X > H ---` and content, two line ends apart."""
    head = F.concat(F.lit("--- Source: "), source_name(), F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" > "), "heading")).otherwise(""), F.lit(" ---\n"))
    return hits.where(F.col("rank") <= most).groupBy(query_key).agg(ordered_concat(F.concat(head, "content"), F.col("rank"), "\n\n").alias("context"))


def prompts(hits: DataFrame, questions: DataFrame, query_key: str = "query_id", subject: str = SUBJECT) -> DataFrame:
    """(query_key, system, prompt) of every question; one without hits has no excerpts, an excerpt without a title is named by its URL."""
    section = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("Section: "), "heading")).otherwise("")
    excerpt = F.concat(F.lit("\n---\nSource: "), F.coalesce(F.nullif("title", F.lit("")), "url", F.lit("")), F.lit("\n"), section, F.lit("\n\n"), "content", F.lit("\n"))
    joined = hits.groupBy(query_key).agg(ordered_concat(excerpt, F.col("rank"), "").alias("excerpts"))
    whole = F.concat(F.lit(INTRO), F.coalesce("excerpts", F.lit("")), F.lit("\n\nQuestion: "), "question", F.lit("\n\n" + INSTRUCTIONS))
    return questions.join(joined, query_key, "left").select(query_key, F.lit(SYSTEM.format(subject)).alias("system"), whole.alias("prompt"))


def with_context(context_text: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context_text, F.lit("\n\nQuestion: "), question)


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, rank, source, score, heading, url) for display; a score of 0 or none reads N/A."""
    return hits.select("query_id", "rank", source_name().alias("source"), T.fixed(F.col("score")).alias("score"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("url", F.lit("")).alias("url"))


def chat(messages: DataFrame, key: str = "conv_id", tasks: int | None = None) -> DataFrame:
    """(key, system, conversation, n_messages): system messages joined apart from the others, which follow in turn; a long conversation is many tasks."""
    is_system = F.col("role") == "system"
    line = F.concat("role", F.lit(": "), F.col("text"))
    parts = {"system": (F.when(is_system, F.col("text")), "\n\n"), "conversation": (F.when(~is_system, line), "\n")}
    return concatenated(messages, key, ["turn"], parts, {"n_messages": ~is_system}, tasks)


def request_error(question: Column, top_k: Column, most: int = MOST_QUERY) -> Column:
    """Why a request is refused, or null."""
    return F.when(question.isNull() | (T.strip(question) == ""), "question is empty").when(top_k.isNull() | (top_k < 1) | (top_k > most), f"top_k must be from 1 to {most}")


class Extractive:
    """Offline model: the first sentences of a prompt's first excerpt."""

    def __init__(self, settings: LLMSettings):
        self.settings = settings

    def reply(self, system: str | None, prompt: str) -> str:
        body = prompt.split("\nContext:\n", 1)[-1].split("\nQuestion: ", 1)[0].strip()
        return body[: 4 * self.settings.max_tokens].split("\n\n", 1)[-1][:400] or "I don't know"


#: Models by name: functions of the settings that return an object with reply(system, prompt).
MODELS: dict[str, Callable[[LLMSettings], object]] = {"extractive": Extractive}
#: Context windows in tokens by the beginning of a model's name; whoever registers a model adds its own.
CONTEXT_WINDOWS: dict[str, int] = {}


def model_info(settings: LLMSettings) -> dict:
    window = next((n for k, n in CONTEXT_WINDOWS.items() if settings.model_name.startswith(k)), None)
    return settings.request() | {"context_window": window}


def generate(rows: DataFrame, system: str = "system", prompt: str = "prompt", settings: LLMSettings = LLMSettings()) -> DataFrame:
    """rows with answer, error, prompt_tokens, completion_tokens and total_tokens; a failing prompt has an error and an empty answer."""
    model = MODELS[settings.model_name]

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = model(settings)
        for systems, asked in batches:
            out = []
            for s, p in zip(systems, asked):
                try:
                    out.append((client.reply(s, p), None))
                except Exception as e:  # noqa: BLE001  one prompt's failure is its own
                    out.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["answer", "error"])

    told = rows.withColumn("reply", run(F.col(system), F.col(prompt))).select(*rows.columns, "reply.*")
    told = told.withColumns({"prompt_tokens": T.token_estimate(F.concat(F.coalesce(system, F.lit("")), prompt)), "completion_tokens": T.token_estimate(F.col("answer"))})
    return told.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def response_stats(answers: DataFrame, hits: DataFrame) -> DataFrame:
    n = hits.groupBy("query_id").agg(F.count("*").alias("documents_retrieved"))
    joined = answers.join(n, "query_id", "left")
    return joined.select("query_id", F.coalesce("documents_retrieved", F.lit(0)).cast("long").alias("documents_retrieved"), F.length("question").cast("long").alias("query_length"), F.length("answer").cast("long").alias("answer_length"), (F.coalesce("documents_retrieved", F.lit(0)) > 0).alias("has_context"))
