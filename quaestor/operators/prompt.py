"""Prompts, answers and chat history as expressions over retrieved rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class PromptTemplate:
    """The fixed texts of a prompt; a deployment brings its own."""

    persona: str = "Answer from the context and cite its labels."
    student_full: str = "The user studies {field}, term {term}."
    student_field: str = "The user studies {field}."
    knowledge: str = "General knowledge."
    context_title: str = "Context:"
    question_title: str = "Question: "
    answer_cue: str = "Answer:"


def labelled_context(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``(query_id, context, sources)`` from ``hits (query_id, rank, text, source_url)``: texts labelled ``[S1]``, ``[S2]``, ... in rank order.

    Null texts are labelled and empty; sources keep their order and repetitions.
    """
    ranked = hits.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", "text", "source_url"))).alias("h"))
    label = F.transform("h", lambda x, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(x["text"], F.lit(""))))
    return ranked.select(query_id, F.array_join(label, SEPARATOR).alias("context"), F.transform("h", lambda x: x["source_url"]).alias("sources"))


def student_clause(field: Column, term: Column, template: PromptTemplate = PromptTemplate()) -> Column:
    """A sentence on the user: with both values, with the field alone, or empty; empty strings count as missing."""

    def filled(text: str) -> Column:  # put together from parts, so that values are never filled in themselves
        values = {"{field}": field, "{term}": F.coalesce(term, F.lit(""))}
        return F.concat(*(values.get(part, F.lit(part)) for part in re.split(r"(\{field\}|\{term\})", text) if part))

    has_field, has_term = F.coalesce(field != "", F.lit(False)), F.coalesce(term != "", F.lit(False))
    return F.when(has_field & has_term, filled(template.student_full)).when(has_field, filled(template.student_field)).otherwise(F.lit(""))


def full_prompt(query: Column, context: Column, field: Column, term: Column, template: PromptTemplate = PromptTemplate()) -> Column:
    """Persona, user, knowledge, context, question and answer cue, in this order; a null context counts as empty."""
    return F.concat(
        F.lit(template.persona + "\n\n"),
        student_clause(field, term, template),
        F.lit(f"\n\n---\n{template.knowledge}\n---\n\n---\n{template.context_title}\n"),
        F.coalesce(context, F.lit("")),
        F.lit(f"\n---\n\n{template.question_title}"),
        query,
        F.lit(f"\n\n{template.answer_cue}"),
    )


class Answerer(Protocol):
    """Turns prompts into answers.  Made anew on each worker by a class, or by any callable that can be pickled.

    Arguments such as a model's name or its temperature are bound beforehand: ``functools.partial(Model, name=..., temperature=0.5)``.
    """

    def answer(self, prompts: list[str]) -> list[str]: ...


class ExtractiveAnswerer:
    """Answers with the first line of the first labelled text.  A stand-in without meaning."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [p.partition("[S1]\n")[2].split("\n", 1)[0].strip() for p in prompts]


def answer_column(prompt: Column, apology: str, make: Callable[[], Answerer] = ExtractiveAnswerer) -> Column:
    """The model's stripped answer to each prompt; the apology where the model fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = []
            for p in batch:
                try:
                    out.append(model.answer([p])[0].strip())
                except Exception:  # any failure of the model is an apology, never a failed job
                    out.append(apology)
            yield pd.Series(out, dtype=object)

    return run(prompt)


def respond(queries: DataFrame, hits: DataFrame, no_hit: str, apology: str, template: PromptTemplate = PromptTemplate(), make: Callable[[], Answerer] = ExtractiveAnswerer) -> DataFrame:
    """``(query_id, answer, sources)`` for each query: the fixed answer and no sources where nothing was found, else the model's.

    Queries without hits never reach the model.
    """
    joined = queries.join(labelled_context(hits), "query_id", "left")
    asked = joined.withColumn("prompt", full_prompt(F.col("query"), F.col("context"), F.col("field_of_study"), F.col("semester"), template))
    found = asked.where("context is not null").select("query_id", answer_column(F.col("prompt"), apology, make).alias("answer"), "sources")
    missed = asked.where("context is null").select("query_id", F.lit(no_hit).alias("answer"), F.expr("cast(array() as array<string>)").alias("sources"))
    return found.union(missed)


def shown_answer(answer: Column, sources: Column, title: str) -> Column:
    """The answer with a list of its sources, each once in the order of first use; without a list if there are none."""
    once = F.filter(F.array_distinct(F.coalesce(sources, F.expr("cast(array() as array<string>)"))), lambda s: s.isNotNull())
    listed = F.concat(answer, F.lit("\n\n" + title + "\n"), F.array_join(F.transform(once, lambda s: F.concat(F.lit("- "), s)), "\n"))
    return F.when(F.size(once) > 0, listed).otherwise(answer)


def history(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, n_turns, transcript)`` from ``turns (conv, turn, role, text)``, in turn order; null texts are empty."""
    ordered = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    return ordered.select(conv, F.size("t").alias("n_turns"), F.array_join(lines, "\n").alias("transcript"))


def append_turns(turns: DataFrame, queries: DataFrame, responses: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``turns (conv, turn, role, text)`` with one exchange more per conversation.

    ``queries (conv, query)`` always add a user turn, ``responses (conv, answer)`` an assistant turn only
    where there is an answer.  New conversations begin with turn 1.
    """
    last = turns.groupBy(conv).agg(F.max("turn").alias("last"))
    asked = queries.join(last, conv, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    user = asked.select(conv, (F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"))
    given = responses.where("answer is not null").join(asked.select(conv, "last"), conv)
    reply = given.select(conv, (F.col("last") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return turns.select(conv, "turn", "role", "text").unionByName(user).unionByName(reply)
